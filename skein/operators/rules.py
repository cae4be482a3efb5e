"""Filters, classification and scoring: ordered rule cascades over lexicons given as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

@dataclass(frozen=True)
class Relevance:
    """Lexicons of the relevance cascade; each list in the order that decides reasons."""

    blacklist: Sequence[str] = ()
    opinion_url: Sequence[str] = ()
    opinion_words: Sequence[str] = ()
    hard: Sequence[str] = ()
    soft: Sequence[str] = ()
    rescue: Sequence[str] = ()
    interest: Sequence[str] = ()
    events: Sequence[str] = ()
    curated: Sequence[str] = ()


def first_keyword_reason(kind: str, text: Column, words: Sequence[str]) -> Column:
    hit = T.first_hit(text, words)
    return F.when(hit.isNotNull(), F.concat(F.lit(kind + ":"), hit))


def opinion_marker(url: Column, text: Column, url_parts: Sequence[str], words: Sequence[str]) -> Column:
    """The URL fragment or format word that marks opinion, else null."""
    by_url = F.coalesce(*[F.when(F.contains(F.lower(T.text_of(url)), F.lit(p)), F.lit(p)) for p in url_parts], F.lit(None).cast("string"))
    return F.coalesce(by_url, T.first_hit(text, words))


def relevance_reason(title: Column, text: Column, url: Column, source: Column, lexicon: Relevance, title_only: Column | None = None, deferred: Column | None = None) -> Column:
    """First failing rule, null for a relevant row; rescue words lift a soft exclusion.

    The text's words are extracted once, and all lexicons are held against them.
    """

    def reason(kind: str, found: Column, words: Sequence[str]) -> Column:
        hit = T.first_in(found, words)
        return F.when(hit.isNotNull(), F.concat(F.lit(kind + ":"), hit))

    by_url = opinion_marker(url, F.lit(""), lexicon.opinion_url, ())
    curated = source.isin(*lexicon.curated) if lexicon.curated else F.lit(False)
    always = (F.lit(False) if deferred is None else deferred) | curated

    def decide(found: Column) -> Column:
        hard = reason("hard", found, lexicon.hard)
        if title_only is not None:
            hard = F.when(title_only, T.bind(T.worded(title), lambda t: reason("hard", t, lexicon.hard))).otherwise(hard)
        failing = F.coalesce(
            reason("blacklist", found, lexicon.blacklist),
            F.when(by_url.isNotNull(), F.concat(F.lit("opinion:"), by_url)),
            reason("opinion", found, lexicon.opinion_words),
            hard,
            F.when(T.first_in(found, lexicon.rescue).isNull(), reason("soft", found, lexicon.soft)),
        )
        wanted = always | T.first_in(found, lexicon.interest).isNotNull() | T.first_in(found, lexicon.events).isNotNull()
        return F.coalesce(failing, F.when(~F.coalesce(wanted, F.lit(False)), "no_relevant_signal"))

    return T.bind(T.worded(text), decide)


def relevance_signal(text: Column, source: Column, lexicon: Relevance) -> Column:
    """What speaks for a row: curated source, interest word or event, in this order."""
    curated = F.when(source.isin(*lexicon.curated), "curated") if lexicon.curated else F.lit(None).cast("string")
    return F.coalesce(curated, first_keyword_reason("interest", text, lexicon.interest), first_keyword_reason("event", text, lexicon.events))


def title_exclusion(title: Column, rules: Sequence[tuple[str, str]], official: Column, official_rules: Sequence[str] = ()) -> Column:
    """First title rule that fits; rules named in `official_rules` hold for official sources only."""
    out = []
    for reason, pattern in rules:
        fits = title.rlike(pattern)
        out.append(F.when((fits & official) if reason in official_rules else fits, reason))
    return F.coalesce(*out, F.lit(None).cast("string"))


def sendable(excluded: Column, reviewed: Column, score: Column, least: float) -> Column:
    return ~F.coalesce(excluded, F.lit(False)) & F.coalesce(reviewed, F.lit(False)) & (score >= least)


def deal_eligible(title: Column, text: Column, veto: str, signals: Column, capital: str, context: str, change: str) -> Column:
    """A deal signal, capital words, or context with change; a vetoed title never."""
    return ~title.rlike(veto) & ((F.size(signals) > 0) | text.rlike(capital) | (text.rlike(context) & text.rlike(change)))


def geography_scope(text: Column, core: str, exception: str) -> Column:
    return F.when(text.rlike(core), "core").when(text.rlike(exception), "exception").otherwise("local")


def boundary_candidates(rows: DataFrame, category: str, score: str, low: float, high: float, per_category: int, total: int) -> DataFrame:
    """Rows in the uncertain score band, within a budget a category and in all."""
    from .select import ranked

    band = rows.where(F.col(score).between(low, high))
    dealt = ranked(band, [category], [F.desc(score)], "place_in_category").where(F.col("place_in_category") <= per_category)
    return dealt.orderBy(F.desc(score), "ord").limit(total)


def needs_evidence(title: Column, url: Column, domains: Sequence[str], claim: str) -> Column:
    host = T.host_of(url)
    known = F.lit(False)
    for d in domains:
        known = known | (host == d) | host.endswith("." + d)
    return title.rlike(claim) & known


# Classification


@dataclass(frozen=True)
class Taxonomy:
    """Lexicons of categories and deal groups, and the ordered decision on hits."""

    categories: Mapping[str, Sequence[str]]
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    watchlist: Sequence[str] = ()
    statuses: Sequence[tuple[str, str]] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    penalties: Sequence[tuple[str, float]] = ()
    fallback: str = "general"


def matched_groups(text: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Names of the groups with any keyword in the text, in lexicon order."""
    named = []
    for name, words in groups.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | T.keyword_hit(text, w)
        named.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def classify(rows: DataFrame, title: str, text: str, taxonomy: Taxonomy, priority: Column | None = None, excluded: Column | None = None) -> DataFrame:
    """category, category_reason, groups, status and relevance of each row, by keywords alone.

    The category with most hits wins, the first in lexicon order of equals; the ordered
    decision is `classifier.classify_articles`.  Score: source priority + hits + 2.5 a
    watchlist word - penalties + 2 a group + the taxonomy's weight of the status, at least
    0, and 0 where excluded.
    """
    from . import classifier as K

    out = rows.withColumn("_low", F.lower(T.text_of(text))).withColumn("_words", K.word_set(F.col("_low")))
    words, low = F.col("_words"), F.col("_low")
    hits = [F.struct(K.count_hits(words, low, ks).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, ks) in enumerate(taxonomy.categories.items())]
    status, _ = K.event_state(F.lower(T.text_of(title)), low, taxonomy.statuses, ())
    penalty = F.lit(0.0)
    for word, cost in taxonomy.penalties:
        penalty = penalty + F.when(K.any_hit(words, low, (word,)), cost).otherwise(0.0)
    out = out.withColumns({"_best": F.array_max(F.array(*hits)), "groups": K.group_hits(words, low, taxonomy.groups), "status": status, "_penalty": penalty, "_watch": K.count_hits(words, low, taxonomy.watchlist)})
    weight = F.create_map(*[F.lit(x) for pair in taxonomy.weights.items() for x in pair])[F.col("status")] if taxonomy.weights else F.lit(0.0)
    score = (F.lit(0.0) if priority is None else priority) + F.col("_best.n") + 2.5 * F.col("_watch") - F.col("_penalty") + 2.0 * F.size("groups") + F.coalesce(weight, F.lit(0.0))
    score = F.greatest(score, F.lit(0.0))
    out = out.withColumn("relevance", score if excluded is None else F.when(excluded, 0.0).otherwise(score))
    out = out.withColumn("category", F.when(F.col("_best.n") > 0, F.col("_best.name")).otherwise(taxonomy.fallback))
    return out.withColumn("category_reason", F.when(F.col("_best.n") > 0, "keyword_hits").otherwise("fallback")).drop("_low", "_words", "_best", "_penalty", "_watch")


def additive_score(terms: Sequence[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """(score, reasons) of terms (reason, condition, points) whose condition holds."""
    score = F.lit(0.0)
    for _, condition, points in terms:
        score = score + F.when(condition, points).otherwise(0.0)
    return score, F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c, _ in terms]))


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, id: str = "ord", locked: Column | None = None, unverified: Column | None = None, cap: float = 5.0) -> DataFrame:
    """Editor verdicts (id, keep, category, score, event_key) applied; a row without one is unreviewed.

    A locked row keeps its category; an unverified claim caps the score; keys are
    reduced to lower case, digits and underscores.
    """
    v = verdicts.select(F.col(id), F.col("keep").alias("v_keep"), F.col("category").alias("v_category"), F.col("score").alias("v_score"), F.col("event_key").alias("v_key"))
    out = rows.join(v, id, "left")
    category = F.when(F.lit(False) if locked is None else locked, F.col("category")).otherwise(F.coalesce("v_category", "category"))
    score = F.when(F.lit(False) if unverified is None else unverified, F.least("v_score", F.lit(cap))).otherwise(F.col("v_score"))
    key = F.regexp_replace(F.regexp_replace(F.lower(T.text_of("v_key")), r"[^a-z0-9가-힣]+", "_"), r"^_+|_+$", "")
    return out.withColumn("editor_verdict", F.when(F.col("v_keep").isNull(), "unreviewed").when(F.col("v_keep"), "keep").otherwise("reject")).withColumn("category", category).withColumn("editor_score", score).withColumn("editor_event_key", key).drop("v_keep", "v_category", "v_score", "v_key")


def judge_batches(rows: DataFrame, size: int = 80) -> DataFrame:
    """Batch number of each row: `size` rows a batch, in input order.

    Ranks come from a range-partitioned sort and the counts of its partitions, so neither
    they nor the batches depend on the number of tasks.
    """
    from pyspark.sql import Window

    from ..session import cut

    ordered = cut(rows.repartitionByRange(F.col("ord")).withColumn("_p", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted((r[0], r[1]) for r in ordered.groupBy("_p").count().collect()):  # one row a partition
        offsets += [F.lit(part), F.lit(before)]
        before += n
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("ord")) - 1
    at = inside + (F.create_map(*offsets)[F.col("_p")] if offsets else F.lit(0))
    return ordered.withColumn("batch", F.floor(at / size).cast("bigint")).drop("_p")


def promotions(importance: Column, score: Column, strength: Column) -> tuple[Column, Column]:
    """Agenda boosts: +0.5 for a topic, +1.0 for a strong one, score at most 10, importance up one to 2."""
    boost = F.when(strength == "strong", 1.0).when(strength == "topic", 0.5).otherwise(0.0)
    raised = F.when(boost > 0, F.greatest(importance, F.least(importance + 1, F.lit(2)))).otherwise(importance)
    return raised, F.least(F.lit(10.0), score + boost)


def noise_flags(p: Column, level: float = 0.7) -> Column:
    """`flag` from the level on, `uncertain` above its complement, else `clear`."""
    return F.when(p >= level, "flag").when(p > 1 - level, "uncertain").otherwise("clear")


def apply_evidence(rows: DataFrame, claim: Column, checked: Column, matched: Column) -> DataFrame:
    """Claim status after a check: granted when the evidence matches, reported when not, else as it was."""
    return rows.withColumn("claim_status", F.when(checked & matched, "granted").when(checked, "reported").otherwise(claim))


def impact_label(kind: Column, text: Column, policy: str, investment: str) -> Column:
    """The editor's type, else policy before investment before industry."""
    return F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.when(text.rlike(policy), "policy").when(text.rlike(investment), "investment").otherwise("industry"))


def quality_issues(rows: DataFrame, rules: Sequence[tuple[str, Column]], id: str = "ord") -> DataFrame:
    """(id, code): one row an issue; rules are conditions on a row."""
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))
    return rows.select(id, F.explode(codes).alias("code"))


# Gates around the judge


def weekly_eligible(excluded: Column, text: Column, insights: Column, low_value: str, technical: str) -> Column:
    """No structural noise: no exclusion, no low-value format, and no technical format among insights."""
    return (T.text_of(excluded) == "") & ~text.rlike(low_value) & ~(insights & text.rlike(technical))


def agenda_eligible(title: Column, category: Column, excluded: Column, verdict: Column, barred: Sequence[str]) -> Column:
    """Kept rows with a title, outside the barred categories and not excluded."""
    return (F.trim(T.text_of(title)) != "") & ~F.coalesce(category.isin(*barred), F.lit(False)) & ~F.coalesce(excluded, F.lit(False)) & F.coalesce(verdict == "keep", F.lit(False))


def complete(rows: DataFrame, title: str = "title", link: str = "link", note: str | None = None) -> DataFrame:
    """Rows with a title and a link; notes are context and never sent."""
    has = (F.trim(T.text_of(title)) != "") & (F.trim(T.text_of(link)) != "")
    return rows.where(has if note is None else has & ~F.coalesce(F.col(note), F.lit(False)))


def gate(rows: DataFrame, deferrable: Sequence[str], can_defer: bool, *, reason: str = "exclusion_reason", newsletter: str = "newsletter", excluded: str = "excluded") -> tuple[DataFrame, DataFrame]:
    """(to the judge, rejected): excluded rows go, but newsletters excluded for a deferrable reason are only deferred."""
    deferred = F.lit(can_defer) & F.col(excluded) & F.col(newsletter) & F.coalesce(F.col(reason).isin(*deferrable), F.lit(False)) if deferrable else F.lit(False)
    marked = rows.withColumn("deferred", F.coalesce(deferred, F.lit(False)))
    out = F.coalesce(F.col(excluded), F.lit(False)) & ~F.col("deferred")
    return marked.where(~out), marked.where(out)


def rescue(judged: DataFrame, *, verdict: str = "editor_verdict", excluded: str = "still_excluded") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) after the judge: a deferred row is restored only by an explicit keep."""
    lost = F.col("deferred") & ~(F.coalesce(F.col(verdict) == "keep", F.lit(False)) & ~F.coalesce(F.col(excluded), F.lit(False)))
    why = F.when(F.col(verdict) == "reject", "editor").otherwise("newsletter_review_unavailable")
    refused = ~F.col("deferred") & F.coalesce(F.col(verdict) == "reject", F.lit(False))
    marked = judged.withColumn("rejected_by", F.when(lost, why).when(refused, "editor"))
    return marked.where("rejected_by IS NULL").drop("rejected_by"), marked.where("rejected_by IS NOT NULL")


def grounded_second_look(rows: DataFrame, verdicts: DataFrame, *, least: int = 8) -> DataFrame:
    """Verdicts of a second look at boundary rows, taken only where they quote the row: else the first stands.

    `verdicts` has ord, keep and quote; a quote is `least` characters that the title or
    description holds as they are.
    """
    met = rows.join(verdicts.select("ord", F.col("keep").alias("_keep"), F.col("quote").alias("_quote")), "ord", "left")
    quote = T.text_of("_quote")
    said = (F.length(quote) >= least) & (F.contains(T.text_of("title"), quote) | F.contains(T.text_of("description"), quote))
    taken = F.col("_keep").isNotNull() & said
    out = met.withColumn("grounded", taken).withColumn("editor_verdict", F.when(taken, F.when(F.col("_keep"), "keep").otherwise("reject")).otherwise(F.col("editor_verdict")))
    return out.drop("_keep", "_quote")


def selected_flags(rows: DataFrame, selected: DataFrame, id: str = "ord") -> DataFrame:
    """Every row with whether its id was selected."""
    return rows.join(selected.select(F.col(id).alias("_id")).distinct().withColumn("_hit", F.lit(True)), F.col(id) == F.col("_id"), "left").withColumn("selected", F.col("_hit").isNotNull()).drop("_id", "_hit")


def translated(rows: DataFrame, replies: DataFrame, pairs: Sequence[tuple[str, str]], *, id: str = "ord", title: str = "title", script: str = "가-힣") -> DataFrame:
    """Titles of one script translated: the reply's where it is in the other script and keeps the qualifiers, else the original.

    Adds title_orig (null: not asked); only titles without the script are asked for.
    """
    met = rows.join(replies.select(F.col(id).alias("_id"), F.col("title").alias("_new")), F.col(id) == F.col("_id"), "left")
    asked = ~F.col(title).rlike(f"[{script}]") & F.col(title).rlike("[A-Za-z]")
    good = asked & (F.trim(T.text_of("_new")) != "") & F.col("_new").rlike(f"[{script}]") & F.coalesce(T.preserves_qualifiers(F.col(title), F.col("_new"), pairs), F.lit(False))
    good = F.coalesce(good, F.lit(False))
    return met.withColumn("title_orig", F.when(asked, F.col(title))).withColumn(title, F.when(good, F.trim("_new")).otherwise(F.col(title))).drop("_id", "_new")


def source_region(rows: DataFrame, registry: DataFrame, *, url: str = "url", languages: Sequence[str] = ("ko",), query: str = r"[?&](?:hl|lang)=([a-z]+)") -> DataFrame:
    """Region of a source: its registered domain's, else that of a language parameter of its url, else global."""
    from .joins import suffix_match

    own = rows.withColumn("_host", T.host_of(F.col(url)))
    found = suffix_match(own, registry.withColumnRenamed("region", "_region"), "_host", "domain", "_region")
    by_language = F.when(F.regexp_extract(url, query, 1).isin(*languages), "korea")
    return found.withColumn("region", F.coalesce("_region", by_language, F.lit("global"))).drop("_host", "_region")
