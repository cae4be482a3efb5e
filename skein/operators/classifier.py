"""The article classifier: facts from lexicons, an ordered decision, fit rules and an additive score.

Words of a text are extracted once; single-word Latin keywords are met by array
intersection, and only phrases and other scripts are searched for one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Statuses of an event and what each adds to the score.
STATUS_WEIGHTS = {"confirmed": 1.5, "adverse_confirmed": 1.5, "in_progress": 1.0, "considering": 0.5, "reported_unconfirmed": 0.5, "outlook": 0.25, "unknown": 0.0}
#: Statuses of an event that has not settled.
OPEN_STATUSES = ("adverse_confirmed", "in_progress", "considering", "reported_unconfirmed", "outlook")


@dataclass(frozen=True)
class Lexicon:
    """Everything the classifier looks for, as data; keys that are absent never hit."""

    categories: Mapping[str, Sequence[str]]
    #: Names of the categories that play a part: impact, ai, deals, macro, insights.
    roles: Mapping[str, str]
    themes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    editorial: Mapping[str, Sequence[str]] = field(default_factory=dict)
    deals: Mapping[str, Sequence[str]] = field(default_factory=dict)
    #: Keyword lists: specific_impact, impact_business, impact_purpose, ai_infrastructure, procurement, early_stage, impact_early, exclusions.
    signals: Mapping[str, Sequence[str]] = field(default_factory=dict)
    #: Patterns: enterprise_risk, legal, listing, tactical, roundup, operating, carveout, amount (on titles); pre_listing, macro, systemic (on texts).
    patterns: Mapping[str, str] = field(default_factory=dict)
    statuses: Sequence[tuple[str, str]] = ()
    bases: Sequence[tuple[str, str]] = ()
    weights: Mapping[str, float] = field(default_factory=lambda: STATUS_WEIGHTS)
    watchlist: Sequence[str] = ()
    penalties: Sequence[str] = ()
    watch_weight: float = 2.5
    group_weight: float = 2.0
    adjustments: Mapping[str, float] = field(default_factory=dict)


plain, word_set = T.plain_word, T.word_set


def count_hits(words: Column, low: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords occur."""
    keywords = list(dict.fromkeys(keywords))
    simple = [k.lower() for k in keywords if plain(k)]
    n = F.size(F.array_intersect(words, F.array(*[F.lit(k) for k in simple]))) if simple else F.lit(0)
    for k in keywords:
        if not plain(k):
            n = n + T.keyword_hit(low, k).cast("int")
    return n


def any_hit(words: Column, low: Column, keywords: Iterable[str]) -> Column:
    keywords = list(dict.fromkeys(keywords))
    simple = [k.lower() for k in keywords if plain(k)]
    out = F.arrays_overlap(words, F.array(*[F.lit(k) for k in simple])) if simple else F.lit(False)
    for k in keywords:
        if not plain(k):
            out = out | T.keyword_hit(low, k)
    return F.coalesce(out, F.lit(False))


def group_hits(words: Column, low: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Names of the groups with any keyword, in lexicon order."""
    return F.array_compact(F.array(*[F.when(any_hit(words, low, ks), F.lit(g)) for g, ks in groups.items()])) if groups else F.array().cast("array<string>")


def event_state(title: Column, text: Column, statuses: Sequence[tuple[str, str]], bases: Sequence[tuple[str, str]], unsettled: Sequence[str] = ("sourced_report", "unconfirmed_rumor")) -> tuple[Column, Column]:
    """(status, basis): the title's status, else the text's, else unknown; a report by hearsay without one is unconfirmed."""
    found = F.coalesce(T.first_match(title, statuses), T.first_match(text, statuses), F.lit("unknown"))
    basis = F.coalesce(T.first_match(text, bases), F.lit("unspecified"))
    return F.when((found == "unknown") & basis.isin(*unsettled), "reported_unconfirmed").otherwise(found), basis


@dataclass(frozen=True)
class TitleRule:
    """A reason with the pattern that gives it; where: title, or path of the link; for: all, official or other sources."""

    reason: str
    pattern: str
    unless: str | None = None
    sources: str = "all"
    where: str = "title"


def title_reason(title: Column, path: Column, official: Column, rules: Sequence[TitleRule]) -> Column:
    """The first rule that fits, in order; null if none.  (?i) holds for all letters, not ASCII alone."""
    out = []
    for r in rules:
        fits = (path if r.where == "path" else title).rlike("(?u)" + r.pattern)
        if r.unless:
            fits = fits & ~title.rlike("(?u)" + r.unless)
        if r.sources != "all":
            fits = fits & (official if r.sources == "official" else ~official)
        out.append(F.when(fits, F.lit(r.reason)))
    return F.coalesce(*out, F.lit(None).cast("string"))


def facts(rows: DataFrame, lexicon: Lexicon, title: str, text: str) -> DataFrame:
    """rows with all that the lexicon finds; the text's words are extracted once."""
    out = rows.withColumn("_title", F.lower(T.text_of(title))).withColumn("_text", F.lower(T.text_of(text)))
    out = out.withColumn("_words", word_set(F.col("_text")))
    words, low, head = F.col("_words"), F.col("_text"), F.col("_title")
    pattern = lambda name, on: on.rlike(lexicon.patterns[name]) if name in lexicon.patterns else F.lit(False)
    signal = lambda name: any_hit(words, low, lexicon.signals.get(name, ()))
    status, basis = event_state(head, low, lexicon.statuses, lexicon.bases)
    found = {f"_n_{i}": count_hits(words, low, ks) for i, ks in enumerate(lexicon.categories.values())}
    found |= {"themes": group_hits(words, low, lexicon.themes), "deal_signals": F.array_sort(group_hits(words, low, lexicon.deals))}
    risk = F.when(pattern("enterprise_risk", head), F.array(F.lit("enterprise_risk"))).otherwise(F.array().cast("array<string>"))
    found["editorial_signals"] = F.array_sort(F.array_union(group_hits(words, low, lexicon.editorial), risk))
    found |= {f"_s_{name}": signal(name) for name in ("specific_impact", "impact_business", "impact_purpose", "ai_infrastructure", "procurement", "early_stage", "impact_early", "exclusions")}
    found |= {f"_p_{name}": pattern(name, head) for name in ("legal", "listing", "tactical", "roundup", "operating", "carveout", "amount")}
    found |= {f"_p_{name}": pattern(name, low) for name in ("pre_listing", "macro", "systemic")}
    found |= {"event_status": status, "reporting_basis": basis}
    found |= {"_watch": count_hits(words, low, lexicon.watchlist), "_soft": count_hits(words, low, lexicon.penalties)}
    return out.withColumns(found)


def classify_articles(rows: DataFrame, lexicon: Lexicon, *, title: str = "title", text: str = "body") -> DataFrame:
    """Category with its reason, exclusion, adjustments, flags and relevance of each article.

    `rows` also has source_category, source_priority, official, fixed_category, rescued
    and title_reason (null: none).  The decision is the first of an ordered list of
    branches; what fits no category is general business and excluded.  The score adds
    source priority, the category's keywords, watched names, groups and the status, takes
    soft penalties off, is never below 0 and is 0 for what is excluded.
    """
    impact, ai, deals, macro, insights = (lexicon.roles[r] for r in ("impact", "ai", "deals", "macro", "insights"))
    number = {c: F.col(f"_n_{i}") for i, c in enumerate(lexicon.categories)}
    n = lambda c: number.get(c, F.lit(0))
    out = facts(rows, lexicon, title, text)
    own = F.coalesce(F.col("source_category"), F.lit(""))
    has = lambda column, *names: F.arrays_overlap(F.col(column), F.array(*[F.lit(x) for x in names]))
    content = (F.size("themes") > 0) & ((own == impact) | F.col("_s_specific_impact") | F.col("_s_impact_business") | F.col("_s_impact_purpose") | has("editorial_signals", "impact_evidence"))
    out = out.withColumn("_impact", content | F.col("_s_impact_business")).withColumn("_deal", (has("deal_signals", "transaction", "financing") | F.col("_s_early_stage")) & ~F.col("_p_legal"))
    listing = F.col("_p_listing") | (F.col("_deal") & F.col("_p_pre_listing"))
    fixed = F.col("fixed_category").isin(*lexicon.categories)
    branches = (
        ("official_insights_source", insights, F.col("official")),
        ("configured_newsletter_category", F.col("fixed_category"), fixed),
        ("verified_impact_source", impact, own == impact),
        ("impact_content", impact, F.col("_impact")),
        ("ai_public_procurement", ai, (n(ai) > 0) & F.col("_s_procurement")),
        ("ipo_or_listing_event", deals, listing),
        ("ai_infrastructure", ai, ((n(ai) > 0) | (own == ai)) & F.col("_s_ai_infrastructure")),
        ("deal_event", deals, F.col("_deal")),
        ("alternative_content", deals, (n(deals) > 0) & (n(deals) > n(ai))),
        ("ai_content", ai, n(ai) > 0),
        ("strict_macro_content", macro, F.col("_p_macro")),
        ("alternative_content", deals, n(deals) > 0),
        ("enterprise_risk", F.when(own.isin(*lexicon.categories), own).otherwise(deals), has("editorial_signals", "enterprise_risk")),
        ("source_fallback", own, own.isin(impact, ai, deals)),
    )
    reason, category = F.lit("general_business_fallback"), F.lit(deals)
    for name, to, when in reversed(branches):
        holds = F.coalesce(when, F.lit(False))
        reason = F.when(holds, name).otherwise(reason)
        category = F.when(holds, to if isinstance(to, Column) else F.lit(to)).otherwise(category)
    out = out.withColumn("category_reason", reason).withColumn("category", category)
    in_deals, in_macro = F.col("category") == deals, F.col("category") == macro
    fit = F.when(in_macro & F.col("_p_tactical") & ~F.col("_p_systemic"), "tactical_conflict_without_market_impact")
    fit = fit.when(in_deals & F.col("_p_legal"), "non_deal_legal_event").when(in_deals & has("editorial_signals", "major_contract_or_technology") & ~F.col("_deal"), "contract_without_category_fit")
    fit = fit.when(F.col("category_reason") == "general_business_fallback", "general_business_without_category_fit").when(in_deals & has("editorial_signals", "enterprise_risk") & ~F.col("_deal"), "enterprise_risk_without_investment_context")
    changes = F.array_compact(
        F.array(
            F.when(F.col("_p_roundup"), F.lit("branded_roundup")),
            F.when(in_macro & F.col("_p_operating"), F.lit("corporate_operating_macro")),
            F.when(in_deals & F.col("_deal") & F.col("_p_carveout"), F.lit("corporate_carveout_scale_signal")),
            F.when(in_deals & F.col("_deal") & F.col("_p_amount"), F.lit("capital_amount_signal")),
        )
    )
    exclusion = F.coalesce("title_reason", fit)
    out = out.withColumn("exclusion_reason", exclusion).withColumn("adjustments", changes)
    out = out.withColumn("excluded", F.col("exclusion_reason").isNotNull() | (F.col("_s_exclusions") & ~F.coalesce("rescued", F.lit(False))))
    moved = F.lit(0.0)
    for name, points in lexicon.adjustments.items():
        moved = moved + F.when(F.array_contains("adjustments", name), float(points)).otherwise(0.0)
    early = F.col("_s_early_stage") & (F.size("deal_signals") == 0) & ~((F.col("category") == impact) & F.col("_s_impact_early"))
    groups = lexicon.group_weight * (F.size("editorial_signals") + F.size("deal_signals") - F.when(early, 1 + has("editorial_signals", "investment_or_ma").cast("int")).otherwise(0))
    hits = F.lit(0)
    for c, count in number.items():
        hits = F.when(F.col("category") == c, count).otherwise(hits)
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in lexicon.weights.items() for x in pair])[F.col("event_status")], F.lit(0.0))
    score = F.coalesce("source_priority", F.lit(0.0)) + hits + lexicon.watch_weight * F.col("_watch") - F.col("_soft") + groups + weight
    signals = (F.size("editorial_signals") > 0) | (F.size("deal_signals") > 0)
    must = has("editorial_signals", "investment_or_ma", "policy_or_regulation", "major_contract_or_technology", "enterprise_risk", "impact_evidence") | (F.size("deal_signals") > 0)
    out = out.withColumns(
        {
            "relevance": F.when(F.col("excluded"), 0.0).otherwise(F.greatest(F.lit(0.0), score.cast("double"))),
            "score_adjustment": moved,
            "impact_verified": F.col("_impact") | (own == impact) | F.coalesce(F.col("fixed_category") == impact, F.lit(False)),
            "market_signal": signals & F.col("event_status").isin(*OPEN_STATUSES),
            "major_deal": in_deals & has("deal_signals", "transaction", "financing") & (F.col("event_status") == "confirmed"),
            "impact_must_read": (F.col("category") == impact) & must,
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def revalidate(rows: DataFrame, lexicon: Lexicon, *, context: str = "description") -> DataFrame:
    """Archived rows (with old_category) under today's safeguards: impact ownership and official insights only.

    The category changes where the source is official, or where an impact row that has a
    context no longer shows impact; the rest keeps its category.  Adds previous_category
    (null: unchanged), weekly_exclusion_reason and a note for rows without context.
    """
    impact = lexicon.roles["impact"]
    seen = classify_articles(rows, lexicon)
    has_context = F.coalesce(F.trim(F.col(context)), F.lit("")) != ""
    was_impact = F.col("old_category") == impact
    moves = (F.col("category_reason") == "official_insights_source") | (was_impact & has_context & ~F.col("impact_verified"))
    now = F.when(moves, F.col("category")).otherwise(F.col("old_category"))
    out = seen.withColumn("_now", now).withColumn("weekly_exclusion_reason", F.col("title_reason"))
    out = out.withColumn("note", F.when(was_impact & ~has_context, "legacy_context_missing")).withColumn("previous_category", F.when(~F.col("_now").eqNullSafe(F.col("old_category")), F.col("old_category")))
    return out.withColumn("category", F.col("_now")).drop("_now")


def theme_outside(themes: Column, text: Column, names: Sequence[str], pattern: str) -> Column:
    """Whether any of the named themes, or the pattern, speaks for an article."""
    return F.coalesce(F.arrays_overlap(themes, F.array(*[F.lit(n) for n in names])), F.lit(False)) | text.rlike(pattern)


def content_region(configured: Column, category: Column, title: Column, text: Column, local: Sequence[str], foreign: Sequence[str], split: Sequence[str], publisher: str | None = None, chrome: str | None = None) -> tuple[Column, Column]:
    """(region, reason) of the event's market in categories split by region; elsewhere the source's.

    A foreign title without a local word is global.  A report of a `publisher` (pattern on
    titles) is placed by its title, else by its text without the publisher's `chrome`.
    """
    words = lambda c: word_set(F.lower(c))
    hit = lambda c, lex: any_hit(words(c), F.lower(c), lex)
    own = F.when(configured == "korea", "korea").otherwise("global")
    of_publisher = title.rlike(publisher) if publisher else F.lit(False)
    body = F.regexp_replace(text, chrome, "") if chrome else text
    t_local, t_foreign = hit(title, local), hit(title, foreign)
    b_local, b_foreign, x_local, x_foreign = hit(text, local), hit(text, foreign), hit(body, local), hit(body, foreign)
    report = F.when(t_local, "korea_report_subject").when(t_foreign, "foreign_report_subject").when(x_local & ~x_foreign, "korea_report_subject").otherwise("international_report_subject")
    reason = F.when(~category.isin(*split), "configured_source_region").when(t_foreign & ~t_local, "foreign_event_in_korean_source").when(of_publisher, report)
    reason = reason.when(b_local & ~b_foreign, "korea_event_content").when(b_foreign & ~b_local, "foreign_event_in_korean_source").otherwise("configured_source_region")
    region = F.when(reason == "configured_source_region", own).when(reason.startswith("korea"), "korea").otherwise("global")
    return region, reason
