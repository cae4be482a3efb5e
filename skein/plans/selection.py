"""The selection as one call: pools, a judge or rules, quotas; and the last desk before an edition goes out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters as C
from ..operators import editorial as E
from ..operators import quotas as Q
from ..operators import rules as R
from ..operators import select as S
from ..operators import stories as N
from ..session import cut
from ..sources import searches

Picks = Callable[[DataFrame], DataFrame | None]


def candidate_pool(rows: DataFrame, quotas: Mapping[str, Q.Quota], order: Sequence[Column], *, themed: str | None = None, pool: int = 12) -> DataFrame:
    """What a judge sees: region pools, and for the themed category a round robin over `themes` by `score`."""
    caps = {c: q.region_cap for c, q in quotas.items() if q.region_cap is not None}
    out = Q.region_pool(rows if themed is None else rows.where(F.col("category") != themed), "category", "region", order, caps, pool)
    if themed is None:
        return out
    own = rows.where(F.col("category") == themed)
    chosen = S.theme_pool(own, ["category"], "themes", "source", "score", source_cap=quotas[themed].source_cap or pool, k=pool, prefer=F.col("region") == "global")
    return out.unionByName(own.join(chosen.select("ord"), "ord", "left_semi").select(*out.columns))


def select_news(rows: DataFrame, quotas: Mapping[str, Q.Quota], order: Sequence[Column], *, judge: Picks | None = None, themed: str | None = None, **lists) -> DataFrame:
    """(ord, category, reason, llm_score): the judge's picks under quotas, else the rules'.

    Rows of an unknown category go to the last; excluded rows and those of the wrong
    geography are out before the judge sees any.  A judge that returns None has failed, and
    the rules select; `lists` goes to `quotas.finalise_picks`.
    """
    names = list(quotas)
    known = F.when(F.col("category").isin(*names), F.col("category")).otherwise(names[-1])
    open_ = cut(rows.withColumn("category", known).where(Q.eligible(F.col("excluded"), F.col("geography"))))
    picks = judge(candidate_pool(open_, quotas, order, themed=themed)) if judge is not None else None
    if picks is None:
        chosen = Q.rule_fallback(open_, quotas, order)
        return chosen.select("ord", "category", F.lit("rule_fallback").alias("reason"), F.lit(None).cast("double").alias("llm_score"))
    return Q.finalise_picks(picks, open_.withColumn("eligible", F.lit(True)), quotas, **lists).select("ord", "category", "reason", "llm_score")


def final_agenda(rows: DataFrame, coverage: DataFrame, *, least: float, priority: Mapping[str, int], representative: Sequence[Column], exempt: str, impact: str, topic_keys: Sequence[str], subtypes: Sequence[str] = (), subtype_category: str = "", flags: Sequence[str] = ("major_deal",)) -> DataFrame:
    """Survivors of the last desk with their boosts: sendable rows, one an event, one a listing and stage.

    `rows` has what `stories.key_pairs`, `owned_groups` and `collapse_listings` read.
    Topics are counted over `coverage`, all that was collected, and a row whose topic two
    publishers and two rows tell is promoted; the impact category has a desk of its own.
    """
    sendable = cut(rows.where(R.sendable(F.col("excluded"), F.col("reviewed"), F.col("editor_score"), least)))
    led = C.leader_clusters(sendable.select("ord"), N.key_pairs(sendable))
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])[F.col("category")], F.lit(0))
    grouped = sendable.join(led, "ord")
    one = N.owned_groups(grouped, "leader", representative, owner=[F.col("official").desc(), rank.desc(), F.desc("relevance")], importance=[F.desc("importance"), F.desc("editor_score"), F.desc("relevance")], subtypes=subtypes, subtype_category=subtype_category, flags=flags, largest=("relevance", "editor_score"))
    survivors = cut(N.collapse_listings(one, representative, exempt=F.col("category") == exempt).where("dedup_reason IS NULL").drop("dedup_reason", "members", "leader"))
    cards = E.topic_cards(coverage.where(F.col("category") != impact), topic_keys)
    parts = C.topic_components(coverage.where(F.col("category") != impact), "ord", topic_keys)
    strong = E.corroborated(F.col("publishers"), F.col("members"), F.lit(False))
    told = parts.join(cards.select("component", F.when(strong, "strong").otherwise("topic").alias("strength"), "members").where("members > 1 OR strength = 'strong'"), "component").select("ord", "strength")
    joined = survivors.join(told, "ord", "left").withColumn("strength", F.when(F.col("category") != impact, F.col("strength")))
    importance, score = R.promotions(F.col("importance"), F.col("editor_score"), F.col("strength"))
    return joined.withColumns({"importance": importance, "editor_score": score})


def remote_evidence(shortlist: DataFrame, transport: searches.Transport, *, most: int = 12, overlap: float = 0.5) -> DataFrame:
    """(ord, found_title, matches, error) of the first `most` rows of a shortlist, their pages fetched once each.

    The page's own title (og:title, else its title) tells the row's when their words overlap.
    """
    asked = shortlist.orderBy("ord").limit(most).select("ord", F.col("title").alias("name"), "url")
    replies = searches.shared(asked, transport)
    html = F.decode("body", "utf-8")
    found = replies.select("ord", "name", F.coalesce(T.meta_content(html, "og:title"), T.tag_text(html, "title")).alias("found_title"), "error")
    alike = T.overlap_coefficient(T.word_tokens(F.col("name")), T.word_tokens(F.col("found_title")))
    return found.select("ord", "found_title", F.coalesce(alike >= overlap, F.lit(False)).alias("matches"), "error")
