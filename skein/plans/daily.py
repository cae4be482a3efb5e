"""The daily edition: memory, relevance, stories, classification, judging, history and quotas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters as C
from ..operators import editorial as E
from ..operators import joins as J
from ..operators import rules as R
from ..operators import select as S
from ..operators import stories as N
from ..session import cut
from .judge import Judge, rule_judge


def select_digest(articles: DataFrame, k: int = 3) -> DataFrame:
    """One representative a story, then the k best of each category and region."""
    grouped = C.elect(C.title_groups(articles), ["leader"], [F.desc("size"), F.desc("day")])
    return S.top_per_group(grouped.where("is_representative"), ["category", "region"], [F.desc("size")], k)


def plain_facts(rows: DataFrame) -> DataFrame:
    """The facts of the merge rule as far as titles tell them; columns that rows has stay."""
    none = F.array().cast("array<string>")
    own = {"feed": F.lit(None).cast("string"), "types": none, "stage": F.lit(""), "families": none, "tokens": F.array_sort(T.headline_tokens(F.col("title"))), "rates": none, "actors": none, "actions": none, "reaction": F.lit(False)}
    return rows.withColumns({c: v for c, v in own.items() if c not in rows.columns})


def daily_edition(articles: DataFrame, *, seen_links: DataFrame, seen_titles: DataFrame, lexicon: R.Relevance, taxonomy: R.Taxonomy, memory: DataFrame | None = None, facts: Callable[[DataFrame], DataFrame] = plain_facts, judge: Judge | None = None, limits: int = 3, source_cap: int = 2, anchors: Sequence[str] = ()) -> dict[str, DataFrame]:
    """selected, and rejected: (ord, stage, reason) of every other row, by the first stage that lost it.

    `articles` has ord, title, description, link, source, region, day.  `facts` adds what
    the merge rule reads, and with a `memory` (day, family, stage, entities, status) the
    family, entities and status of each row: an event told in the last seven days goes
    unless its status has risen to 2 or more.
    """
    lost = []

    def drop(before: DataFrame, after: DataFrame, stage: str, reason: Column | None = None) -> DataFrame:
        gone = before.join(after.select("ord"), "ord", "left_anti")
        lost.append(gone.select("ord", F.lit(stage).alias("stage"), (F.lit(stage) if reason is None else reason).alias("reason")))
        return after

    linked = cut(articles.withColumn("link", T.normalize_url(F.col("link"))))
    whole = drop(linked, R.complete(linked), "incomplete")
    fresh = drop(whole, J.unseen(whole, seen_links, ["link"]), "seen_link")
    unseen = drop(fresh, cut(J.unseen_issues(fresh, seen_titles)), "seen_title")
    body = F.concat_ws(" ", "title", "description")
    reasoned = cut(unseen.withColumn("filter_reason", R.relevance_reason(F.col("title"), body, F.col("link"), F.col("source"), lexicon)))
    relevant = drop(reasoned, reasoned.where("filter_reason IS NULL"), "relevance", F.col("filter_reason"))
    told_of = facts(relevant)
    led = relevant.join(N.story_clusters(told_of), "ord")
    grouped = cut(C.elect(led, ["leader"], [F.desc(F.length("description"))]))
    merged = drop(grouped, grouped.where("is_representative"), "duplicate", F.concat(F.lit("story:"), F.col("leader").cast("string"))).withColumn("body", body)
    classified = R.classify(merged, "title", "body", taxonomy)
    verdicts = (judge or rule_judge("relevance"))(classified)
    judged = cut(R.apply_verdicts(classified, verdicts))
    kept = drop(judged, judged.where("editor_verdict = 'keep'"), "editor", F.col("editor_verdict"))
    if memory is not None:
        events = told_of.select("ord", "day", "family", "stage", "entities", F.col("status").alias("event_rank"))
        told = E.told_before(events, memory, anchors=anchors).join(events.select("ord", "event_rank"), "ord")
        old = told.where(~((F.col("event_rank") >= 2) & (F.col("event_rank") > F.col("told"))))
        kept = drop(kept, kept.join(old.select("ord"), "ord", "left_anti"), "told")
    selected = drop(kept, cut(S.hard_cap(kept, ["category", "region"], "source", [F.desc("editor_score")], source_cap, limits)), "quota")
    rejected = lost[0]
    for more in lost[1:]:
        rejected = rejected.unionByName(more)
    return {"selected": selected, "rejected": rejected}
