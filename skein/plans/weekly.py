"""The weekly edition: a week of archived articles, grouped, scored, and selected under quotas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import clusters as C
from ..operators import rules as R
from ..operators import select as S


def weekly_edition(archive: DataFrame, as_of: Column, terms: list[tuple[str, Column, float]], *, cap: int = 21) -> DataFrame:
    """Archived articles (ord, identity, title, category, region, source, day, score) of the last whole week."""
    first, last = D.weekly_window(as_of)
    week = archive.where(F.col("day").between(first, last))
    grouped = C.elect(C.title_groups(week), ["leader"], [F.desc("day"), F.desc("score")])
    stories = grouped.groupBy("leader").agg(F.count("*").alias("weekly_story_count"), F.array_sort(F.collect_set("source")).alias("weekly_sources"), F.min("day").alias("weekly_first_seen"), F.max("day").alias("weekly_last_seen"), F.array_sort(F.collect_set("category")).alias("weekly_categories"))
    best = grouped.where("is_representative").join(stories, "leader")
    score, reasons = R.additive_score(terms)
    scored = best.withColumn("weekly_score", F.col("score") + score).withColumn("weekly_rank_reasons", reasons)
    return S.protected_cap_scaled(scored, "category", "region", F.lit(False), [F.desc("weekly_score")], cap)


def select_with_evidence(rows: DataFrame, select: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """Select, check the selected rows' claims, and select again until nothing new needs a check."""
    checked: DataFrame | None = None
    for _ in range(rounds):
        current = rows if checked is None else rows.join(checked, "ord", "left").withColumn("claim_status", F.coalesce("checked_status", "claim_status")).drop("checked_status")
        chosen = select(current)
        asked = chosen.where("claim_status = 'unchecked'")
        if not asked.limit(1).count():
            return chosen
        found = check(asked).select("ord", F.col("status").alias("checked_status"))
        checked = found if checked is None else checked.unionByName(found)
    return select(rows.join(checked, "ord", "left").withColumn("claim_status", F.coalesce("checked_status", "claim_status")).drop("checked_status"))
