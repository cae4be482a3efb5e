"""The judge of a pipeline: any function of rows to verdicts, with a replay cache before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[DataFrame], DataFrame]


def rule_judge(score: str, least: float = 0.0) -> Judge:
    """Deterministic default: keeps rows of at least the score, importance by score bands."""

    def judge(rows: DataFrame) -> DataFrame:
        s = F.col(score)
        band = F.when(s >= 6, 3).when(s >= 3, 2).otherwise(1)
        return rows.select("ord", (s >= least).alias("keep"), F.col("category"), s.cast("double").alias("score"), F.lit("").alias("event_key"), band.alias("importance"))

    return judge


def cache_key(model: str, prompt: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(model), F.lit("\0"), prompt), 256), 1, 32)


def cached(rows: DataFrame, cache: DataFrame, model: str, mode: str = "replay") -> tuple[DataFrame, DataFrame]:
    """(answered, open) of rows with a prompt; in replay mode open rows are errors, live they go to the judge."""
    keyed = rows.withColumn("cache_key", cache_key(model, F.col("prompt")))
    found = keyed.join(cache.select(F.col("key").alias("cache_key"), "reply"), "cache_key", "left")
    missing = found.where("reply IS NULL").drop("reply")
    return found.where("reply IS NOT NULL"), missing.withColumn("error", F.lit("replay_miss")) if mode == "replay" else missing
