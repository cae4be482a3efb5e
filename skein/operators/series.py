"""Time series and monitoring aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .joins import week_close


def weekly_change(points: DataFrame, start: Column, end: Column, unit: Column, key: str = "key", day: str = "day", value: str = "value") -> DataFrame:
    closes = week_close(points, key, day, value, start, end)
    return closes.withColumn("change", V.change(F.col("previous"), F.col("latest"), unit))


def last_points(points: DataFrame, end: Column, n: int = 5, key: str = "key", day: str = "day", value: str = "value") -> DataFrame:
    """(key, values, sparkline) of the last n points up to the end."""
    w = Window.partitionBy(key).orderBy(F.desc(day))
    last = points.where(F.col(day) <= end).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(day), F.col(value)))), lambda p: p[value])
    return last.groupBy(key).agg(ordered.alias("values")).withColumn("sparkline", T.sparkline(F.col("values")))


def conflicts(points: DataFrame, key: str = "key", day: str = "day", value: str = "value") -> DataFrame:
    """(key, day, n) of days with more than one value."""
    return points.groupBy(key, day).agg(F.count_distinct(value).alias("n")).where("n > 1")


def series_health(latest: DataFrame, expected: Sequence[str], key: str = "key", day: str = "latest_day") -> DataFrame:
    """available, total and whether last days differ."""
    return latest.agg(F.count_if(F.col(day).isNotNull()).alias("available"), F.lit(len(expected)).alias("total"), (F.count_distinct(day) > 1).alias("mixed_days"))


def drops(counts: DataFrame, day: Column, runs: int = 14, least_runs: int = 3, least_normal: float = 5, ratio: float = 0.35) -> DataFrame:
    """Keys whose count today is under `ratio` of the median of the last runs of the same kind of day.

    `counts` has (day, key, n), one row a key and day; a key missing on a baseline day
    counts 0 there.
    """
    weekday = F.weekday("day") < 5
    earlier = counts.where((F.col("day") < day) & (weekday == (F.weekday(day) < 5)))
    base = earlier.select("day").distinct().orderBy(F.desc("day")).limit(runs)
    n_base = base.count()
    if n_base < least_runs:
        return counts.select("key", F.lit(0.0).alias("normal"), F.lit(0).cast("bigint").alias("today")).where("false")
    seen = earlier.join(F.broadcast(base), "day").groupBy("key").agg(F.sort_array(F.collect_list(F.col("n").cast("double"))).alias("_v"))
    padded = F.sort_array(F.concat("_v", F.array_repeat(F.lit(0.0), F.lit(n_base) - F.size("_v"))))
    middle = (F.get(padded, F.lit((n_base - 1) // 2)) + F.get(padded, F.lit(n_base // 2))) / 2
    today = counts.where(F.col("day") == day).select("key", F.col("n").alias("_today"))
    out = seen.withColumn("normal", middle).join(today, "key", "left").withColumn("today", F.coalesce("_today", F.lit(0)).cast("bigint"))
    return out.where((F.col("normal") >= least_normal) & (F.col("today") < F.col("normal") * ratio)).select("key", "normal", "today")


def missing_days(days: DataFrame, day: str, first: Column, last: Column, weekdays: Sequence[int] = (0, 1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Expected days without a delivery."""
    span = days.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("expected")).where(F.weekday("expected").isin(*weekdays))
    return span.join(days.select(F.col(day).alias("expected")).distinct(), "expected", "left_anti")


def counts_by(rows: DataFrame, keys: Sequence[tuple[str, Column]]) -> DataFrame:
    """(kind, key, n): one row contributes to a key of each kind; array columns to several."""
    pairs = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key")) for kind, c in keys]))
    return rows.select(pairs.alias("p")).where("p.key is not null").groupBy(F.col("p.kind").alias("kind"), F.col("p.key").alias("key")).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """Caught rejects and kept keeps of a labelled set."""
    return rows.agg(
        F.count_if(~expected & ~predicted).alias("caught_rejects"),
        F.count_if(~expected).alias("rejects"),
        F.count_if(expected & predicted).alias("kept_keeps"),
        F.count_if(expected).alias("keeps"),
    )
