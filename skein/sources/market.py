"""Market series from raw payloads: CSV, JSON and literal rows; conflicts fail, gaps do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_points(lines: DataFrame, key: Column, value: str = "value") -> DataFrame:
    """(key, day, value) of `day,value` lines; header, blanks and the markers - and . are skipped."""
    day = F.to_date(F.try_to_timestamp(F.split_part(value, F.lit(","), F.lit(1)), F.lit("yyyy-MM-dd")))
    number = F.replace(F.trim(F.split_part(value, F.lit(","), F.lit(2))), F.lit(","), F.lit("")).try_cast("double")
    rows = lines.select(key.alias("key"), day.alias("day"), number.alias("value"))
    return rows.where("day IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")


STATISTICS = "StatisticSearch struct<list_total_count:int,row:array<struct<STAT_CODE:string,ITEM_CODE1:string,UNIT_NAME:string,TIME:string,DATA_VALUE:string>>>"


def statistic_points(replies: DataFrame, stat: str, item: str, unit: str, reply: str = "value", most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of JSON replies: code, item and unit must match, all rows must be there, values be
    positive, and one day have one value."""
    parsed = replies.select("key", F.from_json(reply, STATISTICS)["StatisticSearch"].alias("s"))
    whole = (F.size("s.row") == F.col("s.list_total_count")) & (F.col("s.list_total_count") <= most)
    truncated = parsed.where(F.coalesce(~whole, F.lit(True))).select("key", F.lit("truncated").alias("error"))
    rows = parsed.where(whole).select("key", F.explode("s.row").alias("r"))
    value = F.replace("r.DATA_VALUE", F.lit(","), F.lit("")).try_cast("double")
    fits = (F.col("r.STAT_CODE") == stat) & (F.col("r.ITEM_CODE1") == item) & (F.col("r.UNIT_NAME") == unit) & (value > 0)
    wrong = rows.where(~F.coalesce(fits, F.lit(False))).select("key", F.lit("unexpected_row").alias("error"))
    points = rows.where(fits).select("key", F.to_date(F.col("r.TIME"), "yyyyMMdd").alias("day"), value.alias("value")).distinct()
    clash = points.groupBy("key", "day").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("conflicting_values").alias("error"))
    errors = truncated.unionByName(wrong).unionByName(clash).distinct()
    return points.join(errors.select("key").distinct(), "key", "left_anti"), errors


def first_per_day(pages: DataFrame) -> DataFrame:
    """(key, day, value): of pages (page, pos) the first value of each day counts."""
    return pages.groupBy("key", "day").agg(F.min_by("value", F.struct("page", "pos")).alias("value"))


def literal_points(replies: DataFrame, key: Column, value: str = "value") -> DataFrame:
    """(key, day, value) of replies written as lists of rows [day, ..., close, ...]: rows of a number day only."""
    row = F.explode(F.regexp_extract_all(value, F.lit(r"\[\s*[\"']?(\d{8})[\"']?\s*,[^\]]*\]"), F.lit(0)))
    rows = replies.select(key.alias("key"), row.alias("r"))
    fields = F.split(F.regexp_replace("r", r"[\[\]\"'\s]", ""), ",")
    return rows.select("key", F.to_date(F.get(fields, F.lit(0)), "yyyyMMdd").alias("day"), F.get(fields, F.lit(4)).try_cast("double").alias("value")).where("value IS NOT NULL")
