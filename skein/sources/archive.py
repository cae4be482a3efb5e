"""Edition archives: tolerant reading of JSON lines, legacy text lines, and appending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import state as H

ARTICLE = "struct<category:string,region:string,title:string,title_orig:string,url:string,normalized_url:string,source:string,feed:string,date:string,editor_event_key:string,editor_score:double,importance:int,description:string,selection_score:double>"
RECORD = f"version int, ts string, edition_date string, edition_week string, article_count int, articles array<{ARTICLE}>, text string, _bad string"


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of lines (seq, value): a malformed line is one error row and stops nothing."""
    parsed = lines.where(T.nz("value").isNotNull()).withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull())
    errors = parsed.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).select("seq", F.lit("malformed").alias("error"))
    return good.select("seq", "r.*").drop("_bad"), errors


def legacy_articles(records: DataFrame) -> DataFrame:
    """Articles of records that hold only text: `*heading*` sets the category of the list lines below it."""
    lines = records.where(F.col("articles").isNull() & T.nz("text").isNotNull()).select("seq", "ts", "edition_date", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    heading = F.nullif(F.regexp_extract("raw", r"^\*(.+)\*$", 1), F.lit(""))
    filled = H.fill_forward(lines, ["seq"], "line", heading, "category")
    pattern = r"^•\s*<([^|>]+)\|([^>]*)>(?:\s*\(([^,)]*)(?:,\s*([0-9.]+))?\))?"
    part = lambda i: F.nullif(F.regexp_extract("raw", pattern, i), F.lit(""))
    return filled.where(part(1).isNotNull()).select("seq", "line", "ts", "edition_date", "category", part(1).alias("url"), part(2).alias("title"), part(3).alias("source"), part(4).alias("date"))


def read_lines(lines: DataFrame) -> DataFrame:
    """Articles of an archive's lines (seq, value): v3, v2 (time only) and legacy text, last write
    wins an identity and keeps the place of the first; seq and first_seen are (line, article)."""
    records, _ = parse_lines(lines)
    modern = records.where(F.col("articles").isNotNull()).select("seq", "ts", "edition_date", F.posexplode("articles").alias("line", "a"))
    columns = ["category", "url", "title", "source", "date"]
    one = modern.select("seq", "line", "ts", "edition_date", *[F.col(f"a.{c}").alias(c) for c in columns])
    both = one.unionByName(legacy_articles(records).select("seq", "line", "ts", "edition_date", *columns))
    day = D.edition_date(F.col("edition_date"), D.published_utc(F.col("ts")))
    named = both.withColumn("edition_date", day.cast("string")).withColumn("identity", T.article_identity(F.col("url"), F.col("title"), F.col("source")))
    # a struct orders as its fields do, however many articles a line has
    placed = named.withColumn("seq", F.struct(F.col("seq").alias("line"), F.col("line").alias("article")))
    return H.latest_wins(placed, ["identity"]).drop("line", "ts")


def read_archive(spark: SparkSession, *paths: str) -> DataFrame:
    """Archive files in the order given (recovery first): a later file's lines win.

    A line's place is (file, position in the read), so no file is numbered in one task.
    """
    lines = None
    for i, path in enumerate(paths):
        raw = spark.read.text(path).select(F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("n")).alias("seq"), "value")
        lines = raw if lines is None else lines.unionByName(raw)
    return read_lines(lines)


def append_edition(articles: DataFrame, path: str, edition: str, sent_at: str) -> None:
    """Append one record of an edition: its articles, label of the ISO week and count."""
    fields = [c for c in ("category", "region", "title", "url", "source", "editor_event_key", "editor_score", "importance") if c in articles.columns]
    day = F.lit(edition).cast("date")
    one = articles.agg(F.sort_array(F.collect_list(F.struct("ord", *fields))).alias("articles"), F.count("*").cast("int").alias("article_count"))
    record = one.select(F.lit(3).alias("version"), F.lit(sent_at).alias("ts"), F.lit(edition).alias("edition_date"), D.iso_week_label(day).alias("edition_week"), "article_count", "articles")
    record.write.mode("append").json(path)


def recent_sent(archive: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Archived articles with an event key in the days up to `day`."""
    at = F.lit(day).cast("date")
    return archive.where((T.nz("editor_event_key").isNotNull()) & F.col("edition_date").cast("date").between(F.date_sub(at, days), at))


def append_weekly(articles: DataFrame, path: str, *, first: str, last: str, sent_at: str, candidates: int, text: str, errors: Sequence[str] = ()) -> None:
    """Append one record of a weekly edition: its window, counts, market health, articles in order and text."""
    fields = [c for c in ("category", "region", "title", "url", "source", "weekly_score", "weekly_rank_reasons", "claim_status", "evidence_status") if c in articles.columns]
    one = articles.agg(F.sort_array(F.collect_list(F.struct("ord", *fields))).alias("articles"), F.count("*").cast("int").alias("article_count"))
    health = F.struct(F.lit(not errors).alias("complete"), F.array(*[F.lit(e) for e in errors]).cast("array<string>").alias("errors"))
    record = one.select(F.lit(1).alias("version"), F.lit(sent_at).alias("sent_at"), F.lit(first).alias("start_date"), F.lit(last).alias("end_date"), F.lit(candidates).alias("candidate_count"), "article_count", health.alias("market_health"), "articles", F.lit(text).alias("text"))
    record.write.mode("append").json(path)
