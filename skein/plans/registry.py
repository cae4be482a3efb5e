"""Registered queries: a function (spark, sf_dir) -> DataFrame and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: White space of the SQL's patterns (Java's has the vertical tab too), and the space characters that its trim takes off.
GAP = r"[\t\n\f\r ]+"
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: ord, title (first line), description, source, region, category and day."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.btrim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), GAP, " "), F.lit(BLANKS)).alias("title"),
        F.left("text", F.lit(500)).alias("description"),
        "text",
        "source",
        F.when(F.col("lang") == "en", "global").otherwise("korea").alias("region"),
        F.concat(F.lit("cat"), (F.col("doc_id") % 5).cast("string")).alias("category"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"),
        F.col("n_chars").alias("size"),
    )


ART = r"""art AS (SELECT doc_id AS ord, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title, left(text, 500) AS description,
text, source, CASE WHEN lang = 'en' THEN 'global' ELSE 'korea' END AS region, 'cat' || CAST(doc_id % 5 AS VARCHAR) AS category,
DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day, n_chars AS size FROM documents)"""
#: Parts of a URL, as functions.text.url_parts has them.
URL = r"""u AS (SELECT page_id, url, html, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?', 1) AS scheme,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages)"""
HOST = r"regexp_replace(lower(authority), '^www\.', '')"
EVENT = r"ev AS (SELECT event_id AS ord, ts, CAST(ts AS DATE) AS day, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries: ord, ts, day, user_id, event_type, value and the key of props."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "ts", F.to_date("ts").alias("day"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
