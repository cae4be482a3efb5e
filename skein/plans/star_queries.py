"""Streams, and extensions over the star schema: operators that Spark gives and the surveyed system lacks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..session import ensure_checkpoint_dir
from ..streaming import streams
from .registry import query, table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, in one batch."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _checkpoint(spark: SparkSession) -> str:
    """A folder of the run in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{shared}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (user, type) of a stream; the watermark spans the whole table here."""
    once = streams.dedup(_stream(spark, sf_dir), ["user_id", "event_type"], late="60 days")
    out = streams.run_available(once.select("user_id", "event_type"), f"dedup_{uuid.uuid4().hex}", _checkpoint(spark))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(epoch(date_trunc('week', ts))) AS BIGINT) AS week_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = streams.weekly_counts(_stream(spark, sf_dir), ["event_type"])
    out = streams.run_available(weekly, f"week_{uuid.uuid4().hex}", _checkpoint(spark), "complete")
    return out.select(F.col("week.start").cast("bigint").alias("week_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = streams.sessions(_stream(spark, sf_dir), "user_id")
    out = streams.run_available(own, f"session_{uuid.uuid4().hex}", _checkpoint(spark), "complete")
    return out.select("user_id", F.col("session.start").cast("bigint").alias("session_start"), "n")


@query("SELECT e.event_id FROM events e WHERE CAST(e.ts AS DATE) >= DATE '2024-01-20' AND NOT EXISTS (SELECT 1 FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'purchase' AND CAST(m.ts AS DATE) < DATE '2024-01-20' AND CAST(m.ts AS DATE) BETWEEN CAST(e.ts AS DATE) - 7 AND CAST(e.ts AS DATE) - 1)")
def stream_memory_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    memory = table(spark, sf_dir, "events").withColumn("day", day).where("event_type = 'purchase' AND day < DATE '2024-01-20'")
    new = _stream(spark, sf_dir).withColumn("day", day).where("day >= DATE '2024-01-20'")
    out = streams.unseen(new, memory, "user_id", "day").select("event_id")
    return streams.run_available(out, f"memory_{uuid.uuid4().hex}", _checkpoint(spark))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_idempotent_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows land once through foreachBatch: the second run has lost its progress and delivers all batches again."""
    at = _checkpoint(spark)
    sink = streams.deliver_batches(f"{at}/rows", "event_id")
    for attempt in range(2):
        run = _stream(spark, sf_dir).writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/progress{attempt}").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT c_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 20")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("r"), 2).alias("revenue"))
    known = joined.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return known.orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("SELECT coalesce(event_type, 'all') AS event_type, coalesce(CAST(CAST(ts AS DATE) AS VARCHAR), 'all') AS day, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(ts AS DATE))")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"))
    return rows.cube("event_type", "day").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit("all")).alias("day"), "n")


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    return out.select(F.coalesce("flag", F.lit("all")).alias("flag"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL")
def semi_anti_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    same = F.col("l_orderkey") == F.col("o_orderkey")
    kept = orders.join(lines.where("l_discount > 0.05"), same, "left_semi").join(lines.where("l_returnflag = 'R'"), same, "left_anti")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT p_partkey AS k, p_retailprice AS lo, p_retailprice + 0.05 AS hi FROM part) SELECT k, count(*) AS n FROM r JOIN part ON part.p_retailprice BETWEEN lo AND hi GROUP BY k")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ranges = part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 0.05).alias("hi"))
    met = J.range_join(part.select("p_retailprice"), ranges, F.col("p_retailprice"), F.col("lo"), F.col("hi"), 1.0)
    return met.groupBy("k").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT ON (user_id, ts) user_id, ts, value FROM events WHERE event_type = 'purchase' ORDER BY user_id, ts, event_id DESC), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
SELECT e.event_id, p.value FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    prices = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    asked = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return J.asof_join(asked, prices, "user_id", "ts", "value").select("event_id", "value")


@query("(SELECT c_nationkey AS n FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def set_ops_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))
    return c.intersectAll(s).unionAll(c.exceptAll(s))


@query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median_price"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def registry_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("b"))
    nations = table(spark, sf_dir, "nation").join(J.small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return sums.join(J.small(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "customers", F.round("b", 2).alias("balance"))
