"""Memory across runs: last-write-wins, caps, retention, cooldowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(rows: DataFrame, identity: Sequence[str], seq: str = "seq") -> DataFrame:
    """Last row of each identity, in the place of its first."""
    w = Window.partitionBy(*identity)
    placed = rows.withColumn("first_seen", F.min(seq).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(seq))))
    return placed.where("_r = 1").drop("_r")


def capped(old: DataFrame, new: DataFrame, value: str, seq: str, cap: int) -> DataFrame:
    """Values with their age: old ones keep it, new ones follow sorted; the last `cap` stay.

    The order number is made from a sort, never from a window over everything.
    """
    fresh = new.select(value).distinct().join(old.select(value), value, "left_anti")
    both = old.select(F.lit(0).alias("_age"), F.col(seq).alias("_seq"), value).unionByName(fresh.select(F.lit(1).alias("_age"), F.lit(0).cast(dict(old.dtypes)[seq]).alias("_seq"), value))
    return both.orderBy(F.desc("_age"), F.desc("_seq"), F.desc(value)).limit(cap).select(value)


def retained(old: DataFrame, fresh: DataFrame, day: str, edition: Column, cutoff: Column) -> DataFrame:
    """This edition's rows replace its old ones; older rows stay from the cutoff on."""
    return fresh.unionByName(old.where((F.col(day) != edition) & (F.col(day) >= cutoff)))


def already_delivered(archives: Sequence[DataFrame], day: str, wanted: Column) -> bool:
    """Any archive holds an edition of the day."""
    return any(a.where(F.col(day) == wanted).limit(1).count() for a in archives)


def cooled_down(alerts: DataFrame, key: Sequence[str], ts: str, days: int = 7) -> DataFrame:
    """Alerts that are due when each sent one silences its key for `days`.

    Whether an alert is sent depends on the one sent before it, so a key's distinct
    times are folded in order; a key's alerts are first reduced to one an instant.
    """
    ordered = F.array_sort(F.collect_set(F.col(ts).cast("timestamp")))
    gap = F.make_dt_interval(F.lit(days))
    empty = F.array().cast("array<timestamp>")
    sent = F.aggregate("times", empty, lambda acc, t: F.when((F.size(acc) == 0) | (t >= F.element_at(acc, -1) + gap), F.concat(acc, F.array(t))).otherwise(acc))
    return alerts.groupBy(*key).agg(ordered.alias("times")).withColumn("sent", sent).select(*key, F.explode("sent").alias(ts))


def ledger_due(findings: DataFrame, ledger: DataFrame, key: str, now: Column, days: int = 7) -> DataFrame:
    """Findings, once a key, whose last alert is `days` old or unknown."""
    last = ledger.groupBy(F.col(key)).agg(F.max("sent_at").alias("sent_at"))
    return findings.dropDuplicates([key]).join(last, key, "left").where(F.col("sent_at").isNull() | (now >= F.col("sent_at") + F.make_dt_interval(F.lit(days)))).drop("sent_at")


def fill_forward(lines: DataFrame, group: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """Each line with the last value at or before it: headings over list lines."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def decisions(stages: Sequence[tuple[str, DataFrame]], selected: DataFrame, id: str = "ord") -> DataFrame:
    """(id, decision, stage, reason) of a run: selected rows are sent, others rejected by the first stage that names them.

    Stages are frames of (id, reason) in order.
    """
    sent = selected.select(F.col(id), F.lit("sent").alias("decision"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("reason"))
    named = None
    for n, (stage, rows) in enumerate(stages):
        own = rows.select(F.col(id), F.struct(F.lit(n).alias("n"), F.lit(stage).alias("stage"), F.col("reason").cast("string").alias("reason")).alias("why"))
        named = own if named is None else named.unionByName(own)
    if named is None:
        return sent
    lost = named.join(sent.select(id), id, "left_anti").groupBy(id).agg(F.min("why").alias("why"))
    return sent.unionByName(lost.select(F.col(id), F.lit("rejected").alias("decision"), "why.stage", "why.reason"))


def ledger_kept(ledger: DataFrame, sent: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """The ledger with this run's alerts (key, sent_at), one a key at its last time, those older than `days` dropped."""
    both = ledger.select("key", "sent_at").unionByName(sent.select("key", "sent_at"))
    return both.groupBy("key").agg(F.max("sent_at").alias("sent_at")).where(F.col("sent_at") >= now - F.make_dt_interval(F.lit(days)))


def updated_report(report: DataFrame, run_id: str, changes: dict[str, str], issues: Sequence[str] = ()) -> DataFrame:
    """(run_id, fields, issues): the report of a run with the changes merged in; that of another run is replaced."""
    spark = report.sparkSession
    new = spark.createDataFrame([(run_id, changes, list(issues))], "run_id string, fields map<string,string>, issues array<string>")
    old = report.where(F.col("run_id") == run_id).select("run_id", F.col("fields").alias("_f"), F.col("issues").alias("_i"))
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("_f", none), lambda k, v: ~F.array_contains(F.map_keys("fields"), k))
    return new.join(old, "run_id", "left").select("run_id", F.map_concat(kept, "fields").alias("fields"), F.concat(F.coalesce("_i", F.array().cast("array<string>")), "issues").alias("issues"))
