"""The quality monitor: run reports against deliveries and history, and which alerts are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import state as H


def deliveries(primary: DataFrame, recovery: DataFrame) -> DataFrame:
    """Both archives, one row a (run_id, ts), the recovery file's first."""
    both = recovery.withColumn("seq", F.lit(0)).unionByName(primary.withColumn("seq", F.lit(1)))
    return H.latest_wins(both, ["run_id", "ts"]).drop("seq", "first_seen")


def delivery_findings(reports: DataFrame, delivered: DataFrame) -> DataFrame:
    """(run_id, code, scope): failed runs and deliveries, and runs that claim one that no archive has."""
    runs = delivered.select("run_id").distinct().withColumn("_found", F.lit(True))
    joined = reports.join(runs, "run_id", "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("conclusion") != "success", F.lit("workflow_failed")),
            F.when(F.col("delivery") == "failed", F.lit("delivery_failed")),
            F.when((F.coalesce("delivery", F.lit("")) != "skipped") & F.col("_found").isNull(), F.lit("delivery_unverified")),
        )
    )
    return joined.select("run_id", F.explode(codes).alias("code"), F.col("kind").alias("scope"))


def weekly_review(issues: DataFrame, first: Column, last: Column, least_days: int = 3) -> DataFrame:
    """Issue codes of a week with their counts, and whether they came on three days or more."""
    week = issues.where(F.col("day").between(first, last))
    return week.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days")).withColumn("repeated", F.col("days") >= least_days)


def due(findings: DataFrame, ledger: DataFrame, now: Column, critical: tuple[str, ...] = ("workflow_failed", "delivery_failed", "delivery_unverified")) -> DataFrame:
    """Findings whose key is not cooling down; critical codes are keyed by their event."""
    key = F.concat_ws(":", "code", "scope", F.when(F.col("code").isin(*critical), F.col("run_id")))
    return H.ledger_due(findings.withColumn("alert_key", key), ledger.withColumnRenamed("key", "alert_key"), "alert_key", now)
