"""Streams: dedupe within a watermark, weekly windows, sessions, deadline and memory joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup(stream: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = "3 days") -> DataFrame:
    """First row of each key within the watermark; state is bounded by it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def accept(stream: DataFrame, ts: str, now: Column, ahead: str = "1 day") -> DataFrame:
    """Rows that are not too far in the future."""
    return stream.where(F.col(ts) <= now + F.expr(f"INTERVAL {ahead}"))


def weekly_counts(stream: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = "3 days", offset: str = "4 days") -> DataFrame:
    """Rows a week from Monday (local time: offset 4 days from the epoch's Thursday)."""
    week = F.window(ts, "7 days", "7 days", offset)
    return stream.withWatermark(ts, late).groupBy(week.alias("week"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours", late: str = "3 days") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("n"))


def unseen(stream: DataFrame, memory: DataFrame, key: str, day: str, days: int = 7) -> DataFrame:
    """Stream-static memory: rows whose key was not sent in the days before."""
    past = memory.select(F.col(key).alias("_k"), F.col(day).alias("_d")).distinct()
    near = F.col("_d").between(F.date_sub(F.col(day), days), F.date_sub(F.col(day), 1))
    return stream.join(past, (F.col(key) == F.col("_k")) & near, "left_anti")


def deliver_batches(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: a key lands once, in the first batch that has it.

    A batch that is run again overwrites its own folder, without the keys of the batches
    before it, and so writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates([key])
        if number:
            landed = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{path}/batch={n}" for n in range(number)]).select(key)
            once = once.join(landed, key, "left_anti")
        once.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there into files beside its progress, and read them.

    In complete mode each batch replaces the last; otherwise each adds its rows.  Nothing
    passes through the driver.
    """
    path = f"{checkpoint}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{checkpoint}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path if mode == "complete" else f"{path}/batch=*")
