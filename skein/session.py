"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Files of a slim cut for each core.  Hadoop starts two processes for each file it makes in a local folder, where it has no native library.
SLIM_FILES = 2


def build_session(app: str = "skein", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session with the settings that queries rely on (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of our own only on one machine where none is set (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if not configured and not re.match(r"local(\[|$)", context.master):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="skein-checkpoint-", dir=os.environ.get("TMPDIR")))


def _lower(spark: SparkSession, key: str, most: int) -> None:
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if own > most:
        spark.conf.set(key, str(most))


def bound_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Hold Arrow batches of this session to `most` bytes, or one row if that is longer.

    The plan reads the setting when it runs, so it stays lowered after the call.
    """
    _lower(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def bound_tasks(spark: SparkSession) -> None:
    """Hold what a task of this session keeps outside Spark's own count: joined partitions to 8 MB, batches of Parquet to 256 rows.

    All cores of an executor (or of a driver that runs alone, with Spark's default of
    1 GB) hold theirs at once.  Like the batches, the settings stay lowered after the call.
    """
    _lower(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", 8 << 20)
    _lower(spark, "spark.sql.parquet.columnarReaderBatchSize", 256)


def few_readers(df: DataFrame, each: int = 192 << 20) -> DataFrame:
    """df, read by no more tasks at once than a driver that runs alone has heap for.

    A task that reads texts from Parquet holds a row group's column, packed and unpacked, which
    no setting bounds.  Executors of a cluster are given their cores by their memory.
    """
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        return df
    most = max(1, context._jvm.java.lang.Runtime.getRuntime().maxMemory() // each)
    return df.coalesce(most) if most < context.defaultParallelism else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, *, slim: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there from now on.

    slim: rows of a few numbers, written to SLIM_FILES files a core at most, however many
    partitions the session deals out.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if slim:
        df = df.coalesce(SLIM_FILES * df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)
