"""Session defaults and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # a model answer that repeats a key keeps the last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # sessions of a busy key are merged inside each task before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # staged data goes when nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


PARTITION_BYTES = 128 * 1024 * 1024


def builder(app_name: str = "batchloom", input_bytes: int | None = None) -> SparkSession.Builder:
    """A session builder carrying the defaults; add master and memory yourself.

    ``input_bytes``, the size of the largest table, sets the number of shuffle
    partitions so that each fits well into an executor; AQE joins small ones.
    """
    out = SparkSession.builder.appName(app_name)
    for key, value in DEFAULTS.items():
        out = out.config(key, value)
    if input_bytes:
        parts = max(200, -(-input_bytes // PARTITION_BYTES))
        out = out.config("spark.sql.shuffle.partitions", str(parts)).config(
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION_BYTES)
        ).config("spark.sql.files.maxPartitionBytes", str(PARTITION_BYTES))
    return out


def staging_dir(spark: SparkSession) -> str:
    """The folder all executors can reach for staged data and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="batchloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stage(df: DataFrame) -> DataFrame:
    """Pin down ``df`` in the shared folder, so that later reads see the same rows."""
    spark = df.sparkSession
    folder = staging_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads take the columns they need, and joins know its size.

    The folder stays; it goes with the shared folder.
    """
    folder = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
