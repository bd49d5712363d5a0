"""How the results table lies on disk: by month, ordered inside."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from batchloom.functions.timing import moment
from batchloom.operators.filters import created_from, created_until, where

MONTH = "month"


def write_by_month(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder per month; files ordered by batch and time.

    The order takes the place of indexes: parquet statistics let a scan for one
    batch or a span of time skip most row groups. Range partitions split a month
    or a batch that holds most rows.
    """
    order = [MONTH, "batch_id", "created_at", "result_id"]
    dated = results.withColumn(MONTH, F.date_format("created_at", "yyyy-MM"))
    ranged = dated.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode(mode).partitionBy(MONTH).parquet(path)


def scan_by_month(
    spark: SparkSession, path: str, schema: T.StructType, start: str | datetime | None = None,
    end: str | datetime | None = None,
) -> DataFrame:
    """Results created from ``start`` to ``end``, both included; only their months are listed and read."""
    full = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])
    rows = spark.read.schema(full).parquet(path)
    months = [
        None if t is None else F.date_format(moment(t), "yyyy-MM") for t in (start, end)
    ]
    return where(
        rows, None if months[0] is None else F.col(MONTH) >= months[0], None if months[1] is None else F.col(MONTH) <= months[1],
        created_from(start), created_until(end),
    ).drop(MONTH)
