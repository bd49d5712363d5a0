"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from batchloom import files
from batchloom.session import staging_dir

PIECE = 1 << 22  # bytes of a text that are cut into words at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: the folder of the tables that go when ``settled`` is done
_passing: ContextVar[str | None] = ContextVar("passing", default=None)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{_passing.get() or staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its measured size decides whether joins broadcast it."""
    folder = _new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def settled(spark: SparkSession, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """What ``made()`` gives as a Parquet table; the tables it stores on its way are removed then, also if it fails."""
    folder, passing = _new_folder(spark, name), _new_folder(spark, "passing")
    token = _passing.set(passing)
    try:
        made().write.parquet(folder)
    finally:
        _passing.reset(token)
        files.remove(spark, passing)
    return spark.read.parquet(folder)


def pieces(data: bytes, gap: bytes = b" ", size: int = PIECE) -> Iterator[bytes]:
    """Consecutive pieces of ``data`` of about ``size`` bytes, cut at ``gap``."""
    at = 0
    while at < len(data):
        end = data.find(gap, at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def kept_where(df: DataFrame, text: str, keep: Callable[[], Callable[[list], Iterable[bool]]]) -> DataFrame:
    """The rows whose text ``keep()(texts)`` is true for; ``keep`` runs once in each task."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = keep()
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, rows: int | None = None,
             per_slice: int = 50_000) -> DataFrame:
    """Number the rows of each key from 0, in an order of its own that repeats.

    Rows are dealt to slices by a hash of ``order``, slices are counted, and rows
    are numbered inside their slice, after all slices before it. A key with most
    of the rows is thus spread over many tasks. Rows equal in ``order`` share a
    slice and get their numbers in no fixed order among themselves.
    """
    total = df.count() if rows is None else rows
    slices = max(1, total // per_slice)
    cut = df.withColumns({
        "__key": F.struct(*keys) if keys else F.lit(0),
        "__slice": F.pmod(F.xxhash64(*order), F.lit(slices)),
    })
    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__key", "__slice").agg(F.count("*").alias("__n")).select(
        "__key", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__key", "__slice").orderBy(*order)
    return cut.withColumn("__at", F.row_number().over(inside)).join(starts, ["__key", "__slice"]).select(
        *df.columns, (F.col("__start") + F.col("__at") - 1).alias(name))
