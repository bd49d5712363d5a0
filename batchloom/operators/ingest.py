"""From URL rows to numbered chunks."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from batchloom import schemas
from batchloom.functions.scalars import chunk_count, default_batch_name, estimate_hours
from batchloom.functions.timing import moment
from batchloom.operators.ordering import number_rows
from batchloom.session import stored
from batchloom.sources.url_csv import scan_url_csv

# seq is unique, so a block of it holds at most this many rows
SEQ_BLOCK = 100_000


class NewBatch(NamedTuple):
    batch: DataFrame
    chunks: DataFrame
    urls: DataFrame


def dedupe_first_seen(rows: DataFrame) -> DataFrame:
    """One row per (batch, url), at its first position."""
    return rows.groupBy("batch_id", "url").agg(F.min("seq").alias("seq")).select("batch_id", "seq", "url")


def assign_chunks(rows: DataFrame, size: int = schemas.CHUNK_SIZE) -> DataFrame:
    """Number the rows of each batch by ``seq`` and cut them into chunks of ``size``."""
    block = F.floor(F.col("seq") / SEQ_BLOCK)
    numbered = number_rows(rows, ["batch_id"], [F.col("seq").asc()], "position", bucket=block)
    return numbered.withColumn("chunk_number", F.floor((F.col("position") - 1) / size).cast("int") + 1)


def chunk_rows(assigned: DataFrame, with_urls: bool = False) -> DataFrame:
    """One row per chunk; the URL list, when asked for, is as long as a chunk at most."""
    aggs = [F.count(F.lit(1)).alias("url_count")]
    if with_urls:
        listed = F.sort_array(F.collect_list(F.struct("position", "url")))
        aggs.append(F.transform(listed, lambda s: s.url).alias("urls"))
    return assigned.groupBy("batch_id", "chunk_number").agg(*aggs).withColumn("status", F.lit("pending"))


def assign_subbatches(rows: DataFrame, order: list[Column], size: int = schemas.SUB_BATCH) -> DataFrame:
    """Groups of ``min(size, n)`` rows inside each chunk. A chunk is bounded, so a window per chunk will do."""
    w = Window.partitionBy("batch_id", "chunk_number").orderBy(*order)
    return rows.withColumn("sub_batch", F.floor((F.row_number().over(w) - 1) / size).cast("int") + 1)


def batch_rows(urls: DataFrame, as_of, size: int = schemas.CHUNK_SIZE, name: str = "", keys: int = 1) -> DataFrame:
    """The pending batch rows for de-duplicated ``urls``."""
    totals = urls.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_urls"))
    return totals.select(
        "batch_id", default_batch_name(F.lit(name), moment(as_of)).alias("batch_name"), "total_urls",
        F.lit(size).alias("chunk_size"), chunk_count(F.col("total_urls"), size).alias("total_chunks"),
        F.lit("pending").alias("status"), estimate_hours(F.col("total_urls"), keys).alias("estimated_time_hours"),
        moment(as_of).alias("created_at"),
    )


def create_batch(
    spark: SparkSession, path: str, batch_id: str, as_of, name: str = "", size: int = schemas.CHUNK_SIZE,
    keys: int = 1, spanning: bool | None = None,
) -> NewBatch:
    """Read a CSV and make a pending batch with its chunks; an input without URLs is an error."""
    scanned = scan_url_csv(spark, path, spanning).withColumn("batch_id", F.lit(batch_id))
    urls = stored(dedupe_first_seen(scanned), "urls")
    if urls.isEmpty():
        raise ValueError("no valid URLs found in CSV file")
    assigned = assign_chunks(urls, size)
    # of the files only name and length are looked at
    file = spark.read.format("binaryFile").load(path).agg(
        F.min(F.element_at(F.split("path", "/"), -1)).alias("name"), F.sum("length").alias("length")
    )
    settings = {"chunk_size": size, "max_retries": schemas.MAX_RETRIES, "timeout": schemas.REQUEST_TIMEOUT}
    batch = batch_rows(urls, as_of, size, name, keys).withColumns({
        "original_filename": file.select("name").scalar(), "file_size_bytes": file.select("length").scalar(),
        "processing_config": F.lit(json.dumps(settings)),
    })
    return NewBatch(batch, chunk_rows(assigned), assigned)
