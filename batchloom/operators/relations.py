"""Joins between batches, chunks and results: views, retention, deletion, cloning."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from batchloom import schemas
from batchloom.functions.scalars import is_active, share_pct
from batchloom.functions.timing import days_before, iso_text, moment
from batchloom.operators.paging import recent_results
from batchloom.operators.skew import skew_join


class Store(NamedTuple):
    batches: DataFrame
    chunks: DataFrame
    results: DataFrame


def batch_with_chunks(batches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every batch beside its chunks, also the batches that have none.

    The chunks are the side where a batch may be hot, so they lead an inner
    join; batches without chunks are added from a join of one row per batch.
    """
    b = batches.select("batch_id", "batch_name", F.col("status").alias("batch_status"))
    c = chunks.select("batch_id", "chunk_id", "chunk_number", F.col("status").alias("chunk_status"), "url_count")
    with_rows = skew_join(c, b, ["batch_id"], "inner", ["chunk_id"])
    without = b.join(c.select("batch_id").distinct(), "batch_id", "left_anti")
    return with_rows.unionByName(without, allowMissingColumns=True)


def older_than(days: int, as_of) -> Column:
    return F.col("created_at") < days_before(moment(as_of), days)


def in_status(*statuses: str) -> Column:
    return F.col("status").isin(*statuses)


def retention_preview(store: Store, doomed: Column) -> DataFrame:
    """How many batches, chunks and results would go; the fan-out is never built."""
    count = F.count(F.lit(1))
    c = store.chunks.groupBy("batch_id").agg(count.alias("nc"))
    r = store.results.groupBy("batch_id").agg(count.alias("nr"))
    gone = store.batches.filter(doomed).select("batch_id")
    return gone.join(c, "batch_id", "left").join(r, "batch_id", "left").agg(
        count.alias("batches_to_delete"), F.coalesce(F.sum("nc"), F.lit(0)).alias("chunks_to_delete"),
        F.coalesce(F.sum("nr"), F.lit(0)).alias("results_to_delete"),
    )


def cascade_delete(store: Store, gone: DataFrame) -> Store:
    """What is left without the batches in ``gone`` and all that belongs to them."""
    ids = gone.select("batch_id").distinct()
    return Store(
        store.batches.join(ids, "batch_id", "left_anti"),
        skew_join(store.chunks, ids, ["batch_id"], "left_anti", ["chunk_id"]),
        skew_join(store.results, ids, ["batch_id"], "left_anti", ["result_id"]),
    )


def delete_matching(store: Store, doomed: Column) -> Store:
    return cascade_delete(store, store.batches.filter(doomed))


def judge_deletion(batches: DataFrame, requests: DataFrame, force: bool = False) -> DataFrame:
    """(batch_id, accepted, reason): active batches stay unless forced."""
    known = batches.select("batch_id", "status")
    reason = F.when(F.col("status").isNull(), F.lit("not found")).when(
        is_active(F.col("status")) & F.lit(not force), F.lit("active")
    )
    judged = requests.select("batch_id").distinct().join(known, "batch_id", "left")
    return judged.select("batch_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def delete_batches(store: Store, requests: DataFrame, force: bool = False) -> tuple[Store, DataFrame]:
    outcome = judge_deletion(store.batches, requests, force)
    return cascade_delete(store, outcome.filter("accepted")), outcome


def new_chunk_id(batch_id: Column, chunk_number: Column) -> Column:
    """An id that follows from batch and number, so a repeated task gives the same one."""
    return F.md5(F.concat_ws(":", batch_id.cast("string"), chunk_number.cast("string")))


def clone_batches(store: Store, requests: DataFrame, as_of, copy_results: bool = False) -> Store:
    """Copies of batches under the ids in ``requests`` (batch_id, new_batch_id, new_name).

    All start as pending. Results go to the new chunk of the same number and
    lose analysis text, phone flag and cache flag.
    """
    batches = store.batches.join(requests, "batch_id").select(
        F.col("new_batch_id").alias("batch_id"), F.col("new_name").alias("batch_name"), "total_urls", "total_chunks",
        F.lit("pending").alias("status"), moment(as_of).alias("created_at"),
    )
    mapped = skew_join(store.chunks, requests, ["batch_id"], "inner", ["chunk_id"]).withColumn(
        "new_chunk_id", new_chunk_id(F.col("new_batch_id"), F.col("chunk_number"))
    )
    chunks = mapped.select(
        F.col("new_batch_id").alias("batch_id"), F.col("new_chunk_id").alias("chunk_id"), "chunk_number", "url_count",
        F.lit("pending").alias("status"),
    )
    if not copy_results:
        return Store(batches, chunks, store.results.limit(0))
    kept = [c for c in (
        "url", "url_hash", "success", "store_image", "text_content", "store_name", "business_contact",
        "image_description", "error_message", "processing_time_seconds",
    ) if c in store.results.columns]
    # chunk ids need not be unique across batches; a chunk holds a bounded number of results, so no key is hot
    target = mapped.select("batch_id", "chunk_id", "new_batch_id", "new_chunk_id", "chunk_number")
    results = store.results.drop("chunk_number").join(target, ["batch_id", "chunk_id"]).select(
        F.md5(F.concat_ws(":", F.col("new_chunk_id"), F.col("result_id").cast("string"))).alias("result_id"),
        F.col("new_batch_id").alias("batch_id"), F.col("new_chunk_id").alias("chunk_id"), *kept,
        moment(as_of).alias("created_at"),
    )
    return Store(batches, chunks, results)


def batch_details(store: Store, newest: int = 10) -> DataFrame:
    """Each batch with chunk counts and its newest results; at most ``newest`` are gathered."""
    def status(value: str) -> Column:
        return F.count_if(F.col("status") == value)

    c = store.chunks.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("chunks_total"),
        *[status(s).alias(f"chunks_{s}") for s in ("completed", "processing", "pending")],
    )
    latest = recent_results(store.results, newest).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "rank", "result_id", "url", "success", "store_name", "error_message"
        ))).alias("recent_results")
    )
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in
              ("chunks_total", "chunks_completed", "chunks_processing", "chunks_pending")]
    return store.batches.join(c, "batch_id", "left").join(latest, "batch_id", "left").select(
        "batch_id", "batch_name", "status", iso_text(F.col("created_at")).alias("created_at"), "total_urls",
        "processed_count", "successful_count",
        F.round(share_pct(F.col("processed_count"), F.col("total_urls")), 2).alias("progress_percentage"),
        *counts, "recent_results",
    )


def fail_chunks(chunks: DataFrame, failures: DataFrame, as_of) -> DataFrame:
    """Chunks named in ``failures`` (batch_id, chunk_id, message) fail now, with their duration where a start is known."""
    told = failures.groupBy("batch_id", "chunk_id").agg(F.min(F.coalesce("message", F.lit(""))).alias("__told"))
    hit = F.col("__told").isNotNull()
    lasted = (F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    # a row per chunk on either side, so no key is hot
    return chunks.join(told, ["batch_id", "chunk_id"], "left").withColumns({
        "status": F.when(hit, F.lit("failed")).otherwise(F.col("status")),
        "completed_at": F.when(hit, moment(as_of)).otherwise(F.col("completed_at")),
        "error_message": F.when(hit, F.col("__told")).otherwise(F.col("error_message")),
        "processing_time_seconds": F.when(hit, lasted),
    }).drop("__told")


def fail_chunks_of(chunks: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Chunks still pending or processing in the ``cleaned`` batches become failed."""
    marked = skew_join(
        chunks, cleaned.select("batch_id").distinct().withColumn("__hit", F.lit(True)), ["batch_id"], "left",
        ["chunk_id"],
    )
    hit = F.coalesce("__hit", F.lit(False)) & F.col("status").isin("pending", "processing")
    return marked.withColumns({
        "error_message": F.when(hit, F.lit(schemas.CLEANUP_CHUNK_MESSAGE)).otherwise(F.col("error_message")),
        "status": F.when(hit, F.lit("failed")).otherwise(F.col("status")),
    }).select(*chunks.columns)
