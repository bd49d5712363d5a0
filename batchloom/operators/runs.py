"""A whole run over queued work: answers, stored results, cache, chunk and batch counters."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchloom.functions.timing import moment, seconds_between
from batchloom.operators import cache, keyed, rollups
from batchloom.operators.enrich import Work, enrich_with_cache
from batchloom.operators.skew import skew_join
from batchloom.session import staging_dir
from batchloom.sinks.exports import append_results


class Run(NamedTuple):
    results: DataFrame
    chunks: DataFrame
    batches: DataFrame
    #: of the keyed table of results that the counters are of
    version: int | None = None


def completed_chunks(chunks: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """``chunks`` with those that have results completed and their counters set; the others as they were."""
    done = rollups.chunk_run_summary(results).select(
        "batch_id", "chunk_number", *[F.col(n).alias(f"__{n}") for n in ("processed_count", "successful_count", "failed_count")])
    hit = F.col("__processed_count").isNotNull()
    set_anew = {n: F.when(hit, F.col(f"__{n}")).otherwise(F.col(n)) for n in ("processed_count", "successful_count", "failed_count")}
    begun = F.coalesce("started_at", moment(as_of))
    return chunks.join(done, ["batch_id", "chunk_number"], "left").withColumns({
        **set_anew,
        "status": F.when(hit, "completed").otherwise(F.col("status")),
        "error_message": F.when(~hit, F.col("error_message")),
        "started_at": F.when(hit, begun).otherwise(F.col("started_at")),
        "completed_at": F.when(hit, moment(as_of)).otherwise(F.col("completed_at")),
        "processing_time_seconds": F.when(hit, seconds_between(begun, moment(as_of))),
    }).select(*chunks.columns, *[n for n in ["processing_time_seconds"] if n not in chunks.columns])


def results_layout(buckets: int = 256, spread: int = 16) -> keyed.Layout:
    """One result per URL of a batch; success is never replaced by failure.

    A batch's rows go to ``spread`` buckets, so the largest batch is no bucket of its own.
    """
    return keyed.Layout(keys=("batch_id", "url_hash"), wins=("success",), watch=("chunk_number", "success"),
                        bucket=f"pmod(xxhash64(batch_id, pmod(xxhash64(url_hash), {spread})), {buckets})")


def create_results(rows: DataFrame, path: str, layout: keyed.Layout | None = None) -> int:
    """A keyed table of results (batch_id, chunk_number, url_hash, success, created_at, result_id and more) at ``path``."""
    return keyed.create(rows, path, layout or results_layout())


def replace_results(path: str, batches: DataFrame, fresh: DataFrame) -> int:
    """Store results of known batches and give the table's version.

    An answer replaces what is stored for its URL in its batch, but for a success
    that a failure would replace. Of equal fresh rows the one with the smallest
    created_at and result_id stays.
    """
    known = skew_join(fresh, batches.select("batch_id"), ["batch_id"], "left_semi", ["result_id"])
    return keyed.upsert(path, known, [F.col("created_at"), F.col("result_id")])


def chunk_deltas(changes: DataFrame) -> DataFrame:
    """batch_id, chunk_number and what the changes of a results table add to processed, successful and failed.

    A row that came counts for its chunk, the row it replaced against the chunk that had it.
    """
    former = F.col(f"{keyed.FORMER}")
    signed = F.explode(F.array(
        F.struct(F.col("chunk_number"), F.col("success"), F.lit(1).alias("sign")),
        F.struct(former["chunk_number"].alias("chunk_number"), former["success"].alias("success"), F.when(former.isNotNull(), -1).otherwise(0).alias("sign")),
    ))
    each = changes.select("batch_id", signed.alias("s")).select("batch_id", "s.*").filter("sign <> 0")
    return each.groupBy("batch_id", "chunk_number").agg(
        F.sum("sign").alias("processed"), F.sum(F.when(F.col("success"), F.col("sign")).otherwise(0)).alias("successful"),
        F.sum(F.when(~F.col("success"), F.col("sign")).otherwise(0)).alias("failed"))


def carried_on(chunks: DataFrame, deltas: DataFrame, ran: DataFrame, as_of) -> DataFrame:
    """``chunks`` with the deltas added to their counters; those that ran (batch_id, chunk_number) are completed."""
    added = {"processed_count": "processed", "successful_count": "successful", "failed_count": "failed"}
    keys = ["batch_id", "chunk_number"]
    plus = deltas.select(*keys, *[F.col(v).alias(f"__{v}") for v in added.values()])
    hit = F.col("__ran").isNotNull()
    begun = F.coalesce("started_at", moment(as_of))
    out = chunks.join(plus, keys, "left").join(ran.select(*keys).distinct().withColumn("__ran", F.lit(True)), keys, "left").withColumns({
        **{n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__{v}", F.lit(0)) for n, v in added.items()},
        "status": F.when(hit, "completed").otherwise(F.col("status")),
        "error_message": F.when(~hit, F.col("error_message")),
        "started_at": F.when(hit, begun).otherwise(F.col("started_at")),
        "completed_at": F.when(hit, moment(as_of)).otherwise(F.col("completed_at")),
    })
    return out.select(*chunks.columns)


def enrich_run(
    rows: DataFrame, batches: DataFrame, chunks: DataFrame, cache_path: str, stored_path: str, work: Work, as_of,
    slots: int | None = None, dedupe: bool = True, digits: int = 2, counted: int | None = None,
) -> Run:
    """Answer ``rows`` (batch_id, chunk_number, item_id, url), store the answers, and bring the counters up to date.

    ``cache_path`` is a cache of ``write_cache``. The answers are written once and
    read by every step.

    ``stored_path`` is a keyed table of ``create_results``: then any part of a chunk
    may run, and run again. New answers replace failures, and the counters are the
    ones of ``chunks`` and what the table's changes add to them. ``counted`` is the
    version of the table that those counters are of: the ``version`` of the run that
    made them, by default the version before this run. Where a run broke off after
    its results were stored, repeat it with the version that was counted last, and
    its changes are counted then.

    It may be a plain parquet table of results as well. That can only grow, so a run
    must be the first of whole chunks: their counters are set from its results, and
    with ``dedupe`` a run that is repeated after a break stores no result twice.
    """
    spark = rows.sparkSession
    made = enrich_with_cache(rows, cache.read_cache(spark, cache_path), work, as_of, slots)
    folder = f"{staging_dir(spark)}/run-{uuid.uuid4().hex}"
    made.results.write.parquet(folder)
    results = spark.read.schema(made.results.schema).parquet(folder)
    cache.upsert_cache(cache_path, made.cache_rows, as_of, digits)
    kept = keyed.versions(spark, stored_path)
    if kept:
        before = kept[-1] if counted is None else counted
        version = replace_results(stored_path, batches, results)
        deltas = chunk_deltas(keyed.changes(spark, stored_path, before))
        after = carried_on(chunks, deltas, results, as_of)
    else:
        version = None
        append_results(stored_path, batches, results, dedupe)
        after = completed_chunks(chunks, results, as_of)
    return Run(results, after, rollups.batch_rollup(batches, after, as_of), version)


def failed_items(spark: SparkSession, stored_path: str, batch_ids: DataFrame | None = None) -> DataFrame:
    """The work list of stored failures (batch_id, chunk_number, item_id, url), of some batches or all."""
    stored = keyed.read(spark, stored_path)
    ours = stored if batch_ids is None else stored.join(batch_ids.select("batch_id").distinct(), "batch_id", "left_semi")
    return ours.filter(~F.col("success")).select("batch_id", "chunk_number", F.col("result_id").alias("item_id"), "url")
