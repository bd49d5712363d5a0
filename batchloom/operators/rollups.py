"""Roll-ups of results and chunks to batches, and the health and error reports on them.

Every group key here may be hot: all aggregates have partial forms, so a batch
with most of the rows is reduced inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from batchloom import schemas
from batchloom.functions import scalars
from batchloom.functions.timing import iso_text, minutes_between, moment, seconds_between
from batchloom.operators.paging import recent_errors

# Weights and bars of the health score, texts of the reports.
FAILED_CHUNK_WEIGHT, STUCK_CAP, STUCK_HOURS = 30.0, 20.0, 24.0
LOW_RATE, LOW_RATE_WEIGHT, POOR_RATE = 0.8, 50.0, 0.5
ADVICE_CHUNKS = "Consider resetting failed chunks"
ADVICE_STUCK = "Consider force restart or cancellation"
ADVICE_RATE = "Check API configuration and URL quality"
ADVICE_KEY = "Check API key configuration"
ADVICE_TIMEOUT = "Consider increasing timeout settings"
ADVICE_FAILURES = "High failure rate - check URL quality"


def _n() -> Column:
    return F.count(F.lit(1))


def _status(value: str) -> Column:
    return F.count_if(F.col("status") == value)


def _sum0(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("batch_id").agg(
        _n().alias("total"), *[_status(s).alias(s) for s in schemas.CHUNK_STATUSES]
    )


def _chunk_sums(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("batch_id").agg(
        _sum0("processed_count").alias("sum_processed"), _sum0("successful_count").alias("sum_successful"),
        _sum0("failed_count").alias("sum_failed"),
        _status("completed").alias("completed_chunks"), _status("failed").alias("failed_chunks"),
    )


def batch_rollup(batches: DataFrame, chunks: DataFrame, as_of, count_failed_as_done: bool = True) -> DataFrame:
    """New counters and status of every batch from its chunks.

    With ``count_failed_as_done`` a failed chunk counts as done and the success
    rate is set; without, a batch completes only when all chunks completed.
    """
    joined = batches.join(_chunk_sums(chunks), "batch_id", "left")
    processed, completed, failed = _or0("sum_processed"), _or0("completed_chunks"), _or0("failed_chunks")
    settled = completed + failed if count_failed_as_done else completed
    done = settled == F.col("total_chunks")
    running = F.col("status").isin("queued", "processing")
    starts = ~done & (processed > 0) & (F.col("status") == "queued")
    rate = F.when(processed > 0, _or0("sum_successful") * F.lit(100.0) / processed)
    # where the batches carry these columns, values that are not set anew stay
    old_rate = F.col("success_rate") if "success_rate" in batches.columns else F.lit(None).cast("double")
    old_end = F.col("completed_at") if "completed_at" in batches.columns else F.lit(None).cast("timestamp_ntz")
    started = F.coalesce("started_at", moment(as_of)) if count_failed_as_done else F.col("started_at")
    return joined.select(
        "batch_id", "total_chunks",
        processed.alias("processed_count"), _or0("sum_successful").alias("successful_count"),
        _or0("sum_failed").alias("failed_count"), completed.alias("current_chunk"),
        (F.coalesce(rate, old_rate) if count_failed_as_done else old_rate).alias("success_rate"),
        F.when(done & running, "completed").when(starts, "processing").otherwise(F.col("status")).alias("status"),
        F.when(starts, started).otherwise(F.col("started_at")).alias("started_at"),
        F.when(done & running, moment(as_of)).otherwise(old_end).alias("completed_at"),
    )


def finalize_batches(batches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Final sums of the batches whose chunks all completed; ``pending`` for the others."""
    joined = batches.select("batch_id", "total_chunks").join(_chunk_sums(chunks), "batch_id", "left")
    completed = _or0("completed_chunks")
    done = completed == F.col("total_chunks")
    processed = _or0("sum_processed")
    return joined.select(
        "batch_id", F.when(done, "completed").otherwise("pending").alias("outcome"),
        completed.alias("completed_chunks"), "total_chunks",
        F.when(done, processed).alias("total_processed"),
        F.when(done, _or0("sum_successful")).alias("successful_count"),
        F.when(done, _or0("sum_failed")).alias("failed_count"),
        F.when(done & (processed > 0), _or0("sum_successful") * F.lit(100.0) / processed).alias("success_rate"),
    )


def chunk_completion(results: DataFrame, started: Column, as_of) -> DataFrame:
    """Counters of each chunk from its results; ``started`` is the chunk's start among them."""
    done = results.groupBy("batch_id", "chunk_number").agg(
        _n().alias("processed_count"), F.count_if("success").alias("successful_count"), F.min(started).alias("begun")
    )
    seconds = seconds_between(F.col("begun"), moment(as_of))
    return done.select(
        "batch_id", "chunk_number", F.lit("completed").alias("status"), "processed_count", "successful_count",
        (F.col("processed_count") - F.col("successful_count")).alias("failed_count"),
        seconds.alias("processing_time_seconds"), (seconds / F.col("processed_count")).alias("average_time_per_url"),
    )


def chunk_run_summary(results: DataFrame) -> DataFrame:
    hits = F.count_if("cache_hit")
    return results.groupBy("batch_id", "chunk_number").agg(
        _n().alias("processed_count"), F.count_if("success").alias("successful_count"),
        F.count_if(~F.col("success")).alias("failed_count"), hits.alias("cache_hits"),
        (_n() - hits).alias("new_processed"),
    )


def system_summary(batches: DataFrame, results: DataFrame) -> DataFrame:
    """One row over both tables; each is reduced to one row before they meet."""
    none = F.lit(0).cast("long")
    b = batches.agg(
        _status("completed").alias("completed_batches"),
        F.count_if(scalars.is_active(F.col("status"))).alias("active_batches"),
    ).withColumns({"total_urls_processed": none, "successful_urls": none})
    r = results.agg(_n().alias("total_urls_processed"), F.count_if("success").alias("successful_urls")).withColumns(
        {"completed_batches": none, "active_batches": none}
    )
    names = ["completed_batches", "active_batches", "total_urls_processed", "successful_urls"]
    both = b.unionByName(r).agg(*[F.sum(n).alias(n) for n in names])
    rate = F.col("successful_urls") * F.lit(100.0) / F.greatest("total_urls_processed", F.lit(1))
    return both.select(
        F.col("completed_batches").alias("total_batches"), *names, rate.alias("overall_success_rate")
    )


def export_statistics(batches: DataFrame, results: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    r_names = ["total_results_available", "successful_results_available"]
    b_names = ["total_batches", "total_urls_processed", "total_successful_urls"]
    r = results.agg(_n().alias(r_names[0]), F.count_if("success").alias(r_names[1])).withColumns(
        {n: none for n in b_names}
    )
    b = batches.agg(
        _n().alias(b_names[0]), _sum0("total_urls").alias(b_names[1]), _sum0("successful_count").alias(b_names[2])
    ).withColumns({n: none for n in r_names})
    return r.unionByName(b).agg(*[F.sum(n).alias(n) for n in r_names + b_names]).withColumn(
        "max_export_size", F.lit(schemas.MAX_EXPORT_ROWS)
    )


def _result_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("batch_id").agg(_n().alias("n_results"), F.count_if("success").alias("n_ok"))


def export_summary(batches: DataFrame, results: DataFrame) -> DataFrame:
    total, ok = _or0("n_results"), _or0("n_ok")
    return batches.join(_result_counts(results), "batch_id", "left").select(
        "batch_id", "batch_name", "status", total.alias("total_results"), ok.alias("successful_results"),
        (total - ok).alias("failed_results"),
        (ok * F.lit(100.0) / F.greatest(total, F.lit(1))).alias("success_rate"),
        *[scalars.size_estimate_mb(total, f).alias(f"{f}_mb") for f in scalars.BYTES_PER_ROW],
    )


def health_score(batches: DataFrame, chunks: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Score from 0 to 100 per batch with its metrics, issues and advice."""
    # both 1-N tables are reduced to one row per batch before any join
    c = chunks.groupBy("batch_id").agg(
        _n().alias("n_chunks"), _status("completed").alias("n_done"), _status("failed").alias("n_failed")
    )
    joined = batches.join(c, "batch_id", "left").join(_result_counts(results), "batch_id", "left")
    measured = joined.select(
        "batch_id", "status", "total_urls",
        _or0("n_chunks").alias("total_chunks"), _or0("n_done").alias("completed_chunks"),
        _or0("n_failed").alias("failed_chunks"),
        _or0("n_results").alias("processed_urls"), _or0("n_ok").alias("successful_urls"),
        (minutes_between(F.col("created_at"), moment(as_of)) / 60).alias("age_hours"),
    )
    failed, age = F.col("failed_chunks"), F.col("age_hours")
    rate = F.when(F.col("processed_urls") > 0, F.col("successful_urls") / F.col("processed_urls"))
    old = age > STUCK_HOURS
    for_chunks = F.when(F.col("total_chunks") > 0, failed / F.col("total_chunks") * FAILED_CHUNK_WEIGHT).otherwise(0.0)
    for_age = F.when(
        F.col("status").isin("processing", "queued") & old, F.least(F.lit(STUCK_CAP), age - STUCK_HOURS)
    ).otherwise(0.0)
    for_rate = F.when(rate < LOW_RATE, (F.lit(LOW_RATE) - rate) * LOW_RATE_WEIGHT).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - for_chunks - for_age - for_rate))
    stuck = (F.col("status") == "processing") & old
    return measured.select(
        "batch_id", F.round(score, 1).alias("health_score"), "status",
        "total_chunks", "completed_chunks", "failed_chunks", "total_urls", "processed_urls", "successful_urls",
        F.round(F.col("successful_urls") / F.greatest("processed_urls", F.lit(1)), 3).alias("success_rate"),
        F.round(F.col("completed_chunks") / F.greatest("total_chunks", F.lit(1)), 3).alias("completion_rate"),
        F.array_compact(F.array(
            F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" failed chunks"))),
            F.when(stuck, F.format_string("Processing for %.1f hours", age)),
            F.when(rate < POOR_RATE, F.format_string("Low success rate (%.1f%%)", rate * 100)),
        )).alias("issues"),
        F.array_compact(F.array(
            F.when(failed > 0, F.lit(ADVICE_CHUNKS)), F.when(stuck, F.lit(ADVICE_STUCK)),
            F.when(rate < POOR_RATE, F.lit(ADVICE_RATE)),
        )).alias("recommendations"),
        "age_hours",
    )


def error_patterns(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(batch, source, error class, count) of failed results and failed chunks.

    One union feeds one aggregate; the classes stay rows, as their number is open.
    """
    r = results.filter(~F.col("success")).select("batch_id", F.lit("url").alias("source"), "error_message")
    c = chunks.filter(F.col("status") == "failed").select(
        "batch_id", F.lit("chunk").alias("source"), "error_message"
    )
    told = r.unionByName(c).filter(F.coalesce("error_message", F.lit("")) != "")
    return told.groupBy("batch_id", "source", scalars.error_class(F.col("error_message")).alias("pattern")).agg(
        _n().alias("n")
    )


def error_report(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Failure totals and advice per batch; failures without a message count in the totals."""
    kind = scalars.error_class(F.col("error_message"))
    r = results.filter(~F.col("success")).groupBy("batch_id").agg(
        _n().alias("failed_urls"),
        F.max(kind.contains("API key not valid")).alias("bad_key"),
        F.max(F.lower(kind).contains("timeout")).alias("slow"),
    )
    c = chunks.filter(F.col("status") == "failed").groupBy("batch_id").agg(_n().alias("failed_chunks"))
    urls = _or0("failed_urls")
    return r.join(c, "batch_id", "full").select(
        "batch_id", urls.alias("total_failed_urls"), _or0("failed_chunks").alias("total_failed_chunks"),
        F.array_compact(F.array(
            F.when(F.col("bad_key"), F.lit(ADVICE_KEY)),
            F.when(F.col("slow"), F.lit(ADVICE_TIMEOUT)),
            # compares a number with half of itself, so any failure is enough
            F.when(urls > urls * 0.5, F.lit(ADVICE_FAILURES)),
        )).alias("recommendations"),
    )


def avg_processing_time(results: DataFrame) -> DataFrame:
    """Sum of the known times over the count of all rows, per batch."""
    return results.groupBy("batch_id").agg(
        (F.coalesce(F.sum("processing_time_seconds"), F.lit(0.0)) / _n()).alias("avg_processing_time")
    )


def status_breakdown(batches: DataFrame) -> DataFrame:
    return batches.groupBy("status").agg(_n().alias("count")).orderBy(F.desc("count"), "status")


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row counts of several tables under each other."""
    parts = [t.agg(_n().alias("count")).select(F.lit(name).alias("table_name"), "count") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_age(batches: DataFrame, as_of) -> DataFrame:
    span = batches.agg(F.min("created_at").alias("oldest_record"), F.max("created_at").alias("newest_record"))
    days = F.floor(seconds_between(F.col("oldest_record"), moment(as_of)) / 86_400)
    return span.withColumn("days_oldest", days)


def daily_growth(batches: DataFrame, as_of, days: int = 30) -> DataFrame:
    since = moment(as_of) - F.make_dt_interval(days=F.lit(days))
    return (
        batches.filter(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day"))
        .agg(_n().alias("batches_created"), _status("completed").alias("batches_completed"))
        .orderBy(F.desc("day"))
    )


def oldest_batch(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.col("created_at").asc_nulls_last(), "batch_id").limit(1).select(
        "batch_id", "batch_name", "created_at"
    )


def batch_status(batches: DataFrame, chunks: DataFrame, results: DataFrame, as_of, errors: int = 5) -> DataFrame:
    """The wide status row of every batch: progress, timing, rate, chunks and newest errors."""
    now = moment(as_of)
    # at most ``errors`` rows per batch are gathered
    latest = recent_errors(results, errors).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "rank", "url", "error_message", iso_text(F.col("created_at")).alias("created_at")
        ))).alias("recent_errors")
    )
    stats = chunk_stats(chunks).select("batch_id", *[F.col(c).alias(f"chunks_{c}") for c in
                                                     ["total", *schemas.CHUNK_STATUSES]])
    joined = batches.join(stats, "batch_id", "left").join(latest, "batch_id", "left")
    total, processed, ok = F.col("total_urls"), F.col("processed_count"), F.col("successful_count")
    rate = scalars.processing_rate(processed, F.col("started_at"), now)
    minutes = scalars.elapsed_minutes(F.col("started_at"), now)
    return joined.select(
        "batch_id", "batch_name", "status", scalars.is_active(F.col("status")).alias("is_active"),
        total.alias("total_urls"), processed.alias("processed_count"), ok.alias("successful_count"), "failed_count",
        F.round(scalars.share_pct(processed, total), 2).alias("progress_percentage"),
        rate.alias("processing_rate"), minutes.alias("elapsed_minutes"),
        scalars.remaining_minutes(total, processed, rate).alias("remaining_minutes"),
        scalars.eta(total, processed, rate, now).alias("estimated_completion"),
        scalars.share_pct(ok, processed).alias("success_rate"),
        scalars.avg_seconds_per_url(processed, minutes).alias("avg_seconds_per_url"),
        scalars.current_chunk(_or0("chunks_completed"), _or0("chunks_processing")).alias("current_chunk"),
        "total_chunks", *[_or0(f"chunks_{c}").alias(f"chunks_{c}") for c in ["total", *schemas.CHUNK_STATUSES]],
        F.coalesce(F.size("recent_errors"), F.lit(0)).alias("n_recent_errors"), "recent_errors",
        iso_text(F.col("created_at")).alias("created_at"), iso_text(F.col("started_at")).alias("started_at"),
    )


def batch_progress(batches: DataFrame, chunks: DataFrame, as_of) -> DataFrame:
    """The light form of the status: no look at the results."""
    now = moment(as_of)
    s = chunks.groupBy("batch_id").agg(_status("completed").alias("c_done"), _status("processing").alias("c_running"))
    total, processed = F.col("total_urls"), F.col("processed_count")
    rate = scalars.processing_rate(processed, F.col("started_at"), now)
    progress = F.round(scalars.share_pct(processed, total), 2)
    active = scalars.is_active(F.col("status"))
    return batches.join(s, "batch_id", "left").select(
        "batch_id", "status", progress.alias("progress_percentage"), "processed_count", "total_urls",
        "successful_count", "failed_count",
        scalars.current_chunk(_or0("c_done"), _or0("c_running")).alias("current_chunk"), "total_chunks",
        scalars.eta(total, processed, rate, now).alias("estimated_completion"),
        rate.alias("processing_rate_per_minute"), active.alias("is_active"),
        scalars.poll_interval(progress, active).alias("poll_seconds"),
    )
