"""Roll-ups, status, health and error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.operators import rollups
from batchloom.plans.catalog import as_of, r6, register
from batchloom.plans.listings import iso

_STATUS_COUNTS = ", ".join(
    f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "processing", "completed", "failed", "retrying")
)
_SUMS = """(SELECT batch_id, CAST(SUM(processed_count) AS BIGINT) AS p, CAST(SUM(successful_count) AS BIGINT) AS s,
 CAST(SUM(failed_count) AS BIGINT) AS f, COUNT(*) FILTER (WHERE status = 'completed') AS done,
 COUNT(*) FILTER (WHERE status = 'failed') AS bad FROM f_chunks GROUP BY batch_id)"""
_SECONDS = "(epoch_us({b}) - epoch_us({a})) / 1e6"


def seconds(a: str, b: str) -> str:
    return _SECONDS.replace("{a}", a).replace("{b}", b)


@register("chunk_stats", f"SELECT batch_id, COUNT(*) AS total, {_STATUS_COUNTS} FROM f_chunks GROUP BY batch_id")
def _(m):
    return rollups.chunk_stats(m.chunks)


def _rollup_sql(settled: str, rate: str, started: str) -> str:
    return f"""
WITH j AS (SELECT b.batch_id, b.total_chunks, b.status, b.started_at, COALESCE(p, 0) AS p, COALESCE(s, 0) AS s,
 COALESCE(f, 0) AS f, COALESCE(done, 0) AS done, COALESCE(bad, 0) AS bad FROM f_batches b LEFT JOIN {_SUMS} k ON b.batch_id = k.batch_id)
SELECT batch_id, total_chunks, p AS processed_count, s AS successful_count, f AS failed_count, done AS current_chunk,
 {rate} AS success_rate,
 CASE WHEN {settled} = total_chunks AND status IN ('queued', 'processing') THEN 'completed'
  WHEN {settled} <> total_chunks AND p > 0 AND status = 'queued' THEN 'processing' ELSE status END AS status,
 CASE WHEN {settled} <> total_chunks AND p > 0 AND status = 'queued' THEN {started} ELSE started_at END AS started_at,
 CASE WHEN {settled} = total_chunks AND status IN ('queued', 'processing') THEN {{AS_OF}} END AS completed_at
FROM j"""


@register("batch_rollup", _rollup_sql("done + bad", "CASE WHEN p > 0 THEN ROUND(100.0 * s / p, 6) END",
                                      "COALESCE(started_at, {AS_OF})"))
def _(m):
    out = rollups.batch_rollup(m.batches, m.chunks, as_of())
    return out.withColumn("success_rate", r6(F.col("success_rate")))


@register("batch_rollup_completed_only", _rollup_sql("done", "CAST(NULL AS DOUBLE)", "started_at"))
def _(m):
    return rollups.batch_rollup(m.batches, m.chunks, as_of(), count_failed_as_done=False)


@register("finalize_batch", f"""
SELECT b.batch_id, CASE WHEN COALESCE(done, 0) = total_chunks THEN 'completed' ELSE 'pending' END AS outcome,
 COALESCE(done, 0) AS completed_chunks, total_chunks,
 CASE WHEN COALESCE(done, 0) = total_chunks THEN COALESCE(p, 0) END AS total_processed,
 CASE WHEN COALESCE(done, 0) = total_chunks THEN COALESCE(s, 0) END AS successful_count,
 CASE WHEN COALESCE(done, 0) = total_chunks THEN COALESCE(f, 0) END AS failed_count,
 CASE WHEN COALESCE(done, 0) = total_chunks AND COALESCE(p, 0) > 0 THEN ROUND(100.0 * s / p, 6) END AS success_rate
FROM f_batches b LEFT JOIN {_SUMS} k ON b.batch_id = k.batch_id""")
def _(m):
    out = rollups.finalize_batches(m.batches, m.chunks)
    return out.withColumn("success_rate", r6(F.col("success_rate")))


@register("chunk_completion", f"""
SELECT batch_id, chunk_number, 'completed' AS status, n AS processed_count, ok AS successful_count, n - ok AS failed_count,
 ROUND({seconds('t0', '{AS_OF}')}, 6) AS processing_time_seconds,
 ROUND({seconds('t0', '{AS_OF}')} / n + 1e-9, 6) AS average_time_per_url
FROM (SELECT batch_id, chunk_number, COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS ok, MIN(created_at) AS t0
 FROM f_results_c GROUP BY batch_id, chunk_number) t""")
def _(m):
    out = rollups.chunk_completion(m.results_c, F.col("created_at"), as_of())
    # a tenth of microseconds often ends in half a step; the engines round such halves differently
    return out.withColumns({
        "processing_time_seconds": r6(F.col("processing_time_seconds")),
        "average_time_per_url": r6(F.col("average_time_per_url") + 1e-9),
    })


@register("chunk_run_summary", """
SELECT batch_id, chunk_number, COUNT(*) AS processed_count, COUNT(*) FILTER (WHERE success) AS successful_count,
 COUNT(*) FILTER (WHERE NOT success) AS failed_count, COUNT(*) FILTER (WHERE cache_hit) AS cache_hits,
 COUNT(*) FILTER (WHERE NOT cache_hit) AS new_processed FROM f_results_c GROUP BY batch_id, chunk_number""")
def _(m):
    return rollups.chunk_run_summary(m.results_c)


@register("system_summary", """
SELECT completed AS total_batches, completed AS completed_batches, active AS active_batches,
 n AS total_urls_processed, ok AS successful_urls, ROUND(100.0 * ok / GREATEST(n, 1), 6) AS overall_success_rate
FROM (SELECT COUNT(*) FILTER (WHERE status = 'completed') AS completed,
  COUNT(*) FILTER (WHERE status IN ('pending', 'queued', 'processing')) AS active FROM f_batches) b,
 (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS ok FROM f_results) r""")
def _(m):
    out = rollups.system_summary(m.batches, m.results)
    return out.withColumn("overall_success_rate", r6(F.col("overall_success_rate")))


@register("export_statistics", """
SELECT n AS total_results_available, ok AS successful_results_available, nb AS total_batches, t AS total_urls_processed,
 s AS total_successful_urls, CAST(1000000 AS INT) AS max_export_size
FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS ok FROM f_results) r,
 (SELECT COUNT(*) AS nb, CAST(SUM(total_urls) AS BIGINT) AS t, CAST(SUM(successful_count) AS BIGINT) AS s FROM f_batches) b""")
def _(m):
    return rollups.export_statistics(m.batches, m.results)


@register("export_summary", """
SELECT b.batch_id, batch_name, status, COALESCE(n, 0) AS total_results, COALESCE(ok, 0) AS successful_results,
 COALESCE(n, 0) - COALESCE(ok, 0) AS failed_results,
 ROUND(100.0 * COALESCE(ok, 0) / GREATEST(COALESCE(n, 0), 1), 6) AS success_rate,
 ROUND(COALESCE(n, 0) * 200 / 1048576.0, 2) AS csv_mb, ROUND(COALESCE(n, 0) * 400 / 1048576.0, 2) AS json_mb,
 ROUND(COALESCE(n, 0) * 150 / 1048576.0, 2) AS xlsx_mb
FROM f_batches b LEFT JOIN (SELECT batch_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS ok FROM f_results
 GROUP BY batch_id) r ON b.batch_id = r.batch_id""")
def _(m):
    out = rollups.export_summary(m.batches, m.results)
    return out.withColumn("success_rate", r6(F.col("success_rate")))


@register("health_score", f"""
WITH j AS (
 SELECT b.batch_id, b.status, total_urls, created_at, COALESCE(c.n, 0) AS nc, COALESCE(c.done, 0) AS done,
  COALESCE(c.bad, 0) AS bad, COALESCE(r.n, 0) AS nr, COALESCE(r.ok, 0) AS ok, {seconds('created_at', '{AS_OF}')} / 3600 AS age
 FROM f_batches b
 LEFT JOIN (SELECT batch_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'completed') AS done,
  COUNT(*) FILTER (WHERE status = 'failed') AS bad FROM f_chunks GROUP BY batch_id) c ON b.batch_id = c.batch_id
 LEFT JOIN (SELECT batch_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS ok FROM f_results GROUP BY batch_id) r
  ON b.batch_id = r.batch_id)
SELECT batch_id, status, total_urls, nc AS total_chunks, done AS completed_chunks, bad AS failed_chunks,
 nr AS processed_urls, ok AS successful_urls,
 ROUND(GREATEST(0.0, LEAST(100.0, 100.0
  - CASE WHEN nc > 0 THEN CAST(bad AS DOUBLE) / nc * 30.0 ELSE 0.0 END
  - CASE WHEN status IN ('processing', 'queued') AND age > 24 THEN LEAST(20.0, age - 24) ELSE 0.0 END
  - CASE WHEN nr > 0 AND CAST(ok AS DOUBLE) / nr < 0.8 THEN (CAST(0.8 AS DOUBLE) - CAST(ok AS DOUBLE) / nr) * 50.0 ELSE 0.0 END)), 1) AS health_score,
 ROUND(CAST(ok AS DOUBLE) / GREATEST(nr, 1), 3) AS success_rate, ROUND(CAST(done AS DOUBLE) / GREATEST(nc, 1), 3) AS completion_rate,
 ROUND(age, 6) AS age_hours,
 concat_ws('; ', CASE WHEN bad > 0 THEN CAST(bad AS STRING) || ' failed chunks' END,
  CASE WHEN status = 'processing' AND age > 24 THEN printf('Processing for %.1f hours', age) END,
  CASE WHEN nr > 0 AND CAST(ok AS DOUBLE) / nr < 0.5 THEN printf('Low success rate (%.1f%%)', 100.0 * ok / nr) END) AS issues,
 concat_ws('; ', CASE WHEN bad > 0 THEN 'Consider resetting failed chunks' END,
  CASE WHEN status = 'processing' AND age > 24 THEN 'Consider force restart or cancellation' END,
  CASE WHEN nr > 0 AND CAST(ok AS DOUBLE) / nr < 0.5 THEN 'Check API configuration and URL quality' END) AS recommendations
FROM j""")
def _(m):
    out = rollups.health_score(m.batches, m.chunks, m.results, as_of())
    return out.withColumns({
        "age_hours": r6(F.col("age_hours")), "issues": F.concat_ws("; ", "issues"),
        "recommendations": F.concat_ws("; ", "recommendations"),
    })


_SPLIT = "split_part(error_message, ':', 1)"


@register("error_patterns", f"""
SELECT batch_id, source, pattern, COUNT(*) AS n FROM (
 SELECT batch_id, 'url' AS source, {_SPLIT} AS pattern FROM f_results WHERE NOT success AND COALESCE(error_message, '') <> ''
 UNION ALL
 SELECT batch_id, 'chunk', {_SPLIT} FROM f_chunks WHERE status = 'failed' AND COALESCE(error_message, '') <> '') t
GROUP BY batch_id, source, pattern""")
def _(m):
    return rollups.error_patterns(m.results, m.chunks)


@register("error_report", f"""
SELECT COALESCE(r.batch_id, c.batch_id) AS batch_id, COALESCE(n, 0) AS total_failed_urls, COALESCE(k, 0) AS total_failed_chunks,
 concat_ws('; ', CASE WHEN bad_key THEN 'Check API key configuration' END,
  CASE WHEN slow THEN 'Consider increasing timeout settings' END,
  CASE WHEN COALESCE(n, 0) > 0 THEN 'High failure rate - check URL quality' END) AS recommendations
FROM (SELECT batch_id, COUNT(*) AS n, bool_or({_SPLIT} LIKE '%API key not valid%') AS bad_key,
  bool_or(LOWER({_SPLIT}) LIKE '%timeout%') AS slow FROM f_results WHERE NOT success GROUP BY batch_id) r
FULL JOIN (SELECT batch_id, COUNT(*) AS k FROM f_chunks WHERE status = 'failed' GROUP BY batch_id) c ON r.batch_id = c.batch_id""")
def _(m):
    out = rollups.error_report(m.results, m.chunks)
    return out.withColumn("recommendations", F.concat_ws("; ", "recommendations"))


@register("avg_processing_time", """
SELECT batch_id, ROUND(COALESCE(SUM(processing_time_seconds), 0) / COUNT(*), 6) AS avg_processing_time
FROM f_results GROUP BY batch_id""")
def _(m):
    out = rollups.avg_processing_time(m.results)
    return out.withColumn("avg_processing_time", r6(F.col("avg_processing_time")))


@register("status_breakdown", "SELECT status, COUNT(*) AS count FROM f_batches GROUP BY status")
def _(m):
    return rollups.status_breakdown(m.batches)


@register("table_counts", """
SELECT 'batches' AS table_name, COUNT(*) AS count FROM f_batches UNION ALL SELECT 'chunks', COUNT(*) FROM f_chunks
UNION ALL SELECT 'results', COUNT(*) FROM f_results""")
def _(m):
    return rollups.table_counts(batches=m.batches, chunks=m.chunks, results=m.results)


@register("union_counts", """
SELECT 'jobs' AS table_name, COUNT(*) AS count FROM f_jobs UNION ALL SELECT 'cache', COUNT(*) FROM f_cache""")
def _(m):
    return rollups.table_counts(jobs=m.jobs, cache=m.cache)


@register("data_age", f"""
SELECT MIN(created_at) AS oldest_record, MAX(created_at) AS newest_record,
 CAST(FLOOR({seconds('MIN(created_at)', '{AS_OF}')} / 86400) AS BIGINT) AS days_oldest FROM f_batches""")
def _(m):
    return rollups.data_age(m.batches, as_of())


@register("daily_growth", """
SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS batches_created,
 COUNT(*) FILTER (WHERE status = 'completed') AS batches_completed
FROM f_batches WHERE created_at >= {AS_OF} - INTERVAL '30' DAY GROUP BY CAST(created_at AS DATE)""")
def _(m):
    return rollups.daily_growth(m.batches, as_of())


@register("oldest_batch", """
SELECT batch_id, batch_name, created_at FROM f_batches ORDER BY created_at ASC NULLS LAST, batch_id LIMIT 1""")
def _(m):
    return rollups.oldest_batch(m.batches)


_MIN = seconds("started_at", "{AS_OF}") + " / 60"
_RATE = f"CASE WHEN processed_count <> 0 AND {_MIN} >= 1 THEN processed_count / ({_MIN}) ELSE 0.0 END"
_TIMED = f"""(SELECT *, {_RATE} AS rate, COALESCE({_MIN}, 0.0) AS minutes FROM f_batches)"""
_LEFT = "(total_urls - processed_count) / rate"
_STATS = f"(SELECT batch_id, COUNT(*) AS total, {_STATUS_COUNTS} FROM f_chunks GROUP BY batch_id)"
_CURRENT = """CASE WHEN COALESCE(k.completed, 0) > 0 THEN k.completed WHEN COALESCE(k.processing, 0) > 0 THEN 1 ELSE 0 END"""
_PROGRESS = "ROUND(CASE WHEN total_urls > 0 THEN 100.0 * processed_count / total_urls ELSE 0 END, 2)"


@register("batch_status", f"""
SELECT b.batch_id, batch_name, b.status, b.status IN ('pending', 'queued', 'processing') AS is_active, total_urls,
 processed_count, successful_count, failed_count, {_PROGRESS} AS progress_percentage,
 ROUND(rate, 6) AS processing_rate, ROUND(minutes, 6) AS elapsed_minutes,
 CASE WHEN rate > 0 THEN ROUND({_LEFT}, 6) END AS remaining_minutes,
 CASE WHEN rate > 0 THEN date_trunc('second', {{AS_OF}} + to_microseconds(CAST(ROUND({_LEFT} * 60000000) AS BIGINT))) END AS estimated_completion,
 ROUND(CASE WHEN processed_count > 0 THEN 100.0 * successful_count / processed_count ELSE 0 END, 6) AS success_rate,
 ROUND(CASE WHEN processed_count > 0 AND minutes > 0 THEN minutes * 60 / processed_count ELSE 0 END, 6) AS avg_seconds_per_url,
 {_CURRENT} AS current_chunk, total_chunks, COALESCE(k.total, 0) AS chunks_total, COALESCE(k.pending, 0) AS chunks_pending,
 COALESCE(k.processing, 0) AS chunks_processing, COALESCE(k.completed, 0) AS chunks_completed,
 COALESCE(k.failed, 0) AS chunks_failed, COALESCE(k.retrying, 0) AS chunks_retrying,
 CAST(COALESCE(e.n, 0) AS INT) AS n_recent_errors, e.msgs AS recent_errors,
 {iso('created_at')} AS created_at, {iso('started_at')} AS started_at
FROM {_TIMED} b LEFT JOIN {_STATS} k ON b.batch_id = k.batch_id
LEFT JOIN (SELECT batch_id, COUNT(*) AS n, string_agg(url || ' ' || error_message, '; ' ORDER BY rank) AS msgs FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY created_at DESC NULLS FIRST, result_id) AS rank
 FROM f_results WHERE NOT success AND error_message IS NOT NULL) t WHERE rank <= 5 GROUP BY batch_id) e ON b.batch_id = e.batch_id""")
def _(m):
    out = rollups.batch_status(m.batches, m.chunks, m.results, as_of())
    rounded = ["processing_rate", "elapsed_minutes", "remaining_minutes", "success_rate", "avg_seconds_per_url"]
    told = F.array_join(F.transform("recent_errors", lambda e: F.concat(e.url, F.lit(" "), e.error_message)), "; ")
    return out.withColumns({c: r6(F.col(c)) for c in rounded}).withColumns({
        "recent_errors": told,
        "estimated_completion": F.date_trunc("second", "estimated_completion").cast("timestamp_ntz"),
    })


@register("batch_progress", f"""
SELECT b.batch_id, b.status, {_PROGRESS} AS progress_percentage, processed_count, total_urls, successful_count, failed_count,
 {_CURRENT} AS current_chunk, total_chunks,
 CASE WHEN rate > 0 THEN date_trunc('second', {{AS_OF}} + to_microseconds(CAST(ROUND({_LEFT} * 60000000) AS BIGINT))) END AS estimated_completion,
 ROUND(rate, 6) AS processing_rate_per_minute, b.status IN ('pending', 'queued', 'processing') AS is_active,
 CAST(CASE WHEN b.status NOT IN ('pending', 'queued', 'processing') THEN 30 WHEN {_PROGRESS} < 10 THEN 5
  WHEN {_PROGRESS} < 50 THEN 10 WHEN {_PROGRESS} < 90 THEN 15 ELSE 5 END AS INT) AS poll_seconds
FROM {_TIMED} b LEFT JOIN {_STATS} k ON b.batch_id = k.batch_id""")
def _(m):
    out = rollups.batch_progress(m.batches, m.chunks, as_of())
    return out.withColumns({
        "processing_rate_per_minute": r6(F.col("processing_rate_per_minute")),
        "estimated_completion": F.date_trunc("second", "estimated_completion").cast("timestamp_ntz"),
    })
