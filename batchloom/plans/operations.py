"""Life cycle, job log and cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from batchloom.operators import cache, jobs, lifecycle
from batchloom.plans.catalog import as_of, r6, register
from batchloom.plans.reports import seconds
from batchloom.session import staging_dir

c = F.col
MANY = 450  # slots for the start queries, so that some requests win and some do not


def commands(m, action):
    return m.commands.filter(c("action") == action)


def asked(action: str) -> str:
    return f"(SELECT DISTINCT batch_id FROM f_commands WHERE action = '{action}')"


def outcome_sql(action: str, *refusals: tuple[str, str]) -> str:
    arms = " ".join(f"WHEN {cond} THEN '{text}'" for cond, text in refusals)
    reason = f"CASE WHEN b.status IS NULL THEN 'not found' {arms} END"
    return f"""SELECT q.batch_id, b.status AS previous_status, ({reason}) IS NULL AS accepted, {reason} AS reason
FROM {asked(action)} q LEFT JOIN f_batches b ON q.batch_id = b.batch_id"""


def changed_sql(accepted: str, values: dict[str, str], new: dict[str, str] | None = None) -> str:
    """All batches, with ``values`` on those that ``accepted`` (a list of ids) names."""
    fixed = ["batch_id", "batch_name", "status", "error_message", "created_at", "started_at", "total_urls",
             "total_chunks", "processed_count", "successful_count", "failed_count"]
    hit = f"batch_id IN {accepted}"
    cols = [f"CASE WHEN {hit} THEN {values[n]} ELSE {n} END AS {n}" if n in values else n for n in fixed]
    cols += [f"CASE WHEN {hit} THEN {v} END AS {n}" for n, v in (new or {}).items()]
    return f"SELECT {', '.join(cols)} FROM f_batches"


def ids_where(action: str, status: str) -> str:
    return f"(SELECT batch_id FROM f_batches WHERE batch_id IN {asked(action)} AND {status})"


CHUNK_COLUMNS = ["batch_id", "chunk_number", "chunk_id", "url_count", "processed_count", "successful_count",
                 "failed_count", "status", "error_message", "started_at", "completed_at"]


def chunks_sql(hit: str, values: dict[str, str], source: str = "f_chunks") -> str:
    cols = [f"CASE WHEN {hit} THEN {values[n]} ELSE {n} END AS {n}" if n in values else n for n in CHUNK_COLUMNS]
    return f"SELECT {', '.join(cols)} FROM {source}"


def admitted_sql(source: str, accepted: str) -> str:
    first = f"""(SELECT chunk_id FROM (SELECT chunk_id, ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY chunk_number) AS rn
 FROM ({source}) s WHERE status = 'pending' AND batch_id IN {accepted}) t WHERE rn <= 3)"""
    return chunks_sql(f"chunk_id IN {first}", {"status": "'processing'", "started_at": "{AS_OF}"}, f"({source}) u")


_NOT_RUNNING = "b.status NOT IN ('queued', 'processing')"
_RUNNING = "status IN ('queued', 'processing')"
_FREE = f"{MANY} - (SELECT COUNT(*) FROM f_batches WHERE {_RUNNING})"
_WINNERS = f"""(SELECT batch_id FROM (SELECT batch_id, ROW_NUMBER() OVER (ORDER BY batch_id) AS turn FROM f_batches
 WHERE status = 'pending' AND batch_id IN {asked('start')}) t WHERE turn <= {_FREE})"""


@register("admit_batches", outcome_sql(
    "start", ("b.status <> 'pending'", "not pending"), (f"b.batch_id NOT IN {_WINNERS}", "maximum concurrent batches reached")))
def _(m):
    return lifecycle.admit_batches(m.batches, commands(m, "start"), MANY)


@register("start", changed_sql(_WINNERS, {"status": "'queued'", "started_at": "{AS_OF}"}))
def _(m):
    return lifecycle.start(m.batches, m.chunks, commands(m, "start"), as_of(), MANY).batches


@register("admit_chunks", admitted_sql("SELECT * FROM f_chunks", "(SELECT batch_id FROM f_batches WHERE status = 'pending')"))
def _(m):
    accepted = m.batches.filter(c("status") == "pending").select("batch_id", F.lit(True).alias("accepted"))
    return lifecycle.admit_chunks(m.chunks, accepted, as_of())


@register("pause_outcome", outcome_sql("pause", (_NOT_RUNNING, "not running")))
def _(m):
    return lifecycle.pause(m.batches, commands(m, "pause"), as_of()).outcome


@register("pause", changed_sql(ids_where("pause", _RUNNING), {"status": "'paused'"}, {"paused_at": "{AS_OF}"}))
def _(m):
    return lifecycle.pause(m.batches, commands(m, "pause"), as_of()).batches


@register("resume_outcome", outcome_sql("resume", ("b.status <> 'paused'", "not paused")))
def _(m):
    return lifecycle.resume(m.batches, commands(m, "resume")).outcome


@register("resume", changed_sql(ids_where("resume", "status = 'paused'"), {"status": "'queued'"},
                                {"paused_at": "CAST(NULL AS TIMESTAMP)"}))
def _(m):
    return lifecycle.resume(m.batches, commands(m, "resume")).batches


@register("requeue_pending", f"SELECT * FROM f_chunks WHERE status = 'pending' AND batch_id IN {ids_where('resume', 'true')}")
def _(m):
    change = lifecycle.judge(m.batches, commands(m, "resume"))
    return lifecycle.requeue_pending(m.chunks, change)


@register("cancel_outcome", outcome_sql("cancel", ("b.status IN ('completed', 'cancelled')", "already over")))
def _(m):
    return lifecycle.cancel(m.batches, commands(m, "cancel"), as_of()).outcome


@register("cancel", changed_sql(ids_where("cancel", "status NOT IN ('completed', 'cancelled')"),
                                {"status": "'cancelled'"}, {"completed_at": "{AS_OF}"}))
def _(m):
    return lifecycle.cancel(m.batches, commands(m, "cancel"), as_of()).batches


_ZERO = {"processed_count": "0", "successful_count": "0", "failed_count": "0"}
_BLANK = {"status": "'pending'", "started_at": "NULL", "completed_at": "NULL", **_ZERO}
_RETRIED = ids_where("retry", "true")


@register("retry", changed_sql(_RETRIED, {"status": "'queued'", "started_at": "{AS_OF}", **_ZERO},
                               {"current_chunk": "CAST(0 AS BIGINT)"}))
def _(m):
    return lifecycle.retry(m.batches, m.chunks, commands(m, "retry"), as_of()).batches


@register("retry_chunks", admitted_sql(chunks_sql(f"batch_id IN {_RETRIED}", _BLANK), _RETRIED))
def _(m):
    return lifecycle.retry(m.batches, m.chunks, commands(m, "retry"), as_of()).chunks


def _counted_sql(base: str, counted: str) -> str:
    return f"""SELECT o.*, CASE WHEN accepted THEN COALESCE(n, 0) ELSE 0 END AS reset_chunks FROM ({base}) o
LEFT JOIN (SELECT batch_id, COUNT(*) FILTER (WHERE {counted}) AS n FROM f_chunks GROUP BY batch_id) k ON o.batch_id = k.batch_id"""


@register("retry_outcome", _counted_sql(outcome_sql("retry"), "true"))
def _(m):
    return lifecycle.retry(m.batches, m.chunks, commands(m, "retry"), as_of()).outcome


_FORCED = ids_where("start", "status <> 'completed'")
_FORCE_FREE = f"{MANY} - (SELECT COUNT(*) FROM f_batches WHERE {_RUNNING} AND batch_id NOT IN {_FORCED})"
_FORCE_WINNERS = f"""(SELECT batch_id FROM (SELECT batch_id, ROW_NUMBER() OVER (ORDER BY batch_id) AS turn FROM f_batches
 WHERE batch_id IN {_FORCED}) t WHERE turn <= {_FORCE_FREE})"""


@register("force_start", changed_sql(
    _FORCED, {"status": f"CASE WHEN batch_id IN {_FORCE_WINNERS} THEN 'queued' ELSE 'pending' END",
              "started_at": f"CASE WHEN batch_id IN {_FORCE_WINNERS} THEN {{AS_OF}} END", "error_message": "NULL"},
    {"paused_at": "CAST(NULL AS TIMESTAMP)"}))
def _(m):
    return lifecycle.force_start(m.batches, m.chunks, commands(m, "start"), as_of(), max_active=MANY).batches


@register("force_start_chunks", admitted_sql(
    chunks_sql(f"status <> 'completed' AND batch_id IN {_FORCED}",
               {"status": "'pending'", "started_at": "NULL", "error_message": "NULL"}), _FORCE_WINNERS))
def _(m):
    return lifecycle.force_start(m.batches, m.chunks, commands(m, "start"), as_of(), max_active=MANY).chunks


@register("force_start_outcome", _counted_sql(
    f"SELECT p.*, batch_id IN {_FORCE_WINNERS} AS started FROM ({outcome_sql('start', ('b.status = ' + repr('completed'), 'completed'))}) p",
    "status <> 'completed'"))
def _(m):
    return lifecycle.force_start(m.batches, m.chunks, commands(m, "start"), as_of(), max_active=MANY).outcome


@register("soft_delete", changed_sql(
    ids_where("cancel", "true"),
    {"status": "'cancelled'", "error_message": "'Soft deleted on 2024-01-31 00:00:00 (retention: 14 days)'"},
    {"completed_at": "{AS_OF}"}))
def _(m):
    return lifecycle.soft_delete(m.batches, commands(m, "cancel"), as_of(), 14).batches


_STUCK = "status IN ('pending', 'queued', 'processing')"


@register("reset_stuck", changed_sql(ids_where("retry", _STUCK), {"status": "'pending'", "started_at": "NULL", **_ZERO},
                                     {"completed_at": "CAST(NULL AS TIMESTAMP)", "current_chunk": "CAST(0 AS BIGINT)"}))
def _(m):
    return lifecycle.reset_stuck(m.batches, m.chunks, commands(m, "retry")).batches


@register("reset_stuck_chunks", chunks_sql(f"batch_id IN {ids_where('retry', _STUCK)}", _BLANK))
def _(m):
    return lifecycle.reset_stuck(m.batches, m.chunks, commands(m, "retry")).chunks


@register("reset_stuck_outcome", _counted_sql(outcome_sql("retry", ("b." + _STUCK.replace("IN", "NOT IN"), "not stuck")), "true"))
def _(m):
    return lifecycle.reset_stuck(m.batches, m.chunks, commands(m, "retry")).outcome


_BULK_SQL = """SELECT batch_id, action, old AS previous_status, COALESCE(new, old) AS status,
 action <> 'start' AND old IS NOT NULL AND new IS NOT NULL AS accepted,
 CASE WHEN action = 'start' THEN 'unknown action: start' WHEN old IS NULL THEN 'not found'
  WHEN new IS NULL THEN 'refused in status ' || old END AS reason
FROM (SELECT q.batch_id, q.action, b.status AS old, CASE
  WHEN q.action = 'pause' AND b.status IN ('queued', 'processing') THEN 'paused'
  WHEN q.action = 'resume' AND b.status = 'paused' THEN 'queued'
  WHEN q.action = 'cancel' AND b.status NOT IN ('completed', 'cancelled') THEN 'cancelled'
  WHEN q.action = 'retry' AND b.status IS NOT NULL THEN 'queued' END AS new
 FROM f_commands q LEFT JOIN f_batches b ON q.batch_id = b.batch_id) t"""


@register("bulk_action", _BULK_SQL)
def _(m):
    return lifecycle.bulk_action(m.batches, m.commands)


@register("bulk_outcome", f"""
SELECT action, COUNT(*) FILTER (WHERE accepted) AS successful, COUNT(*) AS requested,
 CAST(COUNT(*) FILTER (WHERE accepted) AS STRING) || '/' || CAST(COUNT(*) AS STRING) AS summary
FROM ({_BULK_SQL}) o GROUP BY action""")
def _(m):
    return lifecycle.bulk_outcome(lifecycle.bulk_action(m.batches, m.commands))


@register("command_sequences", """
WITH RECURSIVE cmds AS (SELECT user_id AS batch_id, CASE event_type WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume'
  WHEN 'purchase' THEN 'cancel' WHEN 'signup' THEN 'retry' ELSE 'start' END AS action,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (SELECT batch_id, status AS old, CAST(0 AS BIGINT) AS n, status FROM f_batches
 UNION ALL SELECT w.batch_id, w.old, c.n, CASE
   WHEN action = 'pause' AND w.status IN ('queued', 'processing') THEN 'paused' WHEN action = 'resume' AND w.status = 'paused' THEN 'queued'
   WHEN action = 'cancel' AND w.status NOT IN ('completed', 'cancelled') THEN 'cancelled' WHEN action = 'retry' THEN 'queued'
   ELSE w.status END FROM walk w JOIN cmds c ON w.batch_id = c.batch_id AND c.n = w.n + 1)
SELECT batch_id, old AS previous_status, status, n AS commands FROM walk w
WHERE n = (SELECT MAX(n) FROM walk x WHERE x.batch_id = w.batch_id)""")
def _(m):
    kinds = {"view": "pause", "click": "resume", "purchase": "cancel", "signup": "retry"}
    action = F.lit("start")
    for event, name in kinds.items():
        action = F.when(c("event_type") == event, name).otherwise(action)
    asked_for = m.table("events").select(c("user_id").alias("batch_id"), c("event_id").alias("seq"), action.alias("action"))
    return lifecycle.run_sequences(m.batches, asked_for)


@register("stuck_batches", f"""
SELECT batch_id, batch_name, status, total_urls, processed_count,
 ROUND(CASE WHEN total_urls > 0 THEN 100.0 * processed_count / total_urls ELSE 0 END, 6) AS progress_percentage, started_at, created_at
FROM f_batches WHERE {_RUNNING} AND {seconds('started_at', '{AS_OF}')} > 3600""")
def _(m):
    out = lifecycle.stuck_batches(m.batches, as_of())
    return out.withColumn("progress_percentage", r6(c("progress_percentage")))


@register("cleanup_stuck", f"""
SELECT batch_id, batch_name, CASE WHEN hit THEN 'cancelled' ELSE status END AS status,
 CASE WHEN hit THEN 'Cleaned up by admin - stuck for too long' ELSE error_message END AS error_message, created_at, started_at,
 total_urls, total_chunks, processed_count, successful_count, failed_count
FROM (SELECT *, {_STUCK} AND created_at < {{AS_OF}} - INTERVAL '24' HOUR AS hit FROM f_batches) t""")
def _(m):
    return lifecycle.cleanup_stuck(m.batches, m.chunks, as_of()).batches


@register("requeue_failed_results", """
SELECT url, batch_id, batch_id * 1000000000 + chunk_number AS chunk_id, true AS retry, result_id AS original_result_id
FROM f_results_c WHERE NOT success""")
def _(m):
    rows = m.results_c.withColumn("chunk_id", c("batch_id") * 1_000_000_000 + c("chunk_number"))
    return lifecycle.requeue_failed_results(rows)


# --- job log --------------------------------------------------------------------

@register("queue_stats", "SELECT " + ", ".join(
    f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "processing", "completed", "failed", "retrying")
) + " FROM f_jobs")
def _(m):
    return jobs.queue_stats(m.jobs)


@register("queue_stats_folded", """
SELECT COUNT(*) FILTER (WHERE status NOT IN ('processing', 'completed', 'failed')) AS pending,
 COUNT(*) FILTER (WHERE status = 'processing') AS processing, COUNT(*) FILTER (WHERE status = 'completed') AS completed,
 COUNT(*) FILTER (WHERE status = 'failed') AS failed FROM f_jobs""")
def _(m):
    return jobs.queue_stats_folded(m.jobs)


@register("worker_activity", """
SELECT worker_id, COUNT(*) AS jobs, COUNT(*) FILTER (WHERE status = 'processing') AS processing_jobs FROM f_jobs GROUP BY worker_id""")
def _(m):
    return jobs.worker_activity(m.jobs)


@register("dispatch_order", """
SELECT * FROM f_jobs WHERE status = 'pending' ORDER BY priority DESC, job_id DESC LIMIT 100""")
def _(m):
    return jobs.dispatch_order(m.jobs, 100)


@register("job_lease", """
WITH free AS (SELECT 'w' || CAST(c_custkey AS STRING) AS w, ROW_NUMBER() OVER (ORDER BY 'w' || CAST(c_custkey AS STRING)) AS n
 FROM customer WHERE c_custkey % 2 = 0),
queue AS (SELECT job_id, ROW_NUMBER() OVER (ORDER BY priority DESC, job_id DESC) AS n FROM f_jobs WHERE status = 'pending')
SELECT j.job_id, job_type, CASE WHEN w IS NOT NULL THEN 'processing' ELSE status END AS status, priority, retry_count, max_retries, batch_id,
 COALESCE(w, worker_id) AS worker_id, created_at, CASE WHEN w IS NOT NULL THEN {AS_OF} END AS started_at
FROM f_jobs j LEFT JOIN (SELECT job_id, w FROM queue JOIN free USING (n)) t ON j.job_id = t.job_id""")
def _(m):
    free = m.table("customer").filter(c("c_custkey") % 2 == 0).select(F.concat(F.lit("w"), c("c_custkey").cast("string")).alias("worker_id"))
    return jobs.lease(m.jobs, free, as_of())


@register("queue_advice", """
SELECT *, CASE WHEN total_stuck > 0 THEN 'Remove ' || total_stuck || ' jobs with invalid type ''process_chunk'''
 WHEN pending + processing + retrying + completed + failed = 0 THEN 'No jobs in queue - system is idle'
 ELSE 'Queue is operating normally' END AS recommendations
FROM (SELECT COUNT(*) FILTER (WHERE status = 'pending') AS pending, COUNT(*) FILTER (WHERE status = 'processing') AS processing,
 COUNT(*) FILTER (WHERE status = 'retrying') AS retrying, COUNT(*) FILTER (WHERE status = 'completed') AS completed,
 COUNT(*) FILTER (WHERE status = 'failed') AS failed, COUNT(*) FILTER (WHERE job_type = 'process_chunk') AS total_stuck FROM f_jobs) t""")
def _(m):
    return jobs.queue_advice(m.jobs).withColumn("recommendations", F.array_join("recommendations", "; "))


@register("stuck_jobs", "SELECT * FROM f_jobs WHERE job_type = 'process_chunk' OR status IN ('retrying', 'processing')")
def _(m):
    return jobs.stuck_jobs(m.jobs)


@register("cleanup_advice", """
SELECT retrying, processing, old, concat_ws('; ', CASE WHEN retrying > 0 THEN 'Clear ' || retrying || ' stuck retrying jobs' END,
 CASE WHEN processing > 0 THEN 'Clear ' || processing || ' old processing jobs with no active worker' END,
 CASE WHEN old > 0 THEN 'Remove ' || old || ' jobs with obsolete job type ''process_chunk''' END) AS recommendations
FROM (SELECT COUNT(*) FILTER (WHERE status = 'retrying') AS retrying, COUNT(*) FILTER (WHERE status = 'processing') AS processing,
 COUNT(*) FILTER (WHERE job_type = 'process_chunk') AS old FROM f_jobs) t""")
def _(m):
    return jobs.cleanup_advice(m.jobs).withColumn("recommendations", F.concat_ws("; ", "recommendations"))


@register("cleanup_jobs", """
SELECT *, job_type = 'process_chunk' OR (status IN ('retrying', 'processing') AND created_at < {AS_OF} - INTERVAL '48' HOUR) AS removed
FROM f_jobs""")
def _(m):
    return jobs.mark_cleanup(m.jobs, as_of(), max_age_hours=48)


@register("cleanup_jobs_by_type", "SELECT *, job_type IN ('process_chunk', 'chunk_processing') AS removed FROM f_jobs")
def _(m):
    return jobs.mark_cleanup(m.jobs, as_of(), (jobs.OLD_CHUNK_JOB, jobs.CHUNK_JOB), max_age_hours=None)


@register("stuck_jobs_by_type", "SELECT * FROM f_jobs WHERE job_type = 'process_chunk'")
def _(m):
    return jobs.stuck_jobs(m.jobs, by_type_only=True)


@register("expire_jobs", """
SELECT *, created_at AS completed_at FROM f_jobs WHERE NOT (status IN ('completed', 'failed') AND created_at < {AS_OF} - INTERVAL '7' DAY)""")
def _(m):
    return jobs.expire_jobs(m.jobs.withColumn("completed_at", c("created_at")), as_of())


@register("expire_job_records", f"""
SELECT *, created_at AS completed_at FROM f_jobs WHERE NOT (status IN ('completed', 'failed') AND created_at < {{AS_OF}} - INTERVAL '7' DAY)
 AND NOT {seconds('created_at', '{AS_OF}')} > 864000""")
def _(m):
    return jobs.expire_jobs(m.jobs.withColumn("completed_at", c("created_at")), as_of(), ttl=864_000)


@register("fail_job", """
SELECT job_id, retry_count + 1 AS retry_count, max_retries, 'Worker error: ' || worker_id AS error_message,
 CASE WHEN retry_count + 1 <= max_retries THEN 'retrying' ELSE 'failed' END AS status,
 CASE WHEN retry_count + 1 <= max_retries THEN {AS_OF} + to_seconds(CAST(LEAST(300, 60 * POW(2, retry_count + 1)) AS BIGINT)) END AS due_at,
 CASE WHEN retry_count + 1 > max_retries THEN {AS_OF} END AS completed_at FROM f_jobs WHERE status = 'processing'""")
def _(m):
    running = m.jobs.filter(c("status") == "processing")
    return jobs.fail_jobs(running, as_of(), F.concat(F.lit("Worker error: "), c("worker_id")))


@register("complete_job", """
SELECT job_id, job_type, CASE WHEN status = 'processing' THEN 'completed' ELSE status END AS status, priority, retry_count,
 max_retries, batch_id, worker_id, created_at, CASE WHEN status = 'processing' THEN '{"job": ' || job_id || '}' END AS result,
 CASE WHEN status = 'processing' THEN {AS_OF} END AS completed_at FROM f_jobs""")
def _(m):
    answers = m.jobs.filter(c("status") == "processing").select(
        "job_id", F.format_string('{"job": %d}', "job_id").alias("result")
    )
    return jobs.complete_jobs(m.jobs, answers, as_of())


# --- cache ----------------------------------------------------------------------

@register("cache_split_missing", """
SELECT result_id, url, md5(url) AS url_hash FROM f_results WHERE md5(url) NOT IN (SELECT url_hash FROM f_cache)""")
def _(m):
    return cache.missing(m.results.select("result_id", "url"), m.cache, ["result_id"])


@register("cache_missing_at", """
SELECT result_id, url, md5(url) AS url_hash FROM f_results WHERE md5(url) NOT IN (SELECT url_hash FROM f_cache)""")
def _(m):
    path = f"{staging_dir(m.spark)}/cache-{uuid.uuid4().hex}"
    cache.write_cache(m.cache, path)
    return cache.missing_at(m.results.select("result_id", "url"), path, ["result_id"])


@register("cache_split_hits", """
SELECT result_id, url, md5(url) AS url_hash FROM f_results WHERE md5(url) IN (SELECT url_hash FROM f_cache)""")
def _(m):
    return cache.hits(m.results.select("result_id", "url"), m.cache, ["result_id"])


@register("cache_lookup", """
SELECT r.result_id, r.url, f.url_hash, 'true' AS store_image, json_extract_string(analysis_data, '$.store_name') AS store_name
FROM f_results r JOIN (SELECT * FROM f_cache WHERE json_valid(analysis_data)) f ON md5(r.url) = f.url_hash""")
def _(m):
    found = cache.lookup(m.results.select("result_id", "url"), m.cache, ["result_id"])
    return found.select("result_id", "url", "url_hash", "store_image", "store_name")


@register("touch_cache", """
SELECT f.url, f.url_hash, access_count + COALESCE(n, 0) AS access_count, created_at,
 CASE WHEN n IS NOT NULL THEN {AS_OF} ELSE accessed_at END AS accessed_at, analysis_data
FROM f_cache f LEFT JOIN (SELECT md5(url) AS url_hash, COUNT(*) AS n FROM f_results WHERE success GROUP BY md5(url)) h ON f.url_hash = h.url_hash""")
def _(m):
    looked_up = cache.with_hash(m.results.filter("success"))
    return cache.touch(m.cache, looked_up, as_of())


@register("cache_upsert", """
WITH latest AS (SELECT md5(url) AS url_hash, url, '{"store_name": "' || store_name || '"}' AS analysis_data FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY url ORDER BY created_at DESC, result_id DESC) AS rn FROM f_results
 WHERE store_name IS NOT NULL) t WHERE rn = 1)
SELECT url_hash, url, analysis_data, {AS_OF} AS created_at, {AS_OF} AS accessed_at, CAST(1 AS BIGINT) AS access_count FROM latest
UNION ALL SELECT url_hash, url, analysis_data, created_at, accessed_at, access_count FROM f_cache
WHERE url_hash NOT IN (SELECT url_hash FROM latest)""")
def _(m):
    fresh = m.results.filter(c("store_name").isNotNull()).select(
        "url", F.concat(F.lit('{"store_name": "'), c("store_name"), F.lit('"}')).alias("analysis_data"),
        F.struct("created_at", "result_id").alias("at"),
    )
    path = f"{staging_dir(m.spark)}/cache-{uuid.uuid4().hex}"
    cache.write_cache(m.cache, path, digits=1)
    cache.upsert_cache(path, fresh, as_of(), digits=1)
    return cache.read_cache(m.spark, path)


@register("expire_cache", "SELECT * FROM f_cache WHERE NOT created_at < {AS_OF} - INTERVAL '25' DAY")
def _(m):
    return cache.expire(m.cache, as_of(), 25)


@register("cache_stats", """
SELECT COUNT(*) AS total_entries, COUNT(*) FILTER (WHERE accessed_at >= {AS_OF} - INTERVAL '1' DAY) AS recent_access_24h FROM f_cache""")
def _(m):
    return cache.stats(m.cache, as_of())


@register("top_accessed", "SELECT url, access_count FROM f_cache ORDER BY access_count DESC, url LIMIT 5")
def _(m):
    return cache.top_accessed(m.cache)
