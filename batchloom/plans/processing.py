"""User functions over items, and metric reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from batchloom.functions.answers import decode_analysis
from batchloom.operators import enrich, keyed, metrics, rates, rollups, runs
from batchloom.operators.cache import merge, write_cache
from batchloom.plans.catalog import as_of, r6, register
from batchloom.plans.columns import phone_sql
from batchloom.plans.reports import seconds
from batchloom.session import stage, staging_dir

c = F.col


def stub_scorer(attempt: int = 9):
    """A work function whose answers follow from the URL alone.

    A first digit of d, e or f fails below attempt 2, 3 or 4.
    """

    def score(url: str) -> dict:
        import hashlib

        h = hashlib.md5(url.encode()).hexdigest()
        if attempt < {"d": 2, "e": 3, "f": 4}.get(h[0], 0) or (attempt == 9 and h[0] == "f"):
            raise ValueError("Failed to download image")
        return {"store_image": h[0] < "8", "store_name": f"Shop {h[:4]}", "business_contact": f"Phone: 555-{ord(h[1]):03d}-{ord(h[2]):04d}"}

    return enrich.per_item(score)


_H = "md5(url)"
_FAILS = "LEFT(md5(url), 1) = 'f'"
_SHOP = "CASE WHEN {ok} THEN 'Shop ' || LEFT(md5(url), 4) END"


@register("enrich", f"""
SELECT result_id, url, NOT {_FAILS} AS success, {_SHOP.format(ok='NOT ' + _FAILS)} AS store_name,
 CASE WHEN {_FAILS} THEN 'Failed to download image' END AS error FROM f_results""")
def _(m):
    done = enrich.enrich(m.results.select("result_id", "url"), stub_scorer())
    return done.select("result_id", "url", "success", F.get_json_object("analysis", "$.store_name").alias("store_name"), "error")


class _Quick(rates.Clock):
    """A clock on which waiting takes no time."""

    def __init__(self):
        self.at = 0.0

    def now(self) -> float:
        return self.at

    def wait(self, seconds: float) -> None:
        self.at += seconds


@register("enrich_at_rate", f"""
SELECT CAST((rn - 1) % 7 AS INT) AS api_key, COUNT(*) AS calls, COUNT(*) FILTER (WHERE NOT {_FAILS}) AS successful, MAX(rn - 1) // 7 AS last_turn,
 true AS within_limit
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY result_id) AS rn FROM f_results) r GROUP BY 1""")
def _(m):
    # seven keys of 55 calls a minute less a tenth; a clock on which waiting takes no time
    keyed_rows = rates.with_keys(m.results.select("result_id", "url"), 7, [c("result_id").asc()])
    called = stage(rates.enrich_at_rate(keyed_rows, stub_scorer(), clock=_Quick()))
    done = called.groupBy("api_key").agg(F.count_if("success").alias("successful"), F.max("turn").alias("last_turn"))
    return rates.most_in_a_minute(called).join(done, "api_key").select(
        "api_key", "calls", "successful", "last_turn", (c("most") <= 50).alias("within_limit"))


_CACHED = "(SELECT url_hash, json_extract_string(analysis_data, '$.store_name') AS cached_name FROM f_cache WHERE json_valid(analysis_data))"
_ENRICHED = f"""(SELECT r.result_id, r.batch_id, r.chunk_number, r.url, k.url_hash IS NOT NULL AS cache_hit,
 k.url_hash IS NOT NULL OR LEFT(md5(r.url), 1) <> 'f' AS success, cached_name
 FROM f_results_c r LEFT JOIN {_CACHED} k ON md5(r.url) = k.url_hash)"""
_CONTACT = "'Phone: 555-' || LPAD(CAST(ascii(SUBSTRING(md5(url), 2, 1)) AS STRING), 3, '0') || '-' || LPAD(CAST(ascii(SUBSTRING(md5(url), 3, 1)) AS STRING), 4, '0')"


def _enriched(m):
    rows = m.results_c.select("batch_id", "chunk_number", c("result_id").alias("item_id"), "url")
    return enrich.enrich_with_cache(rows, m.cache, stub_scorer(), as_of())


@register("enrich_with_cache", f"""
SELECT result_id, batch_id, chunk_number, url, sha256(url) AS url_hash, success, cache_hit,
 CASE WHEN success THEN COALESCE(cached_name, 'Shop ' || LEFT(md5(url), 4)) END AS store_name,
 CASE WHEN success THEN cache_hit OR LEFT(md5(url), 1) < '8' END AS store_image,
 CASE WHEN success THEN COALESCE({phone_sql(f"(CASE WHEN NOT cache_hit THEN {_CONTACT} END)")}, false) END AS phone_number,
 CASE WHEN NOT success THEN 'Failed to download image' END AS error_message
FROM {_ENRICHED} e""")
def _(m):
    return _enriched(m).results.select(
        "result_id", "batch_id", "chunk_number", "url", "url_hash", "success", "cache_hit", "store_name", "store_image",
        "phone_number", "error_message",
    )


@register("enrich_chunk_totals", f"""
SELECT batch_id, chunk_number, COUNT(*) AS processed_count, COUNT(*) FILTER (WHERE success) AS successful_count,
 COUNT(*) FILTER (WHERE NOT success) AS failed_count, COUNT(*) FILTER (WHERE cache_hit) AS cache_hits,
 COUNT(*) FILTER (WHERE NOT cache_hit) AS new_processed FROM {_ENRICHED} e GROUP BY batch_id, chunk_number""")
def _(m):
    return rollups.chunk_run_summary(_enriched(m).results)


@register("enrich_cache_update", f"""
WITH done AS (SELECT DISTINCT url, md5(url) AS url_hash FROM {_ENRICHED} e WHERE success AND NOT cache_hit)
SELECT url_hash, url, 1 AS access_count, 'Shop ' || LEFT(url_hash, 4) AS store_name FROM done
UNION ALL SELECT url_hash, url, access_count, json_extract_string(analysis_data, '$.store_name') FROM f_cache
WHERE json_valid(analysis_data) AND url_hash NOT IN (SELECT url_hash FROM done)""")
def _(m):
    merged = merge(m.cache, _enriched(m).cache_rows, as_of())
    return decode_analysis(merged, "analysis_data").select("url_hash", "url", "access_count", "store_name")


@register("enrich_run", f"""
WITH e AS (SELECT e.* FROM {_ENRICHED} e JOIN f_batches b ON b.batch_id = e.batch_id WHERE b.status IN ('queued', 'processing')),
n AS (SELECT batch_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS ok, COUNT(DISTINCT chunk_number) AS chunks, COUNT(DISTINCT url) AS urls,
 COUNT(*) FILTER (WHERE result_id % 5 = 0) AS old, COUNT(DISTINCT url) FILTER (WHERE result_id % 5 = 0) AS old_urls FROM e GROUP BY batch_id)
SELECT b.batch_id, total_chunks, COALESCE(n.n, 0) AS processed_count, COALESCE(ok, 0) AS successful_count, COALESCE(n.n - ok, 0) AS failed_count,
 COALESCE(chunks, 0) AS current_chunk, ROUND(ok * 100.0 / n.n, 6) AS success_rate, 'completed' AS status, {{AS_OF}} AS completed_at,
 COALESCE(old + urls - old_urls, 0) AS stored_results
FROM f_batches b LEFT JOIN n ON b.batch_id = n.batch_id WHERE b.status IN ('queued', 'processing')""")
def _(m):
    # a fifth of the results are stored already
    folder = f"{staging_dir(m.spark)}/work-{uuid.uuid4().hex}"
    batches = stage(m.batches.filter(c("status").isin("queued", "processing")))
    rows = stage(m.results_c.select("batch_id", "chunk_number", c("result_id").alias("item_id"), "url").join(
        batches.select("batch_id"), "batch_id", "left_semi"))
    write_cache(m.cache, f"{folder}/cache", digits=1)
    rows.filter(c("item_id") % 5 == 0).select(
        c("item_id").alias("result_id"), "batch_id", "url", F.sha2("url", 256).alias("url_hash")).write.parquet(f"{folder}/stored")
    run = runs.enrich_run(rows, batches, m.chunks, f"{folder}/cache", f"{folder}/stored", stub_scorer(), as_of(), digits=1)
    stored = m.spark.read.schema(run.results.schema).parquet(f"{folder}/stored").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("stored_results"))
    return run.batches.join(stored, "batch_id", "left").select(
        "batch_id", "total_chunks", "processed_count", "successful_count", "failed_count", "current_chunk",
        r6(c("success_rate"), "success_rate"), "status", "completed_at", F.coalesce("stored_results", F.lit(0)).alias("stored_results"))


_ITEMS = """(SELECT batch_id, url, MIN(result_id) AS result_id, MIN_BY(chunk_number, result_id) AS chunk_number FROM f_results_c GROUP BY batch_id, url)"""
_RERUN = f"""
WITH i AS (SELECT i.*, b.status AS batch_status, md5(url) IN (SELECT url_hash FROM f_cache WHERE json_valid(analysis_data)) OR LEFT(md5(url), 1) <> 'f' AS success
 FROM {_ITEMS} i JOIN f_batches b ON b.batch_id = i.batch_id WHERE b.status IN ('queued', 'processing'))"""


def _rerun(m):
    """Every item of running batches, then those that failed, twice: two more kinds of URLs are answered each time but one."""
    folder = f"{staging_dir(m.spark)}/work-{uuid.uuid4().hex}"
    stored, batches = f"{folder}/stored", stage(m.batches.filter(c("status").isin("queued", "processing")))
    named = m.results_c.select("batch_id", "chunk_number", "result_id", "url").join(batches.select("batch_id"), "batch_id", "left_semi")
    rows = stage(named.groupBy("batch_id", "url").agg(F.min("result_id").alias("item_id"), F.min_by("chunk_number", "result_id").alias("chunk_number")))
    none = F.lit(0).cast("long")
    chunks = stage(rows.groupBy("batch_id", "chunk_number").agg(F.count(F.lit(1)).alias("url_count")).select(
        "batch_id", "chunk_number", "url_count", *[none.alias(n) for n in ("processed_count", "successful_count", "failed_count")],
        F.lit("pending").alias("status"), F.lit("old").alias("error_message"),
        *[F.lit(None).cast("timestamp_ntz").alias(n) for n in ("started_at", "completed_at")]))
    total = chunks.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    batches = batches.drop("total_chunks").join(total, "batch_id")
    write_cache(m.cache, f"{folder}/cache", digits=1)
    schema = "result_id long, batch_id long, chunk_number int, url string, url_hash string, success boolean, error_message string, created_at timestamp_ntz"
    runs.create_results(m.spark.createDataFrame([], schema), stored, runs.results_layout(8, 4))
    run = None
    for attempt in (1, 2, 9):
        todo = rows if run is None else stage(runs.failed_items(m.spark, stored))
        now = chunks if run is None else stage(run.chunks)
        run = runs.enrich_run(todo, batches, now, f"{folder}/cache", stored, stub_scorer(attempt), as_of(), digits=1)
    return run, keyed.read(m.spark, stored)


@register("enrich_rerun", _RERUN + """
SELECT batch_id, COUNT(DISTINCT chunk_number) AS total_chunks, COUNT(*) AS processed_count, COUNT(*) FILTER (WHERE success) AS successful_count,
 COUNT(*) FILTER (WHERE NOT success) AS failed_count, COUNT(DISTINCT chunk_number) AS current_chunk,
 ROUND(COUNT(*) FILTER (WHERE success) * 100.0 / COUNT(*), 6) AS success_rate, 'completed' AS status,
 COUNT(*) AS stored_results, COUNT(*) FILTER (WHERE success) AS stored_successes FROM i GROUP BY batch_id""")
def _(m):
    run, stored = _rerun(m)
    kept = stored.groupBy("batch_id").agg(F.count(F.lit(1)).alias("stored_results"), F.count_if("success").alias("stored_successes"))
    return run.batches.join(kept, "batch_id").select(
        "batch_id", "total_chunks", "processed_count", "successful_count", "failed_count", "current_chunk", r6(c("success_rate"), "success_rate"),
        "status", "stored_results", "stored_successes")


@register("enrich_rerun_chunks", _RERUN + """
SELECT batch_id, chunk_number, COUNT(*) AS processed_count, COUNT(*) FILTER (WHERE success) AS successful_count,
 COUNT(*) FILTER (WHERE NOT success) AS failed_count, 'completed' AS status FROM i GROUP BY batch_id, chunk_number""")
def _(m):
    return _rerun(m)[0].chunks.select("batch_id", "chunk_number", "processed_count", "successful_count", "failed_count", "status")


@register("replace_results", """
WITH w AS (SELECT result_id, batch_id, chunk_number, url, sha256(url) AS url_hash, success, created_at, CAST(result_id % 3 AS INT) AS part FROM f_results_c),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id, url ORDER BY success DESC, part DESC, created_at, result_id) AS n FROM w)
SELECT result_id, batch_id, chunk_number, url, url_hash, success, created_at FROM r WHERE n = 1""")
def _(m):
    # three writes, each of a third of the results; what a write has for a URL replaces what was there, but no success by a failure
    path = f"{staging_dir(m.spark)}/work-{uuid.uuid4().hex}/stored"
    rows = stage(m.results_c.select("result_id", "batch_id", "chunk_number", "url", F.sha2("url", 256).alias("url_hash"), "success", "created_at"))
    known = rows.select("batch_id").distinct()
    runs.create_results(rows.limit(0), path, runs.results_layout(8, 4))
    for part in range(3):
        runs.replace_results(path, known, rows.filter(c("result_id") % 3 == part))
    return keyed.read(m.spark, path)


@register("union_cached_new", """
SELECT result_id, url, cache_hit, success FROM f_results WHERE cache_hit
UNION ALL SELECT result_id, url, cache_hit, success FROM f_results WHERE NOT cache_hit""")
def _(m):
    r = m.results.select("result_id", "url", "cache_hit", "success")
    return enrich.union_cached_new(r.filter("cache_hit"), r.filter(~c("cache_hit")))


@register("handlers", """
SELECT job_id, job_type, job_type <> 'process_chunk' AS success,
 CASE job_type WHEN 'chunk_processing' THEN 'chunk of ' || batch_id WHEN 'finalize_batch' THEN 'final ' || batch_id END AS did,
 CASE WHEN job_type = 'process_chunk' THEN 'no handler registered for job type: process_chunk' END AS error FROM f_jobs""")
def _(m):
    table = {
        "chunk_processing": enrich.per_item(lambda p: {"did": f"chunk of {p}"}),
        "finalize_batch": enrich.per_item(lambda p: {"did": f"final {p}"}),
    }
    jobs = m.jobs.select("job_id", "job_type", c("batch_id").cast("string").alias("payload"))
    done = enrich.run_handlers(jobs, table)
    return done.select("job_id", "job_type", "success", F.get_json_object("analysis", "$.did").alias("did"), "error")


@register("retry_rounds", """
SELECT result_id, url, CAST(CASE LEFT(md5(url), 1) WHEN 'd' THEN 2 WHEN 'e' THEN 3 WHEN 'f' THEN 3 ELSE 1 END AS INT) AS attempts,
 LEFT(md5(url), 1) <> 'f' AS success FROM f_results""")
def _(m):
    done = enrich.retry_rounds(m.results.select("result_id", "url"), stub_scorer, max_retries=2)
    return done.select("result_id", "url", "attempts", "success")


# --- metrics --------------------------------------------------------------------

def samples(m):
    """Metric samples with the names the reports use."""
    return m.metrics.select(
        "ts", "cpu_percent", "queue_size", "response_time", c("requests").alias("processing_rate"),
        (c("errors") / c("requests")).alias("error_rate"),
    )


_SAMPLES = """(SELECT ts, cpu_percent, queue_size, response_time, requests AS processing_rate,
 CAST(errors AS DOUBLE) / requests AS error_rate FROM f_metrics)"""


@register("latency_report", f"""
WITH s AS (SELECT ts, event_type <> 'error' AS success, value AS response_time FROM events),
ok AS (SELECT response_time, ROW_NUMBER() OVER (ORDER BY response_time) AS rn, COUNT(*) OVER () AS n FROM s WHERE success),
p AS (SELECT MAX(response_time) FILTER (WHERE rn = LEAST(CAST(FLOOR(CAST(0.95 AS DOUBLE) * n) AS BIGINT) + 1, n)) AS p95,
 MAX(response_time) FILTER (WHERE rn = LEAST(CAST(FLOOR(CAST(0.99 AS DOUBLE) * n) AS BIGINT) + 1, n)) AS p99, ROUND(AVG(response_time), 6) AS a,
 MIN(response_time) AS lo, MAX(response_time) AS hi FROM ok)
SELECT COUNT(*) AS total_requests, COUNT(*) FILTER (WHERE success) AS successful_requests, COUNT(*) FILTER (WHERE NOT success) AS failed_requests,
 ROUND(100.0 * COUNT(*) FILTER (WHERE success) / COUNT(*), 6) AS success_rate, ANY_VALUE(a) AS avg_response_time,
 ANY_VALUE(lo) AS min_response_time, ANY_VALUE(hi) AS max_response_time, ANY_VALUE(p95) AS p95_response_time, ANY_VALUE(p99) AS p99_response_time,
 ROUND(COUNT(*) FILTER (WHERE success) / ({seconds('MIN(ts)', 'MAX(ts)')}), 6) AS requests_per_second FROM s, p""")
def _(m):
    s = m.table("events").select("ts", (c("event_type") != "error").alias("success"), c("value").alias("response_time"))
    out = metrics.latency_report(s)
    return out.withColumns({n: r6(c(n)) for n in ("success_rate", "avg_response_time", "requests_per_second")})


_ACTUAL_SQL = f"""(SELECT batch_id AS id, total_urls * 100 AS batch_size, {seconds('started_at', '{AS_OF}')} AS processing_time,
 processed_count * 2.0 AS throughput_per_minute, CASE WHEN processed_count > 0 THEN CAST(failed_count AS DOUBLE) / processed_count END AS error_rate,
 total_urls * 30.0 AS memory_usage_mb FROM f_batches)"""
_LIMIT = "CASE WHEN batch_size <= 1000 THEN {0} WHEN batch_size <= 100000 THEN {1} ELSE {2} END"


def _metric_sql(metric, direction, a, b, d):
    target = _LIMIT.format(a, b, d)
    sign = "<=" if direction == "max" else ">="
    return f"""SELECT id, {_LIMIT.format("'small'", "'medium'", "'large'")} AS tier, '{metric}' AS metric, '{direction}' AS direction,
 CAST({target} AS DOUBLE) AS target, ROUND(CAST({metric} AS DOUBLE), 6) AS actual, COALESCE({metric} {sign} {target}, false) AS passed FROM {_ACTUAL_SQL} a"""


_CHECK_SQL = " UNION ALL ".join([
    _metric_sql("processing_time", "max", 300, 3600, 86400), _metric_sql("throughput_per_minute", "min", 60, 100, 150),
    _metric_sql("error_rate", "max", 0.02, 0.05, 0.1), _metric_sql("memory_usage_mb", "max", 2048, 4096, 8192)])


def _actuals(m):
    b = m.batches
    elapsed = F.timestamp_diff("MICROSECOND", c("started_at"), as_of()) / 1e6
    return b.select(
        c("batch_id").alias("id"), (c("total_urls") * 100).alias("batch_size"), elapsed.alias("processing_time"),
        (c("processed_count") * 2.0).alias("throughput_per_minute"),
        F.when(c("processed_count") > 0, c("failed_count") / c("processed_count")).alias("error_rate"),
        (c("total_urls") * 30.0).alias("memory_usage_mb"),
    )


@register("target_check", _CHECK_SQL)
def _(m):
    return metrics.target_check(_actuals(m)).withColumn("actual", r6(c("actual")))


@register("target_overall", f"""
SELECT id, bool_and(passed) AS overall_passed, COUNT(*) FILTER (WHERE passed) AS passed FROM ({_CHECK_SQL}) t GROUP BY id""")
def _(m):
    return metrics.target_overall(metrics.target_check(_actuals(m)))


@register("rolling_hour", f"""
SELECT ts, COUNT(*) OVER w AS samples, ROUND(AVG(cpu_percent) OVER w, 6) AS avg_cpu, MAX(queue_size) OVER w AS max_queue
FROM {_SAMPLES} s WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '10799' SECOND PRECEDING AND CURRENT ROW)""")
def _(m):
    out = metrics.rolling_values(
        samples(m), {"samples": ("count", None), "avg_cpu": ("mean", "cpu_percent"), "max_queue": ("max", "queue_size")}, 10_800
    )
    return out.select("ts", "samples", r6(c("avg_cpu"), "avg_cpu"), "max_queue")


@register("rolling_extremes", """
SELECT event_id, COUNT(value) OVER w AS n, MIN(value) OVER w AS lowest, MAX(value) OVER w AS highest, MAX(event_id % 1000) OVER w AS last
FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '86399999999' MICROSECOND PRECEDING AND CURRENT ROW)""")
def _(m):
    # one series; a day of it holds thousands of samples at full scale
    rows = m.table("events").select("event_id", "ts", "value", (c("event_id") % 1000).alias("rest"))
    return metrics.rolling_values(rows, {"n": ("count", "value"), "lowest": ("min", "value"), "highest": ("max", "value"), "last": ("max", "rest")},
                                  86_400).select("event_id", "n", "lowest", "highest", "last")


@register("rolling_means", """
SELECT event_id, COUNT(*) OVER w AS samples, ROUND(AVG(value) OVER w + 1e-9, 6) AS avg_value, ROUND(AVG(event_id % 7) OVER w + 1e-9, 6) AS avg_rest
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '3599999999' MICROSECOND PRECEDING AND CURRENT ROW)""")
def _(m):
    rows = m.table("events").select("event_id", "event_type", "ts", "value", (c("event_id") % 7).alias("rest"))
    out = metrics.rolling_means(rows, ["value", "rest"], 3600, ["event_type"])
    # means of prices often end in half a step; the engines round such halves differently
    return out.select("event_id", "samples", *[r6(c(n) + 1e-9, n) for n in ("avg_value", "avg_rest")])


@register("scale_decision", f"""
SELECT ts, n >= 5 AND c5 > 80 AND queue_size > q5 AS scale_up, n >= 10 AND c10 < 30 AND q10 < 100 AND e10 < 0.05 AS scale_down FROM (
 SELECT ts, queue_size, ROW_NUMBER() OVER (ORDER BY ts) AS n, AVG(cpu_percent) OVER f AS c5, COALESCE(LAG(queue_size, 4) OVER (ORDER BY ts), 1000000000) AS q5,
  AVG(cpu_percent) OVER t AS c10, AVG(queue_size) OVER t AS q10, AVG(error_rate) OVER t AS e10 FROM {_SAMPLES} s
 WINDOW f AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), t AS (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) x""")
def _(m):
    return metrics.scale_decision(samples(m))


def _list_sql(texts):
    return "'" + "; ".join(texts) + "'"


@register("throughput_diagnosis", f"""
SELECT ts, ROUND(r, 6) AS avg_processing_rate, ROUND(e, 6) AS avg_error_rate, ROUND(q, 6) AS avg_queue_size,
 CASE WHEN r < 50 THEN concat_ws('; ', CASE WHEN e > 0.1 THEN {_list_sql(metrics.ERROR_ADVICE)} END,
  CASE WHEN q > 100 THEN {_list_sql(metrics.QUEUE_ADVICE)} END, {_list_sql(metrics.GENERAL_ADVICE)}) ELSE '' END AS recommendations
FROM (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) AS n, AVG(processing_rate) OVER f AS r, AVG(error_rate) OVER f AS e, AVG(queue_size) OVER f AS q
 FROM {_SAMPLES} s WINDOW f AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) x WHERE n >= 5""")
def _(m):
    out = metrics.throughput_diagnosis(samples(m), long_queue=100)
    return out.withColumns({n: r6(c(n)) for n in ("avg_processing_rate", "avg_error_rate", "avg_queue_size")}).withColumn(
        "recommendations", F.concat_ws("; ", "recommendations")
    )


_RULES = [
    ("high_error_rate", "error_rate", 0.25, "above", 3600, "alert"), ("low_throughput", "processing_rate", 15.0, "below", 7200, "alert"),
    ("large_queue", "queue_size", 100.0, "above", 14400, "scale_up"), ("busy", "cpu_percent", 80.0, "above", 36000, "scale_up"),
]


def _alert_sql(name, metric, threshold, direction, duration, action):
    sign = ">" if direction == "above" else "<"
    return f"""SELECT '{name}' AS alert, '{action}' AS action, MIN(ts) AS started_at, MAX(ts) AS ended_at, COUNT(*) AS samples, ROUND(MIN(v), 6) AS lowest,
 ROUND(MAX(v), 6) AS highest, date_diff('second', MIN(ts), MAX(ts)) AS lasted_seconds FROM (
 SELECT ts, v, bad, n - SUM(CASE WHEN bad THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS island FROM (
  SELECT ts, CAST({metric} AS DOUBLE) AS v, {metric} {sign} {threshold} AS bad, ROW_NUMBER() OVER (ORDER BY ts) AS n FROM {_SAMPLES} s) a) b
WHERE bad GROUP BY island HAVING date_diff('second', MIN(ts), MAX(ts)) >= {duration}"""


@register("sustained_alerts", " UNION ALL ".join(_alert_sql(*r) for r in _RULES))
def _(m):
    names = ["error_rate", "processing_rate", "queue_size", "cpu_percent"]
    wide = samples(m).select("ts", *[c(n).cast("double").alias(n) for n in names])
    out = metrics.sustained_alerts(wide.unpivot(["ts"], names, "metric", "value"), _RULES)
    return out.withColumns({n: r6(c(n)) for n in ("lowest", "highest")})


@register("adaptive_rate", """
WITH RECURSIVE shares AS (SELECT key, period, share, ROW_NUMBER() OVER (PARTITION BY key ORDER BY period) AS n FROM (
 SELECT result_id % 4 AS key, date_trunc('hour', created_at) AS period, AVG(CASE WHEN success THEN 1.0::DOUBLE ELSE 0.0 END) AS share
 FROM f_results GROUP BY 1, 2) t),
walk AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS period, 60.0::DOUBLE AS rate FROM (SELECT DISTINCT key FROM shares) k
 UNION ALL SELECT w.key, s.n, s.period, CASE WHEN s.share > 0.95 THEN LEAST(w.rate * 1.1::DOUBLE, 100.0::DOUBLE)
  WHEN s.share < 0.8 THEN GREATEST(w.rate * 0.9::DOUBLE, 30.0::DOUBLE) ELSE w.rate END
 FROM walk w JOIN shares s ON w.key = s.key AND s.n = w.n + 1)
SELECT key, period, ROUND(rate, 6) AS rate FROM walk WHERE n > 0""")
def _(m):
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    shares = m.results.groupBy((c("result_id") % 4).alias("key"), hour.alias("period")).agg(
        F.avg(c("success").cast("double")).alias("share")
    )
    out = metrics.adaptive_rate(shares)
    return out.withColumn("rate", r6(c("rate")))
