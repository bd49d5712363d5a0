"""Streaming queries: the given events as a file stream, run to the end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from batchloom.operators import cache
from batchloom.plans.catalog import as_of, r6, register
from batchloom.plans.columns import PICKED_SQL
from batchloom.plans.processing import stub_scorer
from batchloom.plans.views import view
from batchloom.session import DEFAULTS, staging_dir
from batchloom.streaming import streams

c = F.col
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def events(m):
    schema = m.table("events").schema
    raw = streams.file_stream(m.spark, f"{m.sf_dir}/event*.parquet", schema)
    return raw.withColumn("ts", c("ts").cast("timestamp"))


def results(m):
    failed = c("event_type") == "error"
    message = F.when(failed & (c("event_id") % 3 == 0), F.lit("Connection timeout: host")).when(
        failed, F.lit("Failed to download image"))
    return events(m).select(
        c("event_id").alias("result_id"), c("user_id").alias("batch_id"), (~failed).alias("success"),
        message.alias("error_message"), "ts",
    )


def local(*names):
    return {n: c(n).cast("timestamp_ntz") for n in names}


_COUNTS = """COUNT(*) AS processed, COUNT(*) FILTER (WHERE event_type <> 'error') AS successful,
 COUNT(*) FILTER (WHERE event_type = 'error') AS failed"""


@register("stream_ingest", f"""
SELECT batch_id, url, sha256(url) AS url_hash FROM (SELECT DISTINCT user_id AS batch_id, url FROM (
 SELECT batch_id AS user_id, {PICKED_SQL} AS url FROM f_urls) p WHERE url LIKE 'http://%' OR url LIKE 'https://%') d""")
def _(m):
    n = c("event_id")
    url = (
        F.when(n % 13 == 0, F.format_string("ftp://img.example.com/%d", n))
        .when(n % 13 == 1, F.format_string("HTTP://img.example.com/%d", n)).when(n % 13 == 2, F.lit(""))
        .when(n % 13 == 3, F.lit("  ")).when(n % 13 == 4, F.lit(None))
        .when(n % 13 == 5, F.format_string("  https://img.example.com/%d.jpg ", n % 900))
        .otherwise(F.format_string("https://img.example.com/%d.jpg", n % 900))
    )
    other = F.when(n % 2 == 0, F.format_string("http://alt.example.com/%d", n % 700))
    rows = events(m).select(c("user_id").alias("batch_id"), url.alias("url"), other.alias("image_url"), "event_id", "ts")
    # the whole table is one micro-batch here, so the delay does not matter
    return streams.drain_append(streams.ingest(rows, ["url", "image_url"], spread="event_id")).select("batch_id", "url", "url_hash")


@register("stream_progress", f"SELECT user_id AS batch_id, {_COUNTS} FROM events GROUP BY user_id")
def _(m):
    return streams.drain_update(streams.progress(results(m)), ["batch_id"])


@register("stream_error_progress", """
SELECT user_id AS batch_id, CASE WHEN event_id % 3 = 0 THEN 'Connection timeout' ELSE 'Failed to download image' END AS pattern,
 COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def _(m):
    return streams.drain_update(streams.error_progress(results(m)), ["batch_id", "pattern"])


_CLOSED = "(SELECT date_trunc('milliseconds', MAX(ts)) - INTERVAL '10' MINUTE FROM events)"


@register("stream_rate", f"""
SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL '1' MINUTE AS window_end, {_COUNTS} FROM events
GROUP BY date_trunc('minute', ts) HAVING date_trunc('minute', ts) + INTERVAL '1' MINUTE <= {_CLOSED}""")
def _(m):
    return streams.drain_append(streams.rate(results(m))).withColumns(local("window_start", "window_end"))


@register("stream_last_hour", f"""
SELECT w AS window_start, w + INTERVAL '1' HOUR AS window_end, {_COUNTS},
 ROUND(COUNT(*) FILTER (WHERE event_type = 'error') / CAST(COUNT(*) AS DOUBLE), 6) AS error_rate
FROM (SELECT event_type, time_bucket(INTERVAL '30' MINUTE, ts) - k * INTERVAL '30' MINUTE AS w FROM events, (VALUES (0), (1)) v(k)) t
GROUP BY w HAVING w + INTERVAL '1' HOUR <= {_CLOSED}""")
def _(m):
    out = streams.drain_append(streams.last_hour(results(m), step="30 minutes"))
    return out.withColumns(local("window_start", "window_end")).withColumn("error_rate", r6(c("error_rate")))


@register("stream_sessions", f"""
SELECT user_id AS batch_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL '1' HOUR AS session_end, {_COUNTS} FROM (
 SELECT *, SUM(CASE WHEN ts < before + INTERVAL '1' HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, COALESCE(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '1970-01-01 00:00:00') AS before FROM events) a) b
GROUP BY user_id, s HAVING MAX(ts) + INTERVAL '1' HOUR <= {_CLOSED}""")
def _(m):
    return streams.drain_append(streams.sessions(results(m))).withColumns(local("session_start", "session_end"))


@register("stream_job_state", """
WITH RECURSIVE e AS (SELECT user_id AS job, event_id, event_type, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(0 AS INT) AS retries, CAST(NULL AS TIMESTAMP) AS due, CAST(NULL AS TIMESTAMP) AS ts FROM e
 UNION ALL SELECT w.job, e.n, CASE WHEN event_type = 'error' THEN CASE WHEN retries < 3 THEN 'retrying' ELSE 'failed' END
   WHEN event_type = 'purchase' THEN 'completed' ELSE 'processing' END,
  retries + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END,
  CASE WHEN event_type = 'error' AND retries < 3 THEN e.ts + to_seconds(CAST(LEAST(300, 60 * POW(2, retries + 1)) AS BIGINT)) END, e.ts
 FROM w JOIN e ON w.job = e.job AND e.n = w.n + 1)
SELECT CAST(job AS STRING) AS job_id, status, retries AS retry_count, due AS due_at, ts AS last_seen FROM w
WHERE n = (SELECT MAX(n) FROM e WHERE e.job = w.job)""")
def _(m):
    kind = F.when(c("event_type") == "error", "fail").when(c("event_type") == "purchase", "complete").otherwise("beat")
    source = events(m).select(c("user_id").alias("job_id"), kind.alias("event"), "event_id", "ts")
    before = m.spark.conf.get(PROVIDER, None)
    m.spark.conf.set(PROVIDER, DEFAULTS[PROVIDER])
    try:
        out = streams.drain_update(streams.job_state(source), ["job_id"])
    finally:
        m.spark.conf.set(PROVIDER, before) if before else m.spark.conf.unset(PROVIDER)
    return out.drop("timed_out").withColumns(local("due_at", "last_seen"))


@register("stream_cache_enrich", """
SELECT event_id AS result_id, user_id AS batch_id, url, k.url_hash IS NOT NULL AS cache_hit,
 k.url_hash IS NOT NULL OR LEFT(md5(url), 1) <> 'f' AS success
FROM (SELECT event_id, user_id, 'https://img.example.com/' || CAST(event_id % 4000 AS STRING) || '.jpg' AS url FROM events) e
LEFT JOIN (SELECT url_hash FROM f_cache WHERE json_valid(analysis_data)) k ON md5(url) = k.url_hash""")
def _(m):
    path = f"{staging_dir(m.spark)}/cache-{uuid.uuid4().hex}"
    cache.write_cache(view(m.spark, m.sf_dir, "f_cache"), path, digits=1)
    urls = events(m).select(
        c("user_id").alias("batch_id"), F.lit(1).alias("chunk_number"), c("event_id").alias("item_id"),
        F.format_string("https://img.example.com/%d.jpg", c("event_id") % 4000).alias("url"),
    )
    out = streams.enrich_stream(urls, path, stub_scorer(), as_of(), digits=1)
    return out.select("result_id", "batch_id", "url", "cache_hit", "success")


@register("stream_late", """
WITH span AS (SELECT MIN(epoch_us(ts)) + (MAX(epoch_us(ts)) - MIN(epoch_us(ts))) / 3 AS t,
 date_trunc('milliseconds', MAX(ts)) - INTERVAL '10' MINUTE AS b FROM events)
SELECT time_bucket(INTERVAL '1' HOUR, ts) AS window_start, COUNT(*) AS processed,
 (SELECT COUNT(*) FROM events, span WHERE epoch_us(ts) < t) AS late_rows FROM events, span WHERE epoch_us(ts) >= t
GROUP BY time_bucket(INTERVAL '1' HOUR, ts), b HAVING time_bucket(INTERVAL '1' HOUR, ts) + INTERVAL '1' HOUR <= b""")
def _(m):
    # the last third of the time range arrives first and the first third at the end: by then it is late.
    # A micro-batch drops what was late for the one before it, hence three parts.
    folder = f"{staging_dir(m.spark)}/late-{uuid.uuid4().hex}"
    table = m.table("events")
    at = F.unix_micros(c("ts").cast("timestamp"))
    span = table.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    # a part is as many files as a micro-batch takes, each of a thousand rows at least so that none is empty
    files = max(1, min(int(m.spark.conf.get("spark.sql.shuffle.partitions")), table.count() // 3000))
    first, second = [span.select(c("lo") + (c("hi") - c("lo")) * k / 3).scalar() for k in (1, 2)]
    for part in (at >= second, (at >= first) & (at < second), at < first):
        table.filter(part).repartition(files).write.mode("append").parquet(folder)
    raw = streams.file_stream(m.spark, folder, table.schema, files=files).withColumn("ts", c("ts").cast("timestamp"))
    source = raw.select(c("user_id").alias("batch_id"), (c("event_type") != "error").alias("success"), "ts")
    out = f"{folder}-windows"
    rows = streams.drain_append(streams.rate(source, "1 hour"), out)
    late = streams.late_count(m.spark.read.schema(table.schema).parquet(folder), rows, out)
    return rows.withColumns(local("window_start")).select("window_start", "processed", late.scalar().alias("late_rows"))
