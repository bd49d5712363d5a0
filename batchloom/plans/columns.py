"""Sources and scalar functions, each over a whole view."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from batchloom import schemas
from batchloom.functions import answers, scalars
from batchloom.functions.phone import OTHER_WORDS, PHONE_WORDS, SHAPES, TEST_NUMBERS_10, TEST_NUMBERS_11, phone_flag
from batchloom.functions.timing import iso_text
from batchloom.operators.ordering import number_rows
from batchloom.plans.catalog import as_of, r6, register
from batchloom.plans.listings import iso
from batchloom.plans.reports import seconds
from batchloom.sources.job_log import decode_jobs
from batchloom.session import staging_dir
from batchloom.sources.tables import conform, scan_table
from batchloom.sources.url_csv import scan_url_csv, with_clean_url

_STRIP = r"regexp_replace({c}, '^[\s\x{1c}-\x{1f}\x{85}\pZ]+|[\s\x{1c}-\x{1f}\x{85}\pZ]+$', '', 'g')"


def strip_sql(column: str) -> str:
    return _STRIP.replace("{c}", column)


PICKED_SQL = strip_sql("COALESCE(NULLIF(url, ''), NULLIF(image_url, ''))")
CLEAN_URLS_SQL = f"""(SELECT * FROM (SELECT seq, batch_id, {PICKED_SQL} AS url FROM f_urls) p
 WHERE url LIKE 'http://%' OR url LIKE 'https://%')"""


def clean_urls(m):
    return with_clean_url(m.urls, ["url", "image_url"]).select("seq", "batch_id", "url")


@register("scan_url_csv", f"SELECT seq, batch_id, url FROM {CLEAN_URLS_SQL} c")
def _(m):
    return clean_urls(m)


@register("scan_url_csv_files", f"SELECT url, COUNT(*) AS n FROM {CLEAN_URLS_SQL} c GROUP BY url")
def _(m):
    # two kinds of files: the columns stand in another order
    folder = f"{staging_dir(m.spark)}/urls-{uuid.uuid4().hex}"
    for part, names in enumerate((["url", "image_url"], ["image_url", "url"])):
        m.urls.filter(F.col("seq") % 2 == part).select(*names).write.mode("append").option("header", True).option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return scan_url_csv(m.spark, folder).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@register("scan_tables_files", """
SELECT CAST(result_id AS STRING) AS result_id, CAST(batch_id AS STRING) AS batch_id, url, success, store_image,
 text_content, store_name, business_contact, error_message, processing_time_seconds, created_at, cache_hit FROM f_results""")
def _(m):
    folder = f"{staging_dir(m.spark)}/results-{uuid.uuid4().hex}"
    conform(m.results, schemas.RESULTS).write.parquet(folder)
    out = scan_table(m.spark, folder, schemas.RESULTS)
    return out.select(
        "result_id", "batch_id", "url", "success", "store_image", "text_content", "store_name", "business_contact",
        "error_message", "processing_time_seconds", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "cache_hit",
    )


@register("scan_tables", """
SELECT CAST(result_id AS STRING) AS result_id, CAST(batch_id AS STRING) AS batch_id, url, success, store_image,
 text_content, store_name, business_contact, error_message, processing_time_seconds, created_at, cache_hit,
 CAST(NULL AS STRING) AS api_key_used FROM f_results""")
def _(m):
    out = conform(m.results, schemas.RESULTS)
    return out.select(
        "result_id", "batch_id", "url", "success", "store_image", "text_content", "store_name", "business_contact",
        "error_message", "processing_time_seconds", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        "cache_hit", "api_key_used",
    )


@register("scan_analysis_json", """
SELECT doc_id, json_extract_string(j, '$.store_image') AS store_image, json_extract_string(j, '$.text_content') AS text_content,
 json_extract_string(j, '$.store_name') AS store_name, json_extract_string(j, '$.business_contact') AS business_contact,
 json_extract_string(j, '$.image_description') AS image_description
FROM (SELECT doc_id, CASE WHEN json_valid(response_text) THEN response_text END AS j FROM f_responses) t WHERE j IS NOT NULL""")
def _(m):
    return answers.decode_analysis(m.responses, "response_text").drop("response_text")


@register("scan_job_log", """
SELECT CAST(job_id AS STRING) AS job_id, job_type, status, retry_count, max_retries, worker_id, priority,
 CAST(batch_id AS STRING) AS batch_id, 'c' || CAST(job_id AS STRING) AS chunk_id, CAST(1 AS INT) AS url_count,
 created_at FROM f_jobs""")
def _(m):
    payload = F.struct(
        F.col("batch_id").cast("string").alias("batch_id"), F.concat(F.lit("c"), F.col("job_id")).alias("chunk_id"),
        F.array(F.lit("https://img.example.com/1.jpg")).alias("urls"),
    )
    record = F.struct(
        F.col("job_id").cast("string").alias("job_id"), "job_type", payload.alias("payload"), "status",
        iso_text(F.col("created_at")).alias("created_at"), "retry_count", "max_retries", "worker_id", "priority",
    )
    jobs = decode_jobs(m.jobs.select(F.to_json(record).alias("value")))
    return jobs.select(
        "job_id", "job_type", "status", "retry_count", "max_retries", "worker_id", "priority", "batch_id", "chunk_id",
        "url_count", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def _column(name, source, key, column, sql, note=""):
    """One scalar function over a whole view, beside the view's key."""
    @register(name, f"SELECT {key}, {sql} AS value FROM f_{source}")
    def run(m):
        return getattr(m, source).select(key, column().alias("value"))


c = F.col
_column("url_valid", "urls", "seq", lambda: scalars.url_valid(c("url")),
        "COALESCE(url LIKE 'http://%' OR url LIKE 'https://%', false)")
_column("url_sha256", "results", "result_id", lambda: scalars.url_sha256(c("url")), "sha256(url)")
_column("url_md5", "results", "result_id", lambda: scalars.url_md5(c("url")), "md5(url)")
_column("progress_pct", "batches", "batch_id", lambda: F.round(scalars.share_pct(c("processed_count"), c("total_urls")), 2),
        "ROUND(CASE WHEN total_urls > 0 THEN 100.0 * processed_count / total_urls ELSE 0 END, 2)")
_column("is_active", "batches", "batch_id", lambda: scalars.is_active(c("status")),
        "status IN ('pending', 'queued', 'processing')")
_column("is_complete", "batches", "batch_id", lambda: scalars.is_complete(c("status")),
        "status IN ('completed', 'failed', 'cancelled')")
_column("yes_no", "results", "result_id", lambda: scalars.yes_no(c("store_image")),
        "CASE WHEN store_image THEN 'Yes' ELSE 'No' END")
_column("blank_null", "results", "result_id", lambda: scalars.blank_null(c("store_name")), "COALESCE(store_name, '')")
_column("zero_null", "results", "result_id", lambda: scalars.zero_null(c("processing_time_seconds")),
        "COALESCE(processing_time_seconds, 0.0)")
_column("iso_ts", "results", "result_id", lambda: iso_text(c("created_at")), iso("created_at"))
_column("truncate_text", "results", "result_id", lambda: scalars.truncate_text(c("text_content"), 500),
        "SUBSTRING(text_content, 1, 500)")
_column("error_class", "results", "result_id", lambda: scalars.error_class(c("error_message")),
        "split_part(error_message, ':', 1)")
_column("default_batch_name", "batches", "batch_id",
        lambda: scalars.default_batch_name(F.when(c("batch_id") % 2 == 0, c("batch_name")).otherwise(F.lit("")), c("created_at")),
        "CASE WHEN batch_id % 2 = 0 THEN batch_name ELSE 'Batch_' || strftime(created_at, '%Y%m%d_%H%M%S') END")
_column("chunk_count", "batches", "batch_id", lambda: scalars.chunk_count(c("total_urls"), 10),
        "CAST(CEIL(total_urls / 10.0) AS BIGINT)")
_column("size_estimate_mb", "batches", "batch_id", lambda: scalars.size_estimate_mb(c("total_urls") * 1000, "json"),
        "ROUND(total_urls * 1000 * 400 / 1048576.0, 2)")
_MIN = seconds("started_at", "{AS_OF}") + " / 60"
_RATE = f"(CASE WHEN processed_count <> 0 AND {_MIN} >= 1 THEN processed_count / ({_MIN}) ELSE 0.0 END)"


def _rate():
    return scalars.processing_rate(c("processed_count"), c("started_at"), as_of())


_column("processing_rate", "batches", "batch_id", lambda: r6(_rate()), f"ROUND({_RATE}, 6)")
_column("elapsed_minutes", "batches", "batch_id", lambda: r6(scalars.elapsed_minutes(c("started_at"), as_of())),
        f"ROUND(COALESCE({_MIN}, 0.0), 6)")
_column("remaining_minutes", "batches", "batch_id",
        lambda: r6(scalars.remaining_minutes(c("total_urls"), c("processed_count"), _rate())),
        f"ROUND(CASE WHEN {_RATE} > 0 THEN (total_urls - processed_count) / {_RATE} END, 6)")
_column("eta", "batches", "batch_id",
        lambda: F.date_trunc("second", scalars.eta(c("total_urls"), c("processed_count"), _rate(), as_of())).cast("timestamp_ntz"),
        f"""CASE WHEN {_RATE} > 0 THEN date_trunc('second', {{AS_OF}} + to_microseconds(CAST(ROUND(
 (total_urls - processed_count) / {_RATE} * 60000000) AS BIGINT))) END""")
_column("avg_seconds_per_url", "batches", "batch_id",
        lambda: r6(scalars.avg_seconds_per_url(c("processed_count"), scalars.elapsed_minutes(c("started_at"), as_of()))),
        f"ROUND(CASE WHEN processed_count > 0 AND {_MIN} > 0 THEN {_MIN} * 60 / processed_count ELSE 0 END, 6)")
_column("estimate_hours", "batches", "batch_id", lambda: r6(scalars.estimate_hours(c("total_urls"), 4)),
        "ROUND(total_urls / 900.0, 6)")
_column("poll_interval", "batches", "batch_id",
        lambda: scalars.poll_interval(scalars.share_pct(c("processed_count"), c("total_urls")), scalars.is_active(c("status"))),
        """CAST(CASE WHEN status NOT IN ('pending', 'queued', 'processing') THEN 30
 WHEN total_urls = 0 OR 100.0 * processed_count / total_urls < 10 THEN 5
 WHEN 100.0 * processed_count / total_urls < 50 THEN 10 WHEN 100.0 * processed_count / total_urls < 90 THEN 15 ELSE 5 END AS INT)""")
_column("retry_delay", "jobs", "job_id", lambda: scalars.retry_delay(c("retry_count") + 1),
        "CAST(LEAST(300, 60 * POW(2, retry_count + 1)) AS INT)")
_column("has_contact", "results", "result_id", lambda: scalars.has_contact(c("business_contact")),
        "COALESCE(business_contact, '') <> ''")


@register("resize_dims", """
SELECT doc_id, CASE WHEN GREATEST(w, h) > 2048 THEN CAST(TRUNC(w * (2048.0::DOUBLE / GREATEST(w, h))) AS INT) ELSE w END AS width,
 CASE WHEN GREATEST(w, h) > 2048 THEN CAST(TRUNC(h * (2048.0::DOUBLE / GREATEST(w, h))) AS INT) ELSE h END AS height
FROM (SELECT doc_id, CAST(n_chars AS INT) AS w, CAST(doc_id * 37 % 5000 + 1 AS INT) AS h FROM documents) d""")
def _(m):
    d = m.table("documents").select(
        "doc_id", c("n_chars").cast("int").alias("w"), (c("doc_id") * 37 % 5000 + 1).cast("int").alias("h")
    )
    return d.select("doc_id", scalars.resize_dims(c("w"), c("h")).alias("s")).select("doc_id", "s.width", "s.height")


@register("assign_key", """
SELECT result_id, CAST((ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY result_id) - 1) % 4 AS INT) AS key_index FROM f_results""")
def _(m):
    blocks = F.floor(c("result_id") / 100_000)
    numbered = number_rows(m.results, ["batch_id"], [c("result_id").asc()], "n", bucket=blocks)
    return numbered.select("result_id", scalars.assign_key(c("n"), 4).alias("key_index"))


@register("current_chunk", """
SELECT batch_id, CASE WHEN done > 0 THEN done WHEN running > 0 THEN 1 ELSE 0 END AS current_chunk
FROM (SELECT batch_id, COUNT(*) FILTER (WHERE status = 'completed') AS done,
 COUNT(*) FILTER (WHERE status = 'processing') AS running FROM f_chunks GROUP BY batch_id) t""")
def _(m):
    counts = m.chunks.groupBy("batch_id").agg(
        F.count_if(c("status") == "completed").alias("done"), F.count_if(c("status") == "processing").alias("running")
    )
    return counts.select("batch_id", scalars.current_chunk(c("done"), c("running")).cast("long").alias("current_chunk"))


@register("payload_check", """
SELECT job_id, CASE WHEN batch_id IS NULL OR batch_id % 5 = 0 THEN 'batch_id' WHEN job_id % 7 = 0 THEN 'chunk_id'
 WHEN job_id % 3 = 0 THEN 'urls' END AS problem FROM f_jobs""")
def _(m):
    batch = F.when(c("batch_id") % 5 != 0, c("batch_id"))
    chunk = F.when(c("job_id") % 7 == 0, F.lit("")).otherwise(c("job_id").cast("string"))
    return m.jobs.select("job_id", scalars.payload_problem(batch, chunk, c("job_id") % 3).alias("problem"))


def _quoted(words):
    return ", ".join(f"'{w}'" for w in words)


def phone_sql(contact: str, mode: str = "executed") -> str:
    """The phone rule as SQL, from the same fixed values."""
    ruled_out = " OR ".join(f"contains(LOWER({contact}), '{w}')" for w in OTHER_WORDS)
    arms = []
    for shape in SHAPES:
        hit = f"regexp_extract({contact}, '{shape}')"
        digits = rf"LENGTH(regexp_replace({hit}, '\D', '', 'g'))"
        bare = rf"NOT regexp_matches({hit}, '[() .+\-]')"
        arms.append(f"WHEN {bare} AND {digits} = 10 THEN {hit} NOT IN ({_quoted(TEST_NUMBERS_10)})")
        if mode == "intended":
            arms.append(f"WHEN {bare} AND {digits} = 11 THEN {hit} NOT IN ({_quoted(TEST_NUMBERS_11)})")
            arms.append(f"WHEN {digits} BETWEEN 7 AND 15 THEN true")
    said = rf"regexp_extract(LOWER({contact}), '(?:{'|'.join(PHONE_WORDS)})[:\s]*([^\s,]+)', 1)"
    said_digits = rf"LENGTH(regexp_replace({said}, '\D', '', 'g'))"
    return (
        f"CASE WHEN COALESCE({contact}, '') = '' OR UPPER(TRIM({contact})) = 'N/A' THEN false WHEN {ruled_out} THEN false "
        + " ".join(arms)
        + rf" ELSE regexp_full_match({said}, '[\d\s().+\-]{{7,}}') AND {said_digits} BETWEEN 7 AND 15 END"
    )


_column("phone_flag", "results", "result_id", lambda: phone_flag(c("business_contact")), phone_sql("business_contact"))
_column("phone_flag_intended", "results", "result_id", lambda: phone_flag(c("business_contact"), "intended"),
        phone_sql("business_contact", "intended"))


# outside ASCII the engines draw word boundaries differently, so other letters become an x
_PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"


@register("phone_flag_documents", f"SELECT doc_id, {phone_sql('text')} AS value FROM (SELECT doc_id, {_PLAIN} AS text FROM documents) d")
def _(m):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return m.table("documents").select("doc_id", phone_flag(plain).alias("value"))


@register("normalize_response", f"""
WITH cut AS (SELECT doc_id, response_text AS raw, {strip_sql('response_text')} AS t FROM f_responses),
opened AS (SELECT doc_id, raw, CASE WHEN t LIKE '```json%' THEN SUBSTRING(t, 8) ELSE t END AS t FROM cut),
bare AS (SELECT doc_id, raw, CASE WHEN t LIKE '%```' THEN LEFT(t, -3) ELSE t END AS t FROM opened),
kinds AS (SELECT doc_id, raw, t, CASE WHEN json_valid(t) THEN json_type(t) END AS kind FROM bare),
judged AS (SELECT *, CASE WHEN raw = '' THEN 'Empty response' WHEN kind IS NOT NULL AND kind <> 'OBJECT'
 THEN 'Answer is not a JSON object' END AS error, CASE WHEN kind = 'OBJECT' THEN t END AS j FROM kinds)
SELECT doc_id, error IS NULL AS success,
 CASE WHEN error IS NOT NULL THEN NULL WHEN kind = 'OBJECT' THEN LOWER(json_extract_string(j, '$.store_image')) IN ('true', 'yes', '1') ELSE false END AS store_image,
 CASE WHEN error IS NOT NULL THEN NULL WHEN kind = 'OBJECT' THEN json_extract_string(j, '$.text_content') ELSE t END AS text_content,
 json_extract_string(j, '$.store_name') AS store_name, json_extract_string(j, '$.business_contact') AS business_contact,
 CASE WHEN error IS NOT NULL THEN NULL WHEN kind = 'OBJECT' THEN json_extract_string(j, '$.image_description') ELSE LEFT(t, 200) END AS image_description,
 CASE WHEN error IS NOT NULL THEN NULL WHEN kind = 'OBJECT' THEN {phone_sql("json_extract_string(j, '$.business_contact')")} ELSE false END AS phone_number,
 error FROM judged""")
def _(m):
    return answers.normalize_response(m.responses, "response_text").drop("response_text")
