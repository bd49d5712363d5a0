"""Ingest, exports, and joins between the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.functions.phone import phone_flag
from batchloom.functions.scalars import url_sha256
from batchloom.operators import filters, ingest, relations
from batchloom.operators.relations import Store
from batchloom.operators.skew import skew_join
from batchloom.plans.catalog import as_of, r6, register
from batchloom.plans.columns import CLEAN_URLS_SQL, clean_urls, phone_sql
from batchloom.plans.listings import iso
from batchloom.sinks import exports

c = F.col
_UNIQUE_SQL = f"(SELECT batch_id, url, MIN(seq) AS seq FROM {CLEAN_URLS_SQL} c GROUP BY batch_id, url)"
_ASSIGNED_SQL = f"""(SELECT batch_id, url, seq, n AS position, CAST(FLOOR((n - 1) / 10) AS INT) + 1 AS chunk_number FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY seq) AS n FROM {_UNIQUE_SQL} u) t)"""


def unique_urls(m):
    return ingest.dedupe_first_seen(clean_urls(m))


@register("dedupe_first_seen", f"SELECT batch_id, seq, url FROM {_UNIQUE_SQL} u")
def _(m):
    return unique_urls(m)


@register("assign_chunks", f"SELECT batch_id, seq, url, position, chunk_number FROM {_ASSIGNED_SQL} a")
def _(m):
    return ingest.assign_chunks(unique_urls(m), 10)


@register("chunk_rows", f"""
SELECT batch_id, chunk_number, COUNT(*) AS url_count, string_agg(url, ' ' ORDER BY position) AS urls, 'pending' AS status
FROM {_ASSIGNED_SQL} a GROUP BY batch_id, chunk_number""")
def _(m):
    rows = ingest.chunk_rows(ingest.assign_chunks(unique_urls(m), 10), with_urls=True)
    return rows.withColumn("urls", F.array_join("urls", " "))


@register("assign_subbatches", """
SELECT result_id, batch_id, chunk_number, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY batch_id, chunk_number
 ORDER BY created_at, result_id) - 1) / 4) AS INT) + 1 AS sub_batch FROM f_results_c""")
def _(m):
    rows = ingest.assign_subbatches(m.results_c, [c("created_at"), c("result_id")], 4)
    return rows.select("result_id", "batch_id", "chunk_number", "sub_batch")


@register("create_batch", f"""
SELECT batch_id, 'Batch_20240131_000000' AS batch_name, COUNT(*) AS total_urls, CAST(10 AS INT) AS chunk_size,
 CAST(CEIL(COUNT(*) / 10.0) AS BIGINT) AS total_chunks, 'pending' AS status,
 ROUND(COUNT(*) / 1800.0, 6) AS estimated_time_hours, {{AS_OF}} AS created_at
FROM {_UNIQUE_SQL} u GROUP BY batch_id""")
def _(m):
    out = ingest.batch_rows(unique_urls(m), as_of(), 10, keys=2)
    return out.withColumn("estimated_time_hours", r6(c("estimated_time_hours")))


# --- exports --------------------------------------------------------------------

FULL_SQL = f"""(SELECT *, CAST(NULL AS STRING) AS image_description, {phone_sql('business_contact')} AS phone_number FROM f_results)"""


def full_results(m):
    return m.results.withColumns(
        {"image_description": F.lit(None).cast("string"), "phone_number": phone_flag(c("business_contact"))}
    )


def _layout_sql(phone: str) -> str:
    return f"""url, CASE WHEN store_image THEN 'Yes' ELSE 'No' END AS store_front, COALESCE(text_content, '') AS text_content,
 COALESCE(store_name, '') AS store_name, COALESCE(business_contact, '') AS business_contact,
 CASE WHEN {phone} THEN 'Yes' ELSE 'No' END AS phone_number, '' AS image_description,
 COALESCE(error_message, '') AS error_message, COALESCE(processing_time_seconds, 0.0) AS processing_time_seconds,
 {iso('created_at')} AS created_at, batch_id"""


_CONTACT = "COALESCE(business_contact, '') <> ''"


@register("export_results_csv", f"SELECT {_layout_sql(_CONTACT)} FROM f_results")
def _(m):
    return exports.csv_rows(full_results(m))


@register("export_sheet_layout", f"""
SELECT url AS "URL", store_front AS "Store Front", text_content AS "Text Content", store_name AS "Store Name",
 business_contact AS "Business Contact", phone_number AS "Phone Number", image_description AS "Image Description",
 error_message AS "Error Message", processing_time_seconds AS "Processing Time (seconds)", ts AS "Created At",
 batch_id AS "Batch ID" FROM (SELECT created_at AS ts, {_layout_sql('phone_number')} FROM {FULL_SQL} r) t""")
def _(m):
    return exports.sheet_rows(full_results(m))


@register("export_results_json", f"""
SELECT CAST(result_id AS BIGINT) AS result_id, CAST(batch_id AS BIGINT) AS batch_id, url, success, store_image, store_name,
 text_content, error_message, processing_time_seconds, cache_hit, phone_number, {iso('created_at')} AS created_at, true AS has_all_fields
FROM {FULL_SQL} r""")
def _(m):
    lines = exports.json_rows(full_results(m))
    shape = ("result_id long, batch_id long, url string, success boolean, store_image boolean, store_name string, "
             "text_content string, error_message string, processing_time_seconds double, cache_hit boolean, "
             "phone_number boolean, created_at string")
    keys = F.size(F.json_object_keys("value")) == len(full_results(m).columns)
    return lines.select(F.from_json("value", shape).alias("j"), keys.alias("has_all_fields")).select("j.*", "has_all_fields")


@register("export_metadata", """
SELECT b.batch_id, batch_name, {AS_OF} AS export_date, 'csv' AS format, COALESCE(n, 0) AS record_count,
 total_urls AS total_batch_urls, status AS batch_status, '{"failed_only": true}' AS filters_applied, '1.0' AS export_version
FROM f_batches b LEFT JOIN (SELECT batch_id, COUNT(*) AS n FROM f_results WHERE NOT success GROUP BY batch_id) r
 ON b.batch_id = r.batch_id""")
def _(m):
    rows = filters.where(m.results, filters.failed_only())
    return exports.export_metadata(m.batches, rows, "csv", as_of(), '{"failed_only": true}')


_ASKED = [3, 7, 11, 42, 100, -5]
_ASKED_SQL = "(" + ", ".join(map(str, _ASKED)) + ")"


@register("export_multi", f"""
SELECT {_layout_sql(_CONTACT)} FROM f_results WHERE batch_id IN {_ASKED_SQL} AND batch_id IN (SELECT batch_id FROM f_batches)""")
def _(m):
    return exports.multi_rows(m.batches, full_results(m), _ASKED).drop("result_id")


@register("export_multi_summary", f"""
SELECT a.batch_id, COALESCE(n, 0) AS record_count,
 CASE WHEN b.batch_id IS NULL THEN 'Batch ' || CAST(a.batch_id AS STRING) || ' not found' END AS error
FROM (SELECT CAST(unnest([{", ".join(map(str, _ASKED))}]) AS BIGINT) AS batch_id) a LEFT JOIN f_batches b ON a.batch_id = b.batch_id
LEFT JOIN (SELECT batch_id, COUNT(*) AS n FROM f_results GROUP BY batch_id) r ON a.batch_id = r.batch_id""")
def _(m):
    return exports.multi_summary(m.batches, m.results, _ASKED)


@register("export_bulk_csv", f"""
SELECT {_layout_sql(_CONTACT)} FROM f_results WHERE batch_id IN (SELECT batch_id FROM f_commands)
 AND batch_id IN (SELECT batch_id FROM f_batches)""")
def _(m):
    return exports.bulk_rows(m.batches, full_results(m), m.commands)


@register("export_filtered", f"""
SELECT {_layout_sql('phone_number')} FROM (SELECT * FROM {FULL_SQL} r WHERE store_name ILIKE '%store 2%'
 AND created_at >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY created_at ASC NULLS LAST, result_id LIMIT 200) t""")
def _(m):
    return exports.filtered_rows(full_results(m), start="2024-01-05 00:00:00", store_name="store 2", limit=200)


@register("export_filtered_all", f"SELECT {_layout_sql('phone_number')} FROM {FULL_SQL} r WHERE NOT success")
def _(m):
    return exports.filtered_rows(full_results(m), only_failed=True)


@register("export_page_layout", f"""
SELECT CASE WHEN store_image THEN 'true' ELSE 'false' END AS store_front, COALESCE(text_content, '') AS text_content,
 COALESCE(store_name, '') AS store_name, COALESCE(business_contact, '') AS business_contact,
 CASE WHEN phone_number THEN 'true' ELSE 'false' END AS phone_number, '' AS image_description, COALESCE(url, '') AS url,
 CASE WHEN processing_time_seconds <> 0 THEN CAST(processing_time_seconds AS STRING) ELSE '' END AS processing_time_seconds,
 {iso('created_at')} AS created_at, CAST(batch_id AS STRING) AS batch_id
FROM {FULL_SQL} r WHERE {_CONTACT}""")
def _(m):
    return exports.page_rows(full_results(m), filters.contact_present("true"))


@register("export_guard", "SELECT COUNT(*) AS row_count, COUNT(*) <= 1000000 AS allowed FROM f_results WHERE success")
def _(m):
    return exports.export_guard(m.results.filter("success"))


@register("export_filename", r"""
SELECT batch_id, replace(trim(regexp_replace(batch_name, '[^\pL\pN _-]', '', 'g')), ' ', '_') || '_'
 || strftime(created_at, '%Y%m%d_%H%M%S') || '.csv' AS filename FROM f_batches""")
def _(m):
    return m.batches.select("batch_id", exports.export_filename(c("batch_name"), c("created_at"), "csv").alias("filename"))


@register("append_results", """
WITH fresh AS (SELECT *, sha256(url) AS url_hash FROM f_results),
firsts AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id, url_hash ORDER BY created_at, result_id) AS rn
 FROM fresh WHERE batch_id IN (SELECT batch_id FROM f_batches WHERE status <> 'cancelled')) t WHERE rn = 1)
SELECT result_id, batch_id, url, url_hash, success, created_at FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM fresh s WHERE s.cache_hit AND s.batch_id = f.batch_id AND s.url_hash = f.url_hash)""")
def _(m):
    hashed = m.results.withColumn("url_hash", url_sha256(c("url")))
    known = m.batches.filter(c("status") != "cancelled")
    out = exports.new_result_rows(hashed.filter("cache_hit"), known, hashed)
    return out.select("result_id", "batch_id", "url", "url_hash", "success", "created_at")


@register("dedupe_against_store", """
WITH fresh AS (SELECT *, sha256(url) AS url_hash FROM f_results)
SELECT result_id, batch_id, url_hash FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM fresh s WHERE NOT s.success AND s.batch_id = f.batch_id AND s.url_hash = f.url_hash)""")
def _(m):
    hashed = m.results.withColumn("url_hash", url_sha256(c("url"))).select("result_id", "batch_id", "url_hash", "success")
    stored = hashed.filter(~c("success")).select("batch_id", "url_hash").distinct()
    return skew_join(hashed, stored, ["batch_id", "url_hash"], "left_anti", ["result_id"]).drop("success")


@register("result_to_struct", f"""
SELECT CAST(result_id AS STRING) AS result_id, CAST(batch_id AS STRING) AS batch_id, url, success, store_image, store_name,
 business_contact, error_message, processing_time_seconds, text_content, cache_hit, {iso('created_at')} AS created_at FROM f_results""")
def _(m):
    return exports.result_objects(m.results)


@register("batch_to_struct", f"""
SELECT CAST(batch_id AS STRING) AS batch_id, batch_name, status, error_message, {iso('created_at')} AS created_at,
 {iso('started_at')} AS started_at, total_urls, total_chunks, processed_count, successful_count, failed_count,
 ROUND(CASE WHEN total_urls > 0 THEN 100.0 * processed_count / total_urls ELSE 0 END, 6) AS progress_percentage,
 status IN ('pending', 'queued', 'processing') AS is_active FROM f_batches""")
def _(m):
    out = exports.batch_objects(m.batches)
    return out.withColumn("progress_percentage", r6(c("progress_percentage")))


# --- joins ----------------------------------------------------------------------

def store(m):
    return Store(m.batches, m.chunks, m.results)


@register("batch_with_chunks", """
SELECT b.batch_id, batch_name, b.status AS batch_status, k.chunk_id, chunk_number, k.status AS chunk_status, url_count
FROM f_batches b LEFT JOIN f_chunks k ON b.batch_id = k.batch_id""")
def _(m):
    return relations.batch_with_chunks(m.batches, m.chunks)


def _preview_sql(doomed: str) -> str:
    return f"""SELECT COUNT(DISTINCT b.batch_id) AS batches_to_delete, COUNT(DISTINCT k.chunk_id) AS chunks_to_delete,
 COUNT(DISTINCT r.result_id) AS results_to_delete FROM f_batches b LEFT JOIN f_chunks k ON b.batch_id = k.batch_id
 LEFT JOIN f_results r ON b.batch_id = r.batch_id WHERE {doomed}"""


def _survivors_sql(doomed: str) -> str:
    gone = f"(SELECT batch_id FROM f_batches WHERE {doomed})"
    return f"""SELECT 'batches' AS table_name, batch_id AS id FROM f_batches WHERE batch_id NOT IN {gone}
UNION ALL SELECT 'chunks', chunk_id FROM f_chunks WHERE batch_id NOT IN {gone}
UNION ALL SELECT 'results', result_id FROM f_results WHERE batch_id NOT IN {gone}"""


def _survivors(left: Store):
    parts = [(left.batches, "batch_id"), (left.chunks, "chunk_id"), (left.results, "result_id")]
    named = [d.select(F.lit(n).alias("table_name"), c(k).alias("id"))
             for n, (d, k) in zip(("batches", "chunks", "results"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


_OLD = "created_at < {AS_OF} - INTERVAL '20' DAY"
_OVER = "status IN ('failed', 'cancelled')"


@register("retention_preview", _preview_sql("b." + _OLD))
def _(m):
    return relations.retention_preview(store(m), relations.older_than(20, as_of()))


@register("retention_preview_status", _preview_sql("b." + _OVER))
def _(m):
    return relations.retention_preview(store(m), relations.in_status("failed", "cancelled"))


@register("cascade_delete_old", _survivors_sql(_OLD))
def _(m):
    return _survivors(relations.delete_matching(store(m), relations.older_than(20, as_of())))


@register("cascade_delete_status", _survivors_sql(_OVER))
def _(m):
    return _survivors(relations.delete_matching(store(m), relations.in_status("failed", "cancelled")))


@register("cascade_delete_batch", """
SELECT q.batch_id, b.batch_id IS NOT NULL AND b.status NOT IN ('pending', 'queued', 'processing') AS accepted,
 CASE WHEN b.batch_id IS NULL THEN 'not found' WHEN b.status IN ('pending', 'queued', 'processing') THEN 'active' END AS reason
FROM f_commands q LEFT JOIN f_batches b ON q.batch_id = b.batch_id""")
def _(m):
    return relations.delete_batches(store(m), m.commands)[1]


@register("cascade_delete_batch_rest",
          _survivors_sql("batch_id IN (SELECT batch_id FROM f_commands) AND status NOT IN ('pending', 'queued', 'processing')"))
def _(m):
    return _survivors(relations.delete_batches(store(m), m.commands)[0])


def _cloned(m):
    wanted = m.batches.filter(c("status") == "completed").select(
        "batch_id", (c("batch_id") + 1_000_000).alias("new_batch_id"),
        F.concat(F.lit("Copy of "), c("batch_name")).alias("new_name"),
    )
    results = m.results_c.withColumn("chunk_id", c("batch_id") * 1_000_000_000 + c("chunk_number")).drop("chunk_number")
    return relations.clone_batches(Store(m.batches, m.chunks, results), wanted, as_of(), copy_results=True)


_WANTED = "batch_id IN (SELECT batch_id FROM f_batches WHERE status = 'completed')"
_NEW_CHUNK = "md5(CAST(batch_id + 1000000 AS STRING) || ':' || CAST(chunk_number AS STRING))"


@register("clone_batch", f"""
SELECT batch_id + 1000000 AS batch_id, 'Copy of ' || batch_name AS batch_name, total_urls, total_chunks, 'pending' AS status,
 {{AS_OF}} AS created_at FROM f_batches WHERE {_WANTED}""")
def _(m):
    return _cloned(m).batches


@register("clone_batch_chunks", f"""
SELECT batch_id + 1000000 AS batch_id, {_NEW_CHUNK} AS chunk_id, chunk_number, url_count, 'pending' AS status FROM f_chunks
WHERE {_WANTED}""")
def _(m):
    return _cloned(m).chunks


@register("clone_batch_results", f"""
SELECT md5({_NEW_CHUNK} || ':' || CAST(result_id AS STRING)) AS result_id, batch_id + 1000000 AS batch_id,
 {_NEW_CHUNK} AS chunk_id, url, success, store_image, text_content, store_name, business_contact, error_message,
 processing_time_seconds, {{AS_OF}} AS created_at FROM f_results_c WHERE {_WANTED}""")
def _(m):
    return _cloned(m).results


@register("batch_details", f"""
SELECT b.batch_id, batch_name, b.status, {iso('created_at')} AS created_at, total_urls, processed_count, successful_count,
 ROUND(CASE WHEN total_urls > 0 THEN 100.0 * processed_count / total_urls ELSE 0 END, 2) AS progress_percentage,
 COALESCE(t, 0) AS chunks_total, COALESCE(d, 0) AS chunks_completed, COALESCE(p, 0) AS chunks_processing,
 COALESCE(w, 0) AS chunks_pending, r.urls AS recent_results
FROM f_batches b LEFT JOIN (SELECT batch_id, COUNT(*) AS t, COUNT(*) FILTER (WHERE status = 'completed') AS d,
 COUNT(*) FILTER (WHERE status = 'processing') AS p, COUNT(*) FILTER (WHERE status = 'pending') AS w FROM f_chunks GROUP BY batch_id) k
 ON b.batch_id = k.batch_id
LEFT JOIN (SELECT batch_id, string_agg(CAST(result_id AS STRING) || ' ' || url, '; ' ORDER BY rank) AS urls FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY created_at DESC NULLS FIRST, result_id) AS rank FROM f_results) t
 WHERE rank <= 10 GROUP BY batch_id) r ON b.batch_id = r.batch_id""")
def _(m):
    told = F.transform("recent_results", lambda r: F.concat_ws(" ", r.result_id.cast("string"), r.url))
    return relations.batch_details(store(m)).withColumn("recent_results", F.array_join(told, "; "))


@register("fail_chunks", """
SELECT batch_id, chunk_number, chunk_id, url_count, processed_count, successful_count, failed_count,
 CASE WHEN hit THEN 'failed' ELSE status END AS status,
 CASE WHEN hit THEN 'Worker lost in ' || CAST(chunk_number AS STRING) ELSE error_message END AS error_message, started_at,
 CASE WHEN hit THEN {AS_OF} ELSE completed_at END AS completed_at,
 CASE WHEN hit THEN (epoch_us({AS_OF}) - epoch_us(started_at)) / 1e6 END AS processing_time_seconds
FROM (SELECT *, status = 'processing' AS hit FROM f_chunks) k""")
def _(m):
    lost = m.chunks.filter(c("status") == "processing").select(
        "batch_id", "chunk_id", F.concat(F.lit("Worker lost in "), c("chunk_number").cast("string")).alias("message"))
    return relations.fail_chunks(m.chunks, lost, as_of())


@register("stuck_chunk_cascade", """
SELECT k.batch_id, chunk_number, chunk_id, url_count, processed_count, successful_count, failed_count,
 CASE WHEN hit THEN 'failed' ELSE status END AS status,
 CASE WHEN hit THEN 'Batch cleaned up by admin' ELSE error_message END AS error_message, started_at, completed_at
FROM (SELECT *, status IN ('pending', 'processing') AND batch_id IN (SELECT batch_id FROM f_batches
 WHERE status IN ('pending', 'queued', 'processing') AND created_at < {AS_OF} - INTERVAL '1' DAY) AS hit FROM f_chunks) k""")
def _(m):
    stuck = m.batches.filter(c("status").isin("pending", "queued", "processing") & relations.older_than(1, as_of()))
    return relations.fail_chunks_of(m.chunks, stuck)
