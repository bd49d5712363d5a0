"""Filters, pages and top lists."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from batchloom.operators import anchors, filters, paging
from batchloom.operators.paging import Listing
from batchloom.plans.catalog import register
from batchloom.session import staging_dir

_ISO = """CASE WHEN strftime({c}, '%f') = '000000' THEN strftime({c}, '%Y-%m-%dT%H:%M:%S')
 ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"""


def iso(column: str) -> str:
    return _ISO.replace("{c}", column)


LISTING_SQL = f"""success, store_image, text_content, store_name, business_contact,
 COALESCE(business_contact, '') <> '' AS phone_number, CAST(NULL AS STRING) AS image_description, url,
 processing_time_seconds, {iso('created_at')} AS created_at, batch_id"""


def described(results):
    return results.withColumn("image_description", F.lit(None).cast("string"))


def _filter(name, predicate, sql, source="results"):
    @register(name, f"SELECT * FROM f_{source} WHERE {sql}")
    def run(m):
        return filters.where(getattr(m, source), predicate())


_filter("filter_status", lambda: filters.status_is("processing"), "status = 'processing'", "batches")
_filter("exclude_soft_deleted", lambda: filters.not_soft_deleted(),
        "NOT (status = 'cancelled' AND error_message LIKE '%Soft deleted%')", "batches")
_filter("filter_success", lambda: filters.success_is("success"), "success")
_filter("failed_only", lambda: filters.failed_only(), "NOT success")
_filter("date_range", lambda: filters.compose([filters.created_from("2024-01-08 00:00:00"),
                                       filters.created_until("2024-01-21 12:00:00")]),
        "created_at >= TIMESTAMP '2024-01-08 00:00:00' AND created_at <= TIMESTAMP '2024-01-21 12:00:00'")
_filter("has_store_name", lambda: filters.has_store_name(), "store_name IS NOT NULL")
_filter("has_contact_value", lambda: filters.has_contact_value(), "business_contact IS NOT NULL")
_filter("batch_id_in", lambda: filters.batch_id_in([3, 7, 11, 42]), "batch_id IN (3, 7, 11, 42)")
_filter("store_name_ilike", lambda: filters.store_name_like("STORE 1"), "store_name ILIKE '%STORE 1%'")
_filter("store_image_tri", lambda: filters.store_image_is("false"), "store_image = false")
_filter("batch_id_match", lambda: filters.batch_id_matches("12"), "CAST(batch_id AS STRING) ILIKE '%12%'")
_filter("contact_present", lambda: filters.contact_present("true"), "business_contact IS NOT NULL AND business_contact <> ''")
_filter("contact_missing", lambda: filters.contact_present("false"), "business_contact IS NULL OR business_contact = ''")
_filter("compose_filters",
        lambda: Listing(store_image="true", contact="true", batch_id="1", success="true").predicate(),
        "store_image AND business_contact IS NOT NULL AND business_contact <> '' "
        "AND CAST(batch_id AS STRING) ILIKE '%1%' AND success")
_filter("page_success", lambda: Listing(success="false").predicate(), "NOT success")


@register("batches_semi_filter", """
SELECT r.* FROM f_results r WHERE batch_id IN (SELECT batch_id FROM f_batches WHERE status = 'completed')""")
def _(m):
    wanted = m.batches.filter(filters.status_is("completed"))
    return filters.keep_batches(m.results, wanted, ["result_id"])


@register("page_results", f"""
SELECT {LISTING_SQL} FROM (SELECT * FROM f_results WHERE business_contact IS NOT NULL AND business_contact <> ''
 ORDER BY created_at DESC NULLS FIRST, result_id LIMIT 25 OFFSET 25) t""")
def _(m):
    return paging.page_results(described(m.results), Listing(page=2, contact="true"))


@register("page_results_deep", f"""
SELECT {LISTING_SQL} FROM (SELECT * FROM f_results
 ORDER BY processing_time_seconds ASC NULLS LAST, result_id LIMIT 5000 OFFSET 40000) t""")
def _(m):
    ask = Listing(page=9, per_page=5000, sort="processing_time_seconds:asc")
    return paging.page_results(described(m.results), ask, deep_from=1000)


@register("page_results_anchored", f"""
WITH o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY processing_time_seconds ASC NULLS LAST, result_id) AS rn, COUNT(*) OVER () AS total FROM f_results
 WHERE business_contact IS NOT NULL AND business_contact <> '')
SELECT {LISTING_SQL} FROM o WHERE rn <= 37 OR (rn - 1) // 37 = ((total - 1) // 37) // 2 OR (rn - 1) // 37 = (total - 1) // 37""")
def _(m):
    # the first, the middle and the last page of one listing, sorted once
    path, rows = f"{staging_dir(m.spark)}/listing-{uuid.uuid4().hex}", described(m.results)
    ask = Listing(per_page=37, sort="processing_time_seconds:asc", contact="true")
    last = (anchors.write_results_listing(rows, path, ask, slice_rows=20_000) - 1) // 37
    out = None
    for page in sorted({0, last // 2, last}):
        one = anchors.page_of_results(rows, path, replace(ask, page=page + 1))
        out = one if out is None else out.unionByName(one)
    return out


@register("page_total", """
SELECT CAST(1 AS INT) AS page, CAST(25 AS INT) AS per_page, COUNT(*) AS total FROM f_results
WHERE store_image AND business_contact IS NOT NULL AND business_contact <> ''""")
def _(m):
    return paging.page_total(m.results, Listing(store_image="true", contact="true"))


@register("sort_whitelist", f"""
SELECT {LISTING_SQL} FROM (SELECT * FROM f_results ORDER BY store_name DESC NULLS FIRST, result_id LIMIT 50) t""")
def _(m):
    return paging.page_results(described(m.results), Listing(per_page=50, sort="store_name:desc"))


@register("list_batches", """
SELECT * FROM f_batches WHERE NOT (status = 'cancelled' AND error_message LIKE '%Soft deleted%')
ORDER BY created_at DESC NULLS FIRST, batch_id LIMIT 500""")
def _(m):
    return paging.list_batches(m.batches, limit=500)


@register("page_batches", f"""
WITH kept AS (SELECT * FROM f_batches WHERE NOT (status = 'cancelled' AND error_message LIKE '%Soft deleted%')),
shown AS (SELECT * FROM kept ORDER BY created_at DESC NULLS FIRST, batch_id LIMIT 20 OFFSET 20)
SELECT s.batch_id, batch_name, UPPER(status) AS status, total_urls, COALESCE(n, 0) AS total_chunks,
 COALESCE(c, 0) AS completed_chunks, processed_count, successful_count, failed_count,
 ROUND(CASE WHEN COALESCE(n, 0) > 0 THEN 100.0 * c / n ELSE 0 END, 1) AS progress_percentage,
 {iso('created_at')} AS created_at, {iso('started_at')} AS started_at, error_message,
 (SELECT COUNT(*) FROM shown) = 20 AS has_next
FROM shown s LEFT JOIN (SELECT batch_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'completed') AS c
 FROM f_chunks GROUP BY batch_id) k ON s.batch_id = k.batch_id""")
def _(m):
    return paging.page_batches(m.batches, m.chunks, page=2)


@register("batch_results", """
SELECT result_id, url, success, store_name, business_contact, CAST(NULL AS STRING) AS image_description,
 SUBSTRING(text_content, 1, 500) AS text_content, error_message, processing_time_seconds
FROM f_results WHERE batch_id = 7 AND NOT success""")
def _(m):
    return paging.batch_results(described(m.results), 7, "failed")


@register("preview", f"""
SELECT url, success, store_image, text_content, store_name, business_contact,
 CAST(NULL AS STRING) AS image_description, error_message, {iso('created_at')} AS created_at
FROM (SELECT * FROM f_results WHERE NOT success ORDER BY created_at ASC NULLS LAST, result_id LIMIT 100) t""")
def _(m):
    return paging.preview(described(m.results), only_failed=True)


@register("list_chunks", f"""
SELECT batch_id, chunk_id, chunk_number, status, url_count, processed_count, successful_count, failed_count,
 CASE WHEN url_count > 0 THEN 100.0 * processed_count / url_count ELSE 0 END AS progress_percentage,
 {iso('started_at')} AS started_at, {iso('completed_at')} AS completed_at, error_message FROM f_chunks""")
def _(m):
    return paging.list_chunks(m.chunks)


@register("recent_errors", """
SELECT batch_id, CAST(rank AS INT) AS rank, result_id, url, error_message, created_at FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY created_at DESC NULLS FIRST, result_id) AS rank
 FROM f_results WHERE NOT success AND error_message IS NOT NULL) t WHERE rank <= 5""")
def _(m):
    return paging.recent_errors(m.results)


@register("recent_results", """
SELECT batch_id, CAST(rank AS INT) AS rank, result_id, url, success, store_name, error_message, created_at FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY created_at DESC NULLS FIRST, result_id) AS rank
 FROM f_results) t WHERE rank <= 10""")
def _(m):
    return paging.recent_results(m.results)
