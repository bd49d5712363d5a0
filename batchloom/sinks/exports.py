"""Export layouts and writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from batchloom import schemas
from batchloom.functions.scalars import blank_null, has_contact, is_active, share_pct, strip, yes_no, zero_blank, zero_null
from batchloom.functions.timing import iso_text, moment
from batchloom.operators import filters
from batchloom.operators.paging import sort_order
from batchloom.operators.skew import skew_join

EXPORT_VERSION = "1.0"
FORMATS = ["csv", "json", "xlsx"]


def _text(name: str) -> Column:
    return blank_null(F.col(name))


def batch_layout(phone: Column) -> list[Column]:
    """The eleven columns of a batch export."""
    return [
        F.col("url"), yes_no(F.col("store_image")).alias("store_front"),
        _text("text_content").alias("text_content"), _text("store_name").alias("store_name"),
        _text("business_contact").alias("business_contact"), yes_no(phone).alias("phone_number"),
        _text("image_description").alias("image_description"), _text("error_message").alias("error_message"),
        zero_null(F.col("processing_time_seconds")).alias("processing_time_seconds"),
        _text_time().alias("created_at"), F.col("batch_id"),
    ]


def _text_time() -> Column:
    return F.coalesce(iso_text(F.col("created_at")), F.lit(""))


def in_time_order(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("created_at").asc_nulls_last(), F.col("result_id").asc())


def csv_rows(results: DataFrame) -> DataFrame:
    """Batch export; the phone column tells whether there is any contact."""
    return in_time_order(results).select(*batch_layout(has_contact(F.col("business_contact"))))


def _of_batches(results: DataFrame, batch_ids: Sequence | None) -> DataFrame:
    """The results of the given batches: a short list is a filter, a long one a join."""
    if batch_ids is None or len(batch_ids) <= filters.SHORT_LIST:
        return filters.where(results, filters.batch_id_in(batch_ids))
    ids = results.sparkSession.createDataFrame([(i,) for i in batch_ids], ["batch_id"])
    return filters.keep_batches(results, ids.select(F.col("batch_id").cast(results.schema["batch_id"].dataType)), ["result_id"])


def filtered_rows(
    results: DataFrame, batch_ids: Sequence | None = None, only_failed: bool = False, start=None, end=None,
    store_name: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Export across batches; the phone column is the phone flag.

    All rows unless the caller sets a limit; who wants the reference size of an
    export respected asks ``require_export_size`` first.
    """
    rows = filters.where(
        _of_batches(results, batch_ids), filters.failed_only(only_failed), filters.created_from(start),
        filters.created_until(end), filters.store_name_like(store_name),
    )
    if limit is not None:
        # an order makes the rows the same ones each time
        rows = in_time_order(rows).limit(limit)
    return rows.select(*batch_layout(F.col("phone_number")))


def filtered_batch_rows(
    results: DataFrame, batch_id, only_failed: bool = False, start=None, end=None, with_store_name: bool = False,
    with_contact: bool = False,
) -> DataFrame:
    """The rows of one batch that pass the filters of a batch export."""
    return filters.where(
        results, F.col("batch_id") == batch_id, filters.failed_only(only_failed), filters.created_from(start),
        filters.created_until(end), filters.has_store_name(with_store_name), filters.has_contact_value(with_contact),
    )


# Headings of the sheet, in order, over the columns of the batch export.
SHEET_HEADINGS = {
    "url": "URL", "store_front": "Store Front", "text_content": "Text Content", "store_name": "Store Name",
    "business_contact": "Business Contact", "phone_number": "Phone Number",
    "image_description": "Image Description", "error_message": "Error Message",
    "processing_time_seconds": "Processing Time (seconds)", "created_at": "Created At", "batch_id": "Batch ID",
}


def sheet_rows(results: DataFrame) -> DataFrame:
    """The spreadsheet layout; here times stay times and the phone column is the phone flag."""
    rows = results.select(*batch_layout(F.col("phone_number")), F.col("created_at").alias("__ts"), "result_id")
    ordered = rows.orderBy(F.col("__ts").asc_nulls_last(), "result_id").withColumn("created_at", F.col("__ts"))
    return ordered.select(*[F.col(c).alias(h) for c, h in SHEET_HEADINGS.items()])


def page_rows(results: DataFrame, *predicates: Column | None) -> DataFrame:
    """The ten-column layout of the listing's export, newest first."""
    rows = filters.where(results, *predicates).orderBy(*sort_order("created_at:desc"))
    return rows.select(
        yes_no(F.col("store_image"), "true", "false").alias("store_front"),
        _text("text_content").alias("text_content"), _text("store_name").alias("store_name"),
        _text("business_contact").alias("business_contact"),
        yes_no(F.col("phone_number"), "true", "false").alias("phone_number"),
        _text("image_description").alias("image_description"), _text("url").alias("url"),
        zero_blank(F.col("processing_time_seconds")).alias("processing_time_seconds"),
        _text_time().alias("created_at"), F.coalesce(F.col("batch_id").cast("string"), F.lit("")).alias("batch_id"),
    )


def json_rows(results: DataFrame) -> DataFrame:
    """One JSON object per result, with every field; absent values are null, not left out."""
    fields = [
        iso_text(F.col(c)).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in results.dtypes
    ]
    return results.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def export_metadata(
    batches: DataFrame, rows: DataFrame, fmt: str, as_of, filters_applied: str = "{}", version: str = EXPORT_VERSION
) -> DataFrame:
    """One row per batch about an export of ``rows``."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}; supported: {', '.join(FORMATS)}")
    counts = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return batches.join(counts, "batch_id", "left").select(
        "batch_id", "batch_name", moment(as_of).alias("export_date"), F.lit(fmt).alias("format"),
        F.coalesce("n", F.lit(0)).alias("record_count"), F.col("total_urls").alias("total_batch_urls"),
        F.col("status").alias("batch_status"), F.lit(filters_applied).alias("filters_applied"),
        F.lit(version).alias("export_version"),
    )


def export_filename(name: Column, as_of: Column, fmt: str) -> Column:
    safe = strip(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))
    return F.concat(
        F.regexp_replace(safe, " ", "_"), F.lit("_"), F.date_format(as_of, "yyyyMMdd_HHmmss"), F.lit(f".{fmt}")
    )


def export_guard(rows: DataFrame, limit: int = schemas.MAX_EXPORT_ROWS) -> DataFrame:
    """Row count and whether it may be exported. Counting reads the filter columns only."""
    return rows.agg(F.count(F.lit(1)).alias("row_count")).withColumn("allowed", F.col("row_count") <= limit)


def require_export_size(rows: DataFrame, limit: int = schemas.MAX_EXPORT_ROWS) -> None:
    verdict = export_guard(rows, limit).head()
    if not verdict.allowed:
        raise ValueError(f"export of {verdict.row_count} rows exceeds the maximum of {limit}")


def multi_summary(batches: DataFrame, results: DataFrame, batch_ids: Sequence) -> DataFrame:
    """One line per asked batch: its row count, or an error when it is unknown."""
    ids = list(dict.fromkeys(batch_ids))
    kind = batches.schema["batch_id"].dataType
    asked = batches.sparkSession.createDataFrame([(i,) for i in ids], ["batch_id"]).select(
        F.col("batch_id").cast(kind)
    )
    counts = _of_batches(results, ids).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    known = batches.select("batch_id", F.lit(True).alias("known"))
    return asked.join(known, "batch_id", "left").join(counts, "batch_id", "left").select(
        "batch_id", F.coalesce("n", F.lit(0)).alias("record_count"),
        F.when(F.col("known").isNull(), F.concat(F.lit("Batch "), F.col("batch_id").cast("string"), F.lit(" not found")))
        .alias("error"),
    )


def multi_rows(batches: DataFrame, results: DataFrame, batch_ids: Sequence) -> DataFrame:
    """The batch layout for the known ones of the given batches; any number of ids will do."""
    known = _of_batches(batches.withColumn("result_id", F.col("batch_id")), list(batch_ids)).select("batch_id")
    wanted = _of_batches(results, list(batch_ids))
    if len(batch_ids) <= filters.SHORT_LIST:
        # as many rows as there are ids
        rows = wanted.join(F.broadcast(known), "batch_id", "left_semi")
    else:
        rows = skew_join(wanted, known, ["batch_id"], "left_semi", ["result_id"])
    return rows.select(*batch_layout(has_contact(F.col("business_contact"))), "result_id")


def bulk_rows(batches: DataFrame, results: DataFrame, ids: DataFrame) -> DataFrame:
    """The batches in ``ids`` as one table, unknown ones left out; any number of ids will do."""
    known = batches.select("batch_id").join(ids.select("batch_id"), "batch_id", "left_semi")
    rows = skew_join(results, known, ["batch_id"], "left_semi", ["result_id"])
    ordered = rows.orderBy("batch_id", F.col("created_at").asc_nulls_last(), "result_id")
    return ordered.select(*batch_layout(has_contact(F.col("business_contact"))))


def result_objects(results: DataFrame) -> DataFrame:
    """Results with times as ISO text and ids as text, as an interface shows them."""
    out = results
    for name, kind in results.dtypes:
        if kind.startswith("timestamp"):
            out = out.withColumn(name, iso_text(F.col(name)))
        elif name.endswith("_id"):
            out = out.withColumn(name, F.col(name).cast("string"))
    return out


def batch_objects(batches: DataFrame) -> DataFrame:
    return result_objects(batches).withColumns({
        "progress_percentage": share_pct(F.col("processed_count"), F.col("total_urls")),
        "is_active": is_active(F.col("status")),
    })


# blanks at the ends of a text are part of it
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(rows: DataFrame, path: str, per_file: int = 0) -> None:
    """CSV part files with header, also for no rows. Order in ``rows`` is kept across part files."""
    out = rows.write.mode("errorifexists").options(**CSV_OPTIONS)
    out.option("maxRecordsPerFile", per_file).csv(path)


def write_json(results: DataFrame, path: str) -> None:
    """JSON lines."""
    json_rows(in_time_order(results)).write.mode("errorifexists").text(path)


def write_by_batch(rows: DataFrame, path: str) -> None:
    """One folder per batch, each in time order.

    The range partitioning takes in time and id, so a batch with most rows is
    written by many tasks.
    """
    order = ["batch_id", "created_at", "result_id"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("result_id")
    spread.write.mode("errorifexists").partitionBy("batch_id").options(**CSV_OPTIONS).csv(path)


def export_batch(
    batches: DataFrame, results: DataFrame, batch_id, path: str, as_of, fmt: str = "csv",
    limit: int | None = None, **only,
) -> DataFrame:
    """Write the results of one batch to ``path``/data and its metadata row to ``path``/metadata.

    ``only`` takes the filters of ``filtered_batch_rows``. An unknown batch or
    format is an error, and so are more rows than ``limit`` where that is given,
    raised before anything is written. The layout "xlsx" is written as CSV and
    its file name says so.
    """
    batch = batches.filter(F.col("batch_id") == batch_id)
    rows = filtered_batch_rows(results, batch_id, **only)
    applied = json.dumps({k: str(v) for k, v in only.items() if v})
    about = export_metadata(batch, rows, fmt, as_of, applied)
    found = about.head()
    if found is None:
        raise ValueError(f"batch {batch_id} not found")
    if limit is not None and found.record_count > limit:
        raise ValueError(f"export of {found.record_count} rows exceeds the maximum of {limit}")
    name = export_filename(F.col("batch_name"), moment(as_of), "json" if fmt == "json" else "csv")
    about = about.withColumn("filename", name)
    if fmt == "json":
        write_json(rows, f"{path}/data")
    else:
        write_csv(csv_rows(rows) if fmt == "csv" else sheet_rows(rows), f"{path}/data")
    about.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/metadata")
    return about


def export_batches(batches: DataFrame, results: DataFrame, batch_ids: Sequence, path: str) -> DataFrame:
    """Write batches, a folder each, and a summary with an error line per unknown batch."""
    summary = multi_summary(batches, results, batch_ids)
    write_by_batch(multi_rows(batches, results, batch_ids), f"{path}/batches")
    write_csv(summary.orderBy("batch_id"), f"{path}/summary")
    return summary


def new_result_rows(stored: DataFrame, batches: DataFrame, fresh: DataFrame, dedupe: bool = True) -> DataFrame:
    """Fresh results worth storing: of a known batch and, with ``dedupe``, not stored yet.

    ``fresh`` and ``stored`` carry url_hash. Of equal fresh rows the one with the
    smallest created_at and result_id stays.
    """
    known = skew_join(fresh, batches.select("batch_id"), ["batch_id"], "left_semi", ["result_id"])
    if not dedupe:
        return known
    rest = [c for c in fresh.columns if c not in ("batch_id", "url_hash")]
    first = known.groupBy("batch_id", "url_hash").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "result_id")).alias("r")
    ).select("batch_id", "url_hash", "r.*").select(*fresh.columns)
    # of what is stored, only the batches at hand: pruned at the scan where the table is laid out by batch
    ours = stored.select("batch_id", "url_hash").join(fresh.select("batch_id").distinct(), "batch_id", "left_semi")
    # one row per (batch, url) on either side, so no key of this join is hot
    return first.join(ours.distinct(), ["batch_id", "url_hash"], "left_anti")


def append_results(stored_path: str, batches: DataFrame, fresh: DataFrame, dedupe: bool = True) -> None:
    spark = fresh.sparkSession
    stored = spark.read.schema(fresh.schema).parquet(stored_path)
    new_result_rows(stored, batches, fresh, dedupe).write.mode("append").parquet(stored_path)
