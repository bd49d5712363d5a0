"""Listings: filtered, sorted and cut into pages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from batchloom import schemas
from batchloom.functions.scalars import has_contact, share_pct, truncate_text
from batchloom.functions.timing import iso_text, moment
from batchloom.operators import filters
from batchloom.operators.ordering import number_rows, top_per_key

SORTABLE = ["store_image", "store_name", "processing_time_seconds", "created_at"]
# beyond this offset a page is found by distributed numbering, not by a top-k heap
DEEP_OFFSET = 5_000


@dataclass(frozen=True)
class Listing:
    """Parameters of the result listing, as texts from a request."""

    page: int = 1
    per_page: int = 25
    sort: str = "created_at:desc"
    store_image: str = "all"
    batch_id: str = ""
    contact: str = ""
    success: str = "all"

    @property
    def size(self) -> int:
        return max(1, self.per_page)

    @property
    def offset(self) -> int:
        return (max(1, self.page) - 1) * self.size

    def predicate(self) -> Column | None:
        return filters.compose(
            [
                filters.store_image_is(self.store_image),
                filters.batch_id_matches(self.batch_id),
                filters.contact_present(self.contact),
                filters.success_is(self.success),
            ]
        )


def sort_field(sort: str) -> str:
    field = sort.partition(":")[0]
    return field if field in SORTABLE else "created_at"


def sort_order(sort: str, tie: str = "result_id") -> list[Column]:
    """``field:dir`` with four known fields; nulls last ascending, first descending."""
    column = F.col(sort_field(sort))
    if sort.split(":")[1:2] == ["asc"]:
        return [column.asc_nulls_last(), F.col(tie).asc()]
    return [column.desc_nulls_first(), F.col(tie).asc()]


def listing_columns() -> list[Column]:
    return [
        F.col("success"), F.col("store_image"), F.col("text_content"), F.col("store_name"),
        F.col("business_contact"), has_contact(F.col("business_contact")).alias("phone_number"),
        F.col("image_description"), F.col("url"), F.col("processing_time_seconds"),
        iso_text(F.col("created_at")).alias("created_at"), F.col("batch_id"),
    ]


def cut_page(df: DataFrame, sort: str, key: str, offset: int, size: int, deep_from: int = DEEP_OFFSET) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of ``df``, ordered by ``sort`` and the unique ``key``.

    A deep page is not searched with a heap of ``offset`` rows per task: sort
    field and key alone are numbered over all tasks, and the rows of the page
    are fetched by key.
    """
    order = sort_order(sort, key)
    if offset <= deep_from:
        return df.orderBy(*order).offset(offset).limit(size)
    narrow = df.select(*dict.fromkeys([sort_field(sort), key]))
    page = number_rows(narrow, [], order, "__n").filter(F.col("__n").between(offset + 1, offset + size))
    # as many keys as a page has rows
    keys = F.broadcast(page.select(key)) if size <= schemas.MAX_PAGE_ROWS else page.select(key)
    return df.join(keys, key, "left_semi").orderBy(*order)


def page_results(results: DataFrame, ask: Listing, deep_from: int = DEEP_OFFSET) -> DataFrame:
    rows = filters.where(results, ask.predicate())
    return cut_page(rows, ask.sort, "result_id", ask.offset, ask.size, deep_from).select(*listing_columns())


def page_total(results: DataFrame, ask: Listing) -> DataFrame:
    """Page meta data; reads only the columns the filters need."""
    rows = filters.where(results, ask.predicate())
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(max(1, ask.page)).alias("page"), F.lit(ask.size).alias("per_page"), "total"
    )


def next_page(results: DataFrame, ask: Listing, last_created_at: datetime | str | None, last_result_id) -> DataFrame:
    """The page after a known last row, newest first, at the price of a first page."""
    at, later = F.col("created_at"), F.col("result_id") > last_result_id
    if last_created_at is None:
        # rows without time come first
        after = at.isNotNull() | later
    else:
        last = moment(last_created_at)
        after = (at < last) | ((at == last) & later)
    rows = filters.where(results, ask.predicate(), after)
    return rows.orderBy(*sort_order("created_at:desc")).limit(ask.size).select(*listing_columns())


def list_batches(
    batches: DataFrame, limit: int = 50, status: str | None = None, include_soft_deleted: bool = False
) -> DataFrame:
    rows = filters.where(
        batches, None if include_soft_deleted else filters.not_soft_deleted(), filters.status_is(status)
    )
    return rows.orderBy(*sort_order("created_at:desc", "batch_id")).limit(limit)


def page_batches(
    batches: DataFrame, chunks: DataFrame, page: int = 1, per_page: int = 20, status: str | None = None,
    include_soft_deleted: bool = False,
) -> DataFrame:
    """A page of batches with progress by chunks; only the page's chunks are counted."""
    size = max(1, per_page)
    rows = filters.where(
        batches, None if include_soft_deleted else filters.not_soft_deleted(), filters.status_is(status, strict=False)
    )
    shown = cut_page(rows, "created_at:desc", "batch_id", (max(1, page) - 1) * size, size)
    # a full page counts as a sign of another one
    more = shown.agg(F.count(F.lit(1)) == size).scalar()
    ids = shown.select("batch_id")
    ids = F.broadcast(ids) if size <= schemas.MAX_PAGE_ROWS else ids
    done = (
        chunks.join(ids, "batch_id", "left_semi").groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("status") == "completed").alias("completed_chunks"))
    )
    total, completed = F.coalesce("chunks", F.lit(0)), F.coalesce("completed_chunks", F.lit(0))
    return shown.drop("total_chunks").join(done, "batch_id", "left").select(
        "batch_id", "batch_name", F.upper("status").alias("status"), "total_urls",
        total.alias("total_chunks"), completed.alias("completed_chunks"),
        "processed_count", "successful_count", "failed_count",
        F.round(share_pct(completed, total), 1).alias("progress_percentage"),
        iso_text(F.col("created_at")).alias("created_at"), iso_text(F.col("started_at")).alias("started_at"),
        "error_message", more.alias("has_next"),
    )


def batch_results(results: DataFrame, batch_id, status: str | None = None) -> DataFrame:
    """Results of one batch, newest first, with long texts cut."""
    rows = filters.where(results, F.col("batch_id") == batch_id, filters.success_is(status))
    return rows.orderBy(*sort_order("created_at:desc")).select(*result_columns())


def result_columns() -> list[Column]:
    return [
        F.col("result_id"), F.col("url"), F.col("success"), F.col("store_name"), F.col("business_contact"),
        F.col("image_description"), truncate_text(F.col("text_content"), 500).alias("text_content"),
        F.col("error_message"), F.col("processing_time_seconds"),
    ]


def preview(results: DataFrame, batch_id=None, only_failed: bool = False, rows: int = 100) -> DataFrame:
    """The first rows of an export."""
    chosen = filters.where(
        results, None if batch_id is None else F.col("batch_id") == batch_id, filters.failed_only(only_failed)
    )
    return chosen.orderBy(F.col("created_at").asc_nulls_last(), "result_id").limit(rows).select(
        "url", "success", "store_image", "text_content", "store_name", "business_contact",
        "image_description", "error_message", iso_text(F.col("created_at")).alias("created_at"),
    )


def list_chunks(chunks: DataFrame, batch_id=None) -> DataFrame:
    rows = filters.where(chunks, None if batch_id is None else F.col("batch_id") == batch_id)
    return rows.orderBy("batch_id", "chunk_number").select(
        "batch_id", "chunk_id", "chunk_number", "status", "url_count", "processed_count", "successful_count",
        "failed_count", share_pct(F.col("processed_count"), F.col("url_count")).alias("progress_percentage"),
        iso_text(F.col("started_at")).alias("started_at"), iso_text(F.col("completed_at")).alias("completed_at"),
        "error_message",
    )


def recent_errors(results: DataFrame, k: int = 5) -> DataFrame:
    """The newest failures that carry a message, per batch."""
    failed = results.filter(~F.col("success") & F.col("error_message").isNotNull())
    top = top_per_key(failed, ["batch_id"], sort_order("created_at:desc"), k)
    return top.select("batch_id", "rank", "result_id", "url", "error_message", "created_at")


def recent_results(results: DataFrame, k: int = 10) -> DataFrame:
    top = top_per_key(results, ["batch_id"], sort_order("created_at:desc"), k)
    return top.select("batch_id", "rank", "result_id", "url", "success", "store_name", "error_message", "created_at")
