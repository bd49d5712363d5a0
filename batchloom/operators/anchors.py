"""Listings that are sorted once and then paged by place.

A listing is written in slices of consecutive ranks, with an anchor for each slice:
its first rank, sort value and key. A page reads the one or two slices its ranks fall
into, however deep it is, and a seek finds its slice among the anchors; nothing is
sorted again. A listing is as old as its writing; write a new one when rows change.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from batchloom import files
from batchloom.operators import filters
from batchloom.operators.ordering import number_rows
from batchloom.operators.paging import Listing, listing_columns, page_results, sort_field, sort_order

RANK, SLICE = "__rank", "__slice"
SLICE_ROWS = 1_000_000


def write_listing(rows: DataFrame, path: str, sort: str, key: str, slice_rows: int = SLICE_ROWS, about: str = "") -> int:
    """Sort ``rows`` by ``sort`` and the unique ``key`` into a new listing at ``path``, and give their number.

    ``about`` says which rows these are. The listing counts once its description is
    there, which is written last.
    """
    spark = rows.sparkSession
    ranked = number_rows(rows, [], sort_order(sort, key), RANK)
    cut = ranked.withColumn(SLICE, F.expr(f"({RANK} - 1) div {slice_rows}"))
    cut.repartition(SLICE).sortWithinPartitions(SLICE, RANK).write.partitionBy(SLICE).parquet(f"{path}/rows")
    laid = T.StructType([*[f for f in ranked.schema.fields if f.name != RANK], T.StructField(RANK, T.LongType()), T.StructField(SLICE, T.LongType())])
    written = spark.read.schema(laid).parquet(f"{path}/rows")
    first = F.min(F.struct(F.col(RANK).alias("rank"), F.col(sort_field(sort)).alias("value"), F.col(key).alias("key"))).alias("a")
    written.groupBy(F.col(SLICE).alias("slice")).agg(first, F.count(F.lit(1)).alias("n")).select("slice", "a.*", "n").write.parquet(f"{path}/anchors")
    total = spark.read.parquet(f"{path}/anchors").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    files.put_text(spark, f"{path}/listing.json", json.dumps(
        {"sort": sort, "key": key, "slice_rows": slice_rows, "about": about, "total": total, "schema": schema.jsonValue()}))
    return total


def describe(spark: SparkSession, path: str) -> dict:
    """sort, key, slice_rows, about, total and schema of the listing at ``path``."""
    return json.loads(files.read_text(spark, f"{path}/listing.json"))


def _slices(spark: SparkSession, path: str, known: dict, first: int, last: int) -> DataFrame:
    """The rows of the slices that hold ranks ``first`` to ``last``, with their rank; other slices are not looked at."""
    schema = T.StructType([*T.StructType.fromJson(known["schema"]).fields, T.StructField(RANK, T.LongType())])
    first, last = max(first, 1), min(last, known["total"])
    if first > last:
        return spark.createDataFrame([], schema)
    rows = known["slice_rows"]
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{SLICE}={k}" for k in range((first - 1) // rows, (last - 1) // rows + 1)])


def read_ranks(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of the listing, counted from 1, in its order."""
    known = describe(spark, path)
    found = _slices(spark, path, known, first, last)
    return found.filter(F.col(RANK).between(first, last)).orderBy(RANK).drop(RANK)


def read_page(spark: SparkSession, path: str, page: int, per_page: int) -> DataFrame:
    """A page of the listing; one beyond the last is empty."""
    begin = (max(1, page) - 1) * per_page
    return read_ranks(spark, path, begin + 1, begin + per_page)


def read_after(spark: SparkSession, path: str, value, key, size: int) -> DataFrame:
    """The ``size`` rows behind the place where (value, key) stands or would stand."""
    known = describe(spark, path)
    anchors = spark.read.parquet(f"{path}/anchors")
    same = F.lit(value).cast(anchors.schema["value"].dataType)
    near = anchors.filter(~_behind(known["sort"], F.col("value"), F.col("key"), same, key)).agg(F.max("slice")).first()[0] or 0
    begin = near * known["slice_rows"]
    column = F.col(sort_field(known["sort"]))
    upto = begin + known["slice_rows"]
    before = _slices(spark, path, known, begin + 1, upto).filter(~_behind(known["sort"], column, F.col(known["key"]), same, key)).agg(F.max(RANK)).first()[0]
    place = begin if before is None else before
    return read_ranks(spark, path, place + 1, place + size)


def _behind(sort: str, column: Column, key: Column, value: Column, last) -> Column:
    """Whether (column, key) stands behind (value, last) in the order of ``sort``: nulls last rising, first falling."""
    later = column.eqNullSafe(value) & (key > F.lit(last))
    if sort.split(":")[1:2] == ["asc"]:
        past = F.when(column.isNull(), value.isNotNull()).otherwise(value.isNotNull() & (column > value))
    else:
        past = F.when(column.isNull(), F.lit(False)).otherwise(value.isNull() | (column < value))
    return F.coalesce(past | later, F.lit(False))


def covers(spark: SparkSession, path: str, ask: Listing) -> bool:
    """Whether the listing at ``path`` has the rows and the order that ``ask`` wants."""
    known = describe(spark, path)
    return known["about"] == about(ask) and _order(known["sort"]) == _order(ask.sort)


def _order(sort: str) -> tuple[str, bool]:
    return sort_field(sort), sort.split(":")[1:2] == ["asc"]


def about(ask: Listing) -> str:
    """The filters of a listing, as text; two with the same text have the same rows."""
    return json.dumps({k: str(v) for k, v in sorted(vars(ask).items()) if k not in ("page", "per_page", "sort") and v is not None})


def write_results_listing(results: DataFrame, path: str, ask: Listing, slice_rows: int = SLICE_ROWS) -> int:
    """The results that ``ask`` wants, in its order, as a listing of any number of pages."""
    return write_listing(filters.where(results, ask.predicate()), path, ask.sort, "result_id", slice_rows, about(ask))


def page_of_results(results: DataFrame, path: str, ask: Listing) -> DataFrame:
    """The page from the listing at ``path`` where that has it, else sorted out of ``results``; ``covers`` tells which."""
    spark = results.sparkSession
    if not covers(spark, path, ask):
        return page_results(results, ask)
    return read_page(spark, path, max(1, ask.page), ask.size).select(*listing_columns())
