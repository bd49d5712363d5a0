"""The result cache: one row per URL hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchloom import files, schemas
from batchloom.functions.answers import decode_analysis
from batchloom.functions.scalars import url_md5
from batchloom.functions.timing import days_before, moment
from batchloom.operators import keyed, sketches
from batchloom.operators.skew import skew_join


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("url_hash", url_md5(F.col("url")))


def missing(rows: DataFrame, cache: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Rows whose URL is not cached; a URL that occurs more than once stays so."""
    return skew_join(with_hash(rows), cache.select("url_hash"), ["url_hash"], "left_anti", spread)


def hits(rows: DataFrame, cache: DataFrame, spread: Sequence[str]) -> DataFrame:
    return skew_join(with_hash(rows), cache.select("url_hash"), ["url_hash"], "left_semi", spread)


def lookup(rows: DataFrame, cache: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Rows with the cached analysis; entries that cannot be read count as absent."""
    readable = decode_analysis(cache.select("url_hash", "analysis_data"), "analysis_data").drop("analysis_data")
    return skew_join(with_hash(rows), readable, ["url_hash"], "inner", spread)


def touch(cache: DataFrame, looked_up: DataFrame, as_of) -> DataFrame:
    """Count the look-ups on the entries that were found."""
    n = looked_up.groupBy("url_hash").agg(F.count(F.lit(1)).alias("__n"))
    hit = F.col("__n").isNotNull()
    return cache.join(n, "url_hash", "left").withColumns({
        "access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)),
        "accessed_at": F.when(hit, moment(as_of)).otherwise(F.col("accessed_at")),
    }).select(*cache.columns)


def _latest(fresh: DataFrame, as_of) -> DataFrame:
    """One entry per hash of ``fresh`` (url, analysis_data and an order column ``at``): the latest."""
    return with_hash(fresh).groupBy("url_hash").agg(
        F.max_by(F.struct("url", "analysis_data"), F.struct("at", "analysis_data")).alias("r")
    ).select(
        "url_hash", "r.url", "r.analysis_data", moment(as_of).alias("created_at"), moment(as_of).alias("accessed_at"),
        F.lit(1).cast("long").alias("access_count"),
    )


def _replaced(cache: DataFrame, latest: DataFrame) -> DataFrame:
    kept = cache.join(latest.select("url_hash"), "url_hash", "left_anti")
    return kept.select(*latest.columns).unionByName(latest)


def merge(cache: DataFrame, fresh: DataFrame, as_of) -> DataFrame:
    """Insert or replace by hash; a replaced entry starts with one access.

    ``fresh`` has url, analysis_data and an order column ``at``; the latest row
    of a hash wins. It is reduced before the join, so no hash is hot there.
    """
    return _replaced(cache, _latest(fresh, as_of))


# --- on disk: a keyed table with folders by the first digits of the hash ---------

_PLACE = ("folder", keyed.BUCKET)


def _put(rows: DataFrame, path: str, folder: str) -> None:
    """Write ``rows``, and beside them a bit sketch of their hashes by bucket."""
    keyed.put(rows, path, folder)
    hashes = rows.sparkSession.read.schema(f"url_hash string, {keyed.BUCKET} string").parquet(f"{path}/rows/folder={folder}")
    sketches.build(hashes, "url_hash", [keyed.BUCKET]).write.parquet(f"{path}/sketch/folder={folder}")


def write_cache(cache: DataFrame, path: str, digits: int = 2) -> None:
    """Lay out a new cache in 16 to the power of ``digits`` folders."""
    if not 1 <= digits <= 3:
        raise ValueError("digits must be 1, 2 or 3")
    keyed.create(cache, path, keyed.Layout(keys=("url_hash",), bucket=f"substring(url_hash, 1, {digits})"), put=_put)


def read_cache(spark: SparkSession, path: str, buckets: Sequence[str] | None = None) -> DataFrame:
    """The cache at ``path``; with ``buckets``, first digits of hashes, only those folders are read."""
    return keyed.read(spark, path, buckets)


def possible(rows: DataFrame, path: str) -> DataFrame:
    """The hashes of ``rows`` (url_hash) that the cache at ``path`` may hold, each once; what is left out it surely lacks.

    Only the sketches are read, some two bytes an entry. Hashes whose folder has no sketch
    (a cache written without) are all possible; null is no hash of an entry.
    """
    spark = rows.sparkSession
    m = keyed.manifest(spark, path)
    lines = [(b, f) for b, v in m.buckets.items() for f in [v["whole"], *[c[0] for c in v["changes"]]] if f]
    drawn = {n.removeprefix("folder=") for n in files.names(spark, f"{path}/sketch")}
    asked = rows.select("url_hash").filter("url_hash is not null").distinct().withColumn(keyed.BUCKET, F.expr(m.layout.bucket))
    places = spark.createDataFrame([(b, f, f in drawn) for b, f in lines], f"{keyed.BUCKET} string, folder string, drawn boolean")
    placed = asked.join(places, keyed.BUCKET)
    unknown = placed.filter("not drawn").select("url_hash")
    folders = sorted({f for _, f in lines if f in drawn})
    if not folders:
        return unknown.distinct()
    sketch = spark.read.schema(f"pages long, page long, bits binary, folder string, {keyed.BUCKET} string").option(
        "basePath", f"{path}/sketch").parquet(*[f"{path}/sketch/folder={f}" for f in folders])
    return sketches.may_hold(placed.filter("drawn"), "url_hash", sketch, _PLACE).select("url_hash").unionByName(unknown).distinct()


def buckets_for(rows: DataFrame, path: str) -> list[str]:
    """The buckets of the cache at ``path`` that may hold a hash of ``rows``; as many as there are buckets at most."""
    return keyed.buckets_of(possible(rows, path), keyed.manifest(rows.sparkSession, path).layout)


def missing_at(rows: DataFrame, path: str, spread: Sequence[str]) -> DataFrame:
    """``missing`` against the cache at ``path``: only buckets that may hold one of the hashes are read, and of them the hashes."""
    asked = with_hash(rows)
    held = read_cache(rows.sparkSession, path, buckets_for(asked, path)).select("url_hash")
    return skew_join(asked, held, ["url_hash"], "left_anti", spread)


def upsert_cache(path: str, fresh: DataFrame, as_of, digits: int = 2, compact_after: int = keyed.MOST_CHANGES) -> int:
    """Merge ``fresh`` into the cache at ``path`` and give the number of the version that has it.

    Only the new entries are written. A folder whose changes outweigh it, or are more
    than ``compact_after``, is folded alone; the others stay as they are. A write
    counts once its manifest is there, so one that breaks off leaves the cache as it
    was. One writer at a time. ``digits`` is that of the cache.
    """
    return keyed.upsert(path, _latest(fresh, as_of), most_changes=compact_after, put=_put)


def tidy_cache(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders that only older versions of the cache refer to, and those of writes that broke off."""
    gone = keyed.forget(spark, path, keyed.versions(spark, path)[-1])
    left = set(files.names(spark, f"{path}/rows"))
    for name in files.names(spark, f"{path}/sketch"):
        if name not in left:
            files.remove(spark, f"{path}/sketch/{name}")
    return gone


def expire(cache: DataFrame, as_of, days: int = schemas.CACHE_RETENTION_DAYS) -> DataFrame:
    return cache.filter(~(F.col("created_at") < days_before(moment(as_of), days)))


def stats(cache: DataFrame, as_of) -> DataFrame:
    recent = F.col("accessed_at") >= days_before(moment(as_of), 1)
    return cache.agg(F.count(F.lit(1)).alias("total_entries"), F.count_if(recent).alias("recent_access_24h"))


def top_accessed(cache: DataFrame, n: int = 5) -> DataFrame:
    return cache.orderBy(F.desc("access_count"), "url").limit(n).select("url", "access_count")
