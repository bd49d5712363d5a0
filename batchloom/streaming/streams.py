"""The same measures over streams of URL rows, results and job events.

Inputs are streaming frames with an event time ``ts`` of type TIMESTAMP (cast
TIMESTAMP_NTZ first: watermarks refuse it).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from batchloom import files
from batchloom.functions.scalars import error_class, url_sha256
from batchloom.operators.cache import buckets_for, read_cache, upsert_cache, with_hash
from batchloom.operators.enrich import enrich_with_cache
from batchloom.session import staging_dir
from batchloom.sources.url_csv import with_clean_url

VERSION = "version"
WHOLE = "whole"
NOW = {"availableNow": True}


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """Files under ``path`` as a stream; a glob is allowed."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(path)


# --- operators ------------------------------------------------------------------

def ingest(urls: DataFrame, columns: Sequence[str], delay: str = "1 hour", spread: str | None = None, slices: int = 32) -> DataFrame:
    """Valid URLs, each once per batch within the watermark.

    With ``spread``, a column that differs between the copies of a URL, copies
    are first dropped within ``slices`` parts, so that a URL with most of the
    rows does not meet in one task.
    """
    valid = with_clean_url(urls, columns).withColumn("url_hash", url_sha256(F.col("url"))).withWatermark("ts", delay)
    if spread:
        part = F.pmod(F.xxhash64(spread), F.lit(slices))
        valid = valid.withColumn("__part", part).dropDuplicatesWithinWatermark(["batch_id", "url_hash", "__part"]).drop("__part")
    return valid.dropDuplicatesWithinWatermark(["batch_id", "url_hash"])


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("processed"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    ]


def progress(results: DataFrame) -> DataFrame:
    """Running counters per batch, for output mode update."""
    return results.groupBy("batch_id").agg(*_counts())


def error_progress(results: DataFrame) -> DataFrame:
    """Running error classes per batch, for output mode update."""
    told = results.filter(~F.col("success") & (F.coalesce("error_message", F.lit("")) != ""))
    return told.groupBy("batch_id", error_class(F.col("error_message")).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n")
    )


def rate(results: DataFrame, window: str = "1 minute", delay: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Items per tumbling window."""
    return _windowed(results, delay, F.window("ts", window), keys)


def last_hour(
    results: DataFrame, window: str = "1 hour", step: str = "5 minutes", delay: str = "10 minutes", keys: Sequence[str] = ()
) -> DataFrame:
    """Items and error rate in a sliding window."""
    out = _windowed(results, delay, F.window("ts", window, step), keys)
    return out.withColumn("error_rate", F.col("failed") / F.col("processed"))


def _windowed(results: DataFrame, delay: str, window: Column, keys: Sequence[str]) -> DataFrame:
    grouped = results.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(*_counts())
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "processed", "successful", "failed"
    )


def sessions(results: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Stretches of work per batch; a pause of ``gap`` ends one."""
    grouped = results.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "batch_id").agg(*_counts())
    return grouped.select(
        "batch_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
        "processed", "successful", "failed",
    )


JOB_STATE = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("retry_count", T.IntegerType()), T.StructField("due_at", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()), T.StructField("timed_out", T.BooleanType()),
])


def job_state(events: DataFrame, delay: str = "10 minutes", timeout_seconds: int = 86_400, max_retries: int = 3) -> DataFrame:
    """Current state per job from its events (job_id, event, ts), kept across micro-batches.

    ``fail`` raises the retry count: retrying with a due time, or failed once the
    retries are used up. ``complete`` ends a job; anything else means it runs. A
    job not heard of for ``timeout_seconds`` of event time is reported as timed
    out. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Jobs(StatefulProcessor):
        # the state is a count and a latest event, so rows may come in any order and are never gathered
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("job", "fails int, event string, last_us long, last_id long")

        def _row(self, key, state, timed_out):
            import pandas as pd

            fails, event, last, _ = state
            due = None
            if event == "fail":
                status = "retrying" if fails <= max_retries else "failed"
                if status == "retrying":
                    due = last + min(300, 60 * 2 ** min(fails, 10)) * 1_000_000
            else:
                status = "completed" if event == "complete" else "processing"
            return status, pd.DataFrame({
                "job_id": [key[0]], "status": [status], "retry_count": [fails],
                "due_at": [pd.NaT if due is None else pd.Timestamp(due, unit="us")],
                "last_seen": [pd.Timestamp(last, unit="us")], "timed_out": [timed_out],
            })

        def handleInputRows(self, key, rows, timerValues):
            fails, event, last, last_id = self.state.get() if self.state.exists() else (0, None, -1, -1)
            for frame in rows:
                fails += int((frame["event"] == "fail").sum())
                top = frame.sort_values(["at_us", "event_id"]).iloc[-1]
                if (int(top["at_us"]), int(top["event_id"])) > (last, last_id):
                    event, last, last_id = str(top["event"]), int(top["at_us"]), int(top["event_id"])
            state = (fails, event, last, last_id)
            self.state.update(state)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + timeout_seconds * 1000)
            yield self._row(key, state, False)[1]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                status, row = self._row(key, self.state.get(), True)
                self.state.clear()
                if status not in ("completed", "failed"):
                    yield row

        def close(self):
            pass

    source = events.withWatermark("ts", delay).select(
        F.col("job_id").cast("string").alias("job_id"), "event", "event_id", F.unix_micros("ts").alias("at_us"), "ts"
    )
    return source.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Jobs(), outputStructType=JOB_STATE, outputMode="Update", timeMode="EventTime"
    )


# --- running --------------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def start_append(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write finished rows to parquet under ``folder``; a restart goes on where the last run ended.

    ``trigger`` is one of Spark's, by default what is there now.
    """
    return (
        stream.writeStream.outputMode("append").format("parquet").trigger(**(trigger or NOW))
        .option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows")
    )


def start_update(
    stream: DataFrame, folder: str, keys: Sequence[str] | None = None, fold_every: int = 100, **trigger
) -> StreamingQuery:
    """Write the rows each micro-batch changed, in output mode update.

    The folder of a micro-batch is named by its id and written over when it is
    repeated, so a restart changes nothing. With ``keys``, every ``fold_every``-th
    micro-batch writes the latest row of each key so far, and readers start there.
    A fold removes what is older than the fold before it, so there are never more than
    twice ``fold_every`` folders to list, and a reader has that long to end.
    """

    def put(rows: DataFrame, number: int) -> None:
        fold = keys is not None and number > 0 and number % fold_every == 0
        if fold:
            before = _since_fold(stream, folder, number)
            rows = _latest(before.unionByName(rows.withColumn(VERSION, F.lit(number).cast("long"))), keys, stream.columns)
        rows.withColumn(WHOLE, F.lit(int(fold))).write.mode("overwrite").partitionBy(WHOLE).parquet(f"{folder}/rows/{VERSION}={number}")
        if fold:
            spark = stream.sparkSession
            for name in files.names(spark, f"{folder}/rows"):
                old = name.removeprefix(f"{VERSION}=")
                if old.isdigit() and int(old) < number - fold_every:
                    files.remove(spark, f"{folder}/rows/{name}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(put).trigger(**(trigger or NOW))
        .option("checkpointLocation", f"{folder}/state").start()
    )


def _since_fold(stream: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """The last fold and the rows after it, of micro-batches before ``before`` if given."""
    schema = T.StructType([*stream.schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(WHOLE, T.IntegerType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
    if before is not None:
        rows = rows.filter(F.col(VERSION) < before)
    fold = rows.filter(F.col(WHOLE) == 1).agg(F.max(VERSION)).first()[0]
    return (rows if fold is None else rows.filter(F.col(VERSION) >= fold)).drop(WHOLE)


def _latest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    values = [c for c in columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), VERSION).alias("v"))
    return latest.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def read_append(stream: DataFrame, folder: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def read_latest(stream: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """The latest row of each key that ``start_update`` has written."""
    return _latest(_since_fold(stream, folder), keys, stream.columns)


def drain_append(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run what is there and read the rows; a second run on the folder adds only the new."""
    folder = folder or _folder(stream.sparkSession, "append")
    start_append(stream, folder).awaitTermination()
    return read_append(stream, folder)


def drain_update(stream: DataFrame, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """Run what is there in output mode update and read the latest row of each key."""
    folder = folder or _folder(stream.sparkSession, "update")
    start_update(stream, folder, keys).awaitTermination()
    return read_latest(stream, keys, folder)


def drain_late(stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """Run an aggregate in append mode; also count the rows its watermark dropped.

    Spark counts them where they reach the state, that is after the partial
    aggregation of each task.
    """
    folder = folder or _folder(stream.sparkSession, "late")
    query = start_append(stream, folder)
    seen: dict[int, int] = {}
    while not query.awaitTermination(1):
        late_rows(query, seen)
    return read_append(stream, folder), late_rows(query, seen)


def late_rows(query: StreamingQuery, seen: dict[int, int] | None = None) -> int:
    """Rows the watermark dropped so far.

    A query reports its latest micro-batches only; ``seen`` keeps what earlier
    calls found by micro-batch, so asked now and then the count is complete.
    """
    seen = {} if seen is None else seen
    for p in query.recentProgress:
        seen[p.batchId] = max(seen.get(p.batchId, 0), sum(int(op.numRowsDroppedByWatermark) for op in p.stateOperators))
    return sum(seen.values())


def late_count(taken: DataFrame, done: DataFrame, folder: str) -> DataFrame:
    """One row, ``late_rows``: of the rows ``taken`` (ts) by ``rate`` into ``folder``, those its watermark dropped.

    A row is in a finished window of ``done``, in an open one, which the state
    holds, or it was late. So the count of rows is exact however long the query
    ran and however often it was restarted. Rows without ``ts`` are in no window.
    """
    state = taken.sparkSession.read.format("statestore").load(f"{folder}/state")
    counts = F.col("value").cast("struct<processed:bigint,successful:bigint,failed:bigint>")
    placed = done.select("processed").unionByName(state.select(counts["processed"].alias("processed")))
    windows = placed.agg(F.coalesce(F.sum("processed"), F.lit(0)).alias("n"))
    return taken.agg(F.count("ts").alias("n")).select((F.col("n") - windows.scalar()).alias("late_rows"))


def enrich_stream(
    urls: DataFrame, cache_path: str, work: Callable[[list[str]], list], as_of, folder: str | None = None,
    digits: int = 2, merge_every: int = 20,
) -> DataFrame:
    """Enrich micro-batches of (batch_id, chunk_number, item_id, url) against the cache at ``cache_path``.

    Of the cache, only the folders are read whose sketch may hold a hash of the
    micro-batch. New answers go to a log, a folder per micro-batch, and are merged into
    the cache every ``merge_every`` micro-batches and at the end, so the log that
    is read stays short. The log and the results of a repeated micro-batch are
    written over; only answers of micro-batches before it are merged while it
    runs. A run that broke off is caught up with at the next start; merging the
    same answers twice changes nothing.
    """
    spark = urls.sparkSession
    folder = folder or _folder(spark, "enrich")
    log = f"{folder}/answers"
    fields = "url string, analysis_data string, at timestamp_ntz, version long"
    spark.createDataFrame([], fields).drop(VERSION).write.mode("overwrite").parquet(f"{log}/{VERSION}=-1")

    def answers(after: int) -> DataFrame:
        return spark.read.schema(fields).parquet(log).filter(F.col(VERSION) > after)

    def catch_up(upto: int | None = None) -> int:
        """Merge what the log has, before micro-batch ``upto`` if given; the last one merged."""
        try:
            done = spark.read.parquet(f"{folder}/merged").agg(F.max("upto")).first()[0]
        except AnalysisException:  # first run
            done = -1
        new = answers(done) if upto is None else answers(done).filter(F.col(VERSION) < upto)
        last = new.agg(F.max(VERSION)).first()[0]
        if last is None:
            return done
        upsert_cache(cache_path, new.drop(VERSION), as_of, digits)
        # a line more, so that no moment is without one
        spark.range(1).select(F.lit(last).alias("upto")).write.mode("append").parquet(f"{folder}/merged")
        return last

    merged = catch_up()

    def handle(rows: DataFrame, number: int) -> None:
        nonlocal merged
        if number - merged > merge_every:
            merged = catch_up(number)
        hashed = with_hash(rows)
        # sketches tell which buckets need not be read: new URLs are in none
        base = read_cache(spark, cache_path, buckets_for(hashed, cache_path))
        # no answer is both in the cache and in this part of the log
        recent = with_hash(answers(merged).filter(F.col(VERSION) < number))
        cache = base.select("url_hash", "analysis_data").unionByName(recent.select("url_hash", "analysis_data"))
        out = enrich_with_cache(rows, cache, work, as_of)
        out.cache_rows.write.mode("overwrite").parquet(f"{log}/{VERSION}={number}")
        out.results.write.mode("overwrite").parquet(f"{folder}/rows/{VERSION}={number}")

    query = (
        urls.writeStream.foreachBatch(handle).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start()
    )
    query.awaitTermination()
    catch_up()
    return spark.read.parquet(f"{folder}/rows").drop(VERSION)
