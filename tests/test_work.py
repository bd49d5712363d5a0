"""User functions and streams."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from batchloom.operators import cache, enrich, metrics, rates, relations, runs
from batchloom.operators.skew import skew_join
from batchloom.plans.processing import stub_scorer
from batchloom.sources.url_csv import join_lines, scan_url_csv
from batchloom.streaming import streams

NOW = "2024-01-31 00:00:00"


def rows(spark, n=40):
    return spark.range(n).select(
        F.lit(1).alias("batch_id"), F.lit(1).alias("chunk_number"), F.col("id").alias("item_id"),
        F.format_string("https://x/%d", F.col("id") % 10).alias("url"),
    )


def test_failures_are_rows(spark):
    def work(items):
        raise RuntimeError("down")

    got = enrich.enrich(rows(spark), work).collect()
    assert len(got) == 40 and all(not r.success and r.error == "down" for r in got)
    short = enrich.enrich(rows(spark), lambda items: []).filter(F.col("success")).count()
    assert short == 0


def test_work_sees_each_missing_url_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def work(items):
        import os
        import uuid

        for u in items:
            open(os.path.join(folder, u.rsplit("/", 1)[1] + "-" + uuid.uuid4().hex), "w").close()
        return [{"store_name": u} for u in items]

    known = spark.createDataFrame([("https://x/3", '{"store_name": "old"}'), ("https://x/4", "{broken")], "url string, analysis_data string")
    known = cache.with_hash(known)
    out = enrich.enrich_with_cache(rows(spark), known, work, NOW)
    got = out.results.collect()
    assert len(got) == 40 and sum(r.cache_hit for r in got) == 4
    assert {r.store_name for r in got if r.cache_hit} == {"old"}
    calls = sorted(p.name.split("-")[0] for p in log.iterdir())
    assert calls == sorted(str(i) for i in range(10) if i != 3)
    assert out.cache_rows.count() == 9
    strict = enrich.enrich_with_cache(rows(spark), known, work, NOW, retry_unreadable=False)
    assert strict.results.count() == 36


def test_slots_cap_the_tasks(spark):
    got = enrich.enrich(rows(spark), stub_scorer(), slots=2)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() <= 2 and got.count() == 40


def test_retry_rounds_stop(spark):
    got = enrich.retry_rounds(rows(spark), lambda attempt: enrich.per_item(lambda u: 1 / 0), max_retries=1).collect()
    assert len(got) == 40 and all(r.attempts == 2 and not r.success for r in got)
    got = enrich.retry_rounds(rows(spark), lambda attempt: enrich.per_item(lambda u: {"a": 1})).collect()
    assert len(got) == 40 and all(r.attempts == 1 and r.success for r in got)


def test_unknown_handler(spark):
    jobs = spark.createDataFrame([(1, "known", "p"), (2, "other", "p"), (3, None, "p")], "job_id int, job_type string, payload string")
    got = {r.job_id: r for r in enrich.run_handlers(jobs, {"known": enrich.per_item(lambda p: {"ok": p})}).collect()}
    assert got[1].success and not got[2].success and "other" in got[2].error and not got[3].success


def stream_of(spark, df, tmp_path, parts):
    folder = str(tmp_path / "in")
    for p in parts:
        df.filter(p).coalesce(1).write.mode("append").parquet(folder)
    return streams.file_stream(spark, folder, df.schema, files=1)


def test_restart_adds_nothing(spark, tmp_path):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("batch_id"), (F.col("id") % 4 != 0).alias("success"), F.timestamp_seconds("id").alias("ts"))
    source = stream_of(spark, df, tmp_path, ["batch_id = 0", "batch_id = 1", "batch_id = 2"])
    folder = str(tmp_path / "out")
    first = streams.drain_update(streams.progress(source), ["batch_id"], folder).orderBy("batch_id").collect()
    again = streams.drain_update(streams.progress(source), ["batch_id"], folder).orderBy("batch_id").collect()
    want = df.groupBy("batch_id").agg(F.count("*").alias("p"), F.count_if("success").alias("s")).orderBy("batch_id").collect()
    assert first == again
    assert [(r.batch_id, r.processed, r.successful) for r in first] == [(r.batch_id, r.p, r.s) for r in want]


def test_stream_enrichment_survives_a_break(spark, tmp_path):
    """A failing micro-batch, then a second run: whole results, and each answer in the cache once."""
    path, folder = str(tmp_path / "cache"), str(tmp_path / "out")
    known = spark.createDataFrame([("https://x/3", '{"store_name": "old"}')], "url string, analysis_data string")
    known = cache.with_hash(known).withColumns({
        "created_at": F.lit(NOW).cast("timestamp_ntz"), "accessed_at": F.lit(NOW).cast("timestamp_ntz"),
        "access_count": F.lit(1).cast("long")})
    cache.write_cache(known, path, digits=1)
    source = stream_of(spark, rows(spark), tmp_path, ["item_id < 15", "item_id >= 15 and item_id < 30", "item_id >= 30"])
    real, calls = streams.enrich_with_cache, []

    def breaks(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return real(*args, **kwargs)

    streams.enrich_with_cache = breaks
    try:
        with pytest.raises(Exception):
            streams.enrich_stream(source, path, stub_scorer(), NOW, folder, digits=1)
    finally:
        streams.enrich_with_cache = real
    got = streams.enrich_stream(source, path, stub_scorer(), NOW, folder, digits=1, merge_every=1).collect()
    assert sorted(r.result_id for r in got) == list(range(40))
    stored = cache.read_cache(spark, path).groupBy("url_hash").count()
    good = {r.url for r in got if r.success}
    assert stored.filter("count > 1").isEmpty() and stored.count() == len(good | {"https://x/3"})


def test_job_times_out(spark, tmp_path):
    rows = [(1, "a", "beat", 0), (2, "b", "complete", 0), (3, "c", "fail", 5), (4, "c", "fail", 9), (5, "z", "beat", 200_000),
            (6, "z", "beat", 200_001)]
    df = spark.createDataFrame(rows, "event_id long, job_id string, event string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    source = stream_of(spark, df, tmp_path, ["event_id <= 4", "event_id = 5", "event_id = 6"])
    folder = str(tmp_path / "out")
    streams.start_update(streams.job_state(source), folder).awaitTermination()
    got = spark.read.parquet(f"{folder}/rows").collect()
    late = {r.job_id: r for r in got if r.timed_out}
    # a is stuck, c waits for a retry that never came; b is over
    assert set(late) == {"a", "c"}
    c = late["c"]
    assert (c.status, c.retry_count) == ("retrying", 2)
    assert (c.due_at - c.last_seen).total_seconds() == 240


def test_late_rows_are_counted(spark, tmp_path):
    df = spark.range(3000).select(
        F.col("id").alias("batch_id"), F.lit(True).alias("success"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    source = stream_of(spark, df, tmp_path, ["batch_id >= 2000", "batch_id >= 1000 and batch_id < 2000", "batch_id < 1000"])
    folder = str(tmp_path / "out")
    rows, dropped = streams.drain_late(streams.rate(source, "1 hour"), folder)
    assert dropped > 0 and rows.agg(F.sum("processed")).head()[0] <= 2000
    # Spark counts after partial aggregation; the rows themselves are counted from windows and state
    assert streams.late_count(df, rows, folder).head()[0] == 1000


def test_ingest_drops_repeats(spark, tmp_path):
    df = spark.range(60).select(
        F.lit(1).alias("batch_id"), F.format_string(" https://x/%d ", F.col("id") % 20).alias("url"),
        F.timestamp_seconds("id").alias("ts"))
    source = stream_of(spark, df, tmp_path, ["true"])
    got = streams.drain_append(streams.ingest(source, ["url"]))
    assert sorted(r.url for r in got.collect()) == sorted(f"https://x/{i}" for i in range(20))


def test_csv_headers_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("url,other\nhttps://x/1,n\n")
    (tmp_path / "b.csv").write_text("other,url\nn,https://x/2\nn,https://x/3\n")
    (tmp_path / "c.csv").write_text("other\nhttps://x/4\n")
    rows = scan_url_csv(spark, str(tmp_path)).collect()
    assert sorted(r.url for r in rows) == ["https://x/1", "https://x/2", "https://x/3"] and len({r.seq for r in rows}) == 3


def test_rolling_means_take_nothing_from_outside(spark):
    start = datetime(2024, 1, 1)
    values = [math.nan, 1e18, 0.1, 0.3]
    rows = [(start + timedelta(hours=2 * i), v) for i, v in enumerate(values[:2])] + [(start + timedelta(hours=9, minutes=i), v) for i, v in enumerate(values[2:])]
    got = [r.avg_v for r in metrics.rolling_means(spark.createDataFrame(rows, "ts timestamp, v double"), ["v"]).orderBy("ts").collect()]
    assert math.isnan(got[0]) and got[1:] == [1e18, 0.1, 0.2]


def test_clone_keeps_batches_with_equal_chunk_ids_apart(spark):
    batches = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], "batch_id long, batch_name string, total_urls long, total_chunks long")
    chunks = spark.createDataFrame([(1, 7, 1, 1), (2, 7, 1, 1)], "batch_id long, chunk_id long, chunk_number int, url_count int")
    results = spark.createDataFrame([(10, 1, 7, "u1"), (20, 2, 7, "u2")], "result_id long, batch_id long, chunk_id long, url string")
    wanted = spark.createDataFrame([(1, 101, "x"), (2, 102, "y")], "batch_id long, new_batch_id long, new_name string")
    copy = relations.clone_batches(relations.Store(batches, chunks, results), wanted, "2024-01-01 00:00:00", copy_results=True)
    assert sorted((r.batch_id, r.url) for r in copy.results.collect()) == [(101, "u1"), (102, "u2")]


def test_run_that_is_repeated_stores_nothing_twice(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    path, stored = str(tmp_path / "cache"), str(tmp_path / "stored")
    cache.write_cache(cache.with_hash(spark.createDataFrame([("https://x/3", "{}")], "url string, analysis_data string")).withColumns({
        "created_at": F.lit(NOW).cast("timestamp_ntz"), "accessed_at": F.lit(NOW).cast("timestamp_ntz"),
        "access_count": F.lit(1).cast("long")}), path, digits=1)
    work = spark.createDataFrame([(1, 1, 1, "https://x/1"), (1, 1, 2, "https://x/1"), (1, 2, 3, "https://x/2"), (2, 1, 4, "https://x/3")],
                                 "batch_id long, chunk_number int, item_id long, url string")
    chunks = spark.createDataFrame(
        [(1, 1, "processing"), (1, 2, "processing"), (2, 1, "pending"), (2, 2, "pending")], "batch_id long, chunk_number int, status string"
    ).withColumns({**{n: F.lit(0).cast("long") for n in ("processed_count", "successful_count", "failed_count")},
                   "error_message": F.lit("old"), "started_at": F.lit(None).cast("timestamp_ntz"), "completed_at": F.lit(None).cast("timestamp_ntz")})
    batches = spark.createDataFrame([(1, "processing", 2), (2, "queued", 2)], "batch_id long, status string, total_chunks int").withColumn(
        "started_at", F.lit(None).cast("timestamp_ntz"))
    spark.createDataFrame([], "result_id long, batch_id long, url string, url_hash string").write.parquet(stored)

    def score(url):
        calls.add(1)
        return {"store_name": url}

    for _ in range(2):
        run = runs.enrich_run(work, batches, chunks, path, stored, enrich.per_item(score), NOW, digits=1)
        assert sorted((r.batch_id, r.status, r.processed_count, r.current_chunk) for r in run.batches.collect()) == [
            (1, "completed", 3, 2), (2, "processing", 1, 1)]
        assert {(r.batch_id, r.chunk_number): (r.status, r.error_message) for r in run.chunks.collect()}[2, 2] == ("pending", "old")
        assert spark.read.parquet(stored).count() == 3 and calls.value == 2


def ticks(call_seconds):
    """A clock that calls and waits move on."""

    class Ticks(rates.Clock):
        at = 1000.0

        def now(self):
            self.at += call_seconds / 2
            return self.at

        def wait(self, seconds):
            self.at += seconds

    return Ticks()


@pytest.mark.parametrize("per_minute, call_seconds", [(55, 0.01), (6, 0.5), (30, 9.0)])
def test_no_key_exceeds_its_limit(spark, per_minute, call_seconds):
    items = spark.createDataFrame([(k, f"https://x/{k}") for k in range(240)], "item_id long, url string")

    def score(url):
        if url.endswith("7"):
            raise ValueError("no image")
        return {"store_name": url}

    for work in (enrich.per_item(score), lambda urls: [score(u) for u in urls]):
        keyed_rows = rates.with_keys(items, 3, [F.col("item_id").asc()])
        called = rates.enrich_at_rate(keyed_rows, work, per_minute, 0.1, clock=ticks(call_seconds)).cache()
        got = sorted(called.collect(), key=lambda r: r.item_id)
        assert [(r.api_key, r.turn) for r in got] == [(k % 3, k // 3) for k in range(240)]
        assert [r.success for r in got] == [k % 10 != 7 for k in range(240)] and got[7].error == "no image"
        for key in range(3):
            times = sorted(r.called_at for r in got if r.api_key == key)
            most = max(sum(1 for t in times if at - 60 < t <= at) for at in times)
            assert most <= per_minute * 0.9 + 1e-9 + (per_minute * 0.9 % 1 > 0) and min(b - a for a, b in zip(times, times[1:])) >= rates.gap_seconds(per_minute) - 1e-6
            found = rates.most_in_a_minute(called).filter(F.col("api_key") == key).head()
            assert (found.calls, found.most) == (80, most)
    assert rates.enrich_at_rate(rates.with_keys(items.limit(0), 3, [F.col("item_id").asc()]), enrich.per_item(score), clock=ticks(1)).count() == 0
    with pytest.raises(ValueError):
        rates.gap_seconds(0)


def test_update_log_ends(spark, tmp_path):
    """What is older than the fold before the last goes, and a restart starts from the folds that are left."""
    folder = str(tmp_path / "out")
    def kept():
        return sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "rows").glob("version=*"))

    source = stream_of(spark, rows(spark), tmp_path, [f"item_id % 9 = {k}" for k in range(9)])
    counts = source.groupBy("url").agg(F.count("*").alias("n"))
    streams.start_update(counts, folder, keys=["url"], fold_every=2).awaitTermination()
    assert kept() == [6, 7, 8]
    got = {r.url: r.n for r in streams.read_latest(counts, ["url"], folder).collect()}
    assert got == {f"https://x/{k}": 4 for k in range(10)}
    streams.start_update(counts, folder, keys=["url"], fold_every=2).awaitTermination()
    assert {r.url: r.n for r in streams.read_latest(counts, ["url"], folder).collect()} == got and len(kept()) <= 4


def test_update_log_is_folded(spark, tmp_path):
    """Counters over many micro-batches: readers look at the last fold and what came after it only."""
    folder = str(tmp_path / "out")
    source = stream_of(spark, rows(spark), tmp_path, [f"item_id % 7 = {k}" for k in range(7)])
    counts = source.groupBy("url").agg(F.count("*").alias("n"))
    streams.start_update(counts, folder, keys=["url"], fold_every=3).awaitTermination()
    got = {r.url: r.n for r in streams.read_latest(counts, ["url"], folder).collect()}
    assert got == {f"https://x/{k}": 4 for k in range(10)}
    folds = {int(p.split("version=")[1].split("/")[0]) for p in map(str, (tmp_path / "out" / "rows").glob("version=*/whole=1"))}
    assert folds == {3, 6}


def test_a_quote_left_open_raises_before_its_lines_are_held(spark, tmp_path):
    lines = ["url,note", 'http://a.test/1,"two', 'lines"', 'http://a.test/2,"open', *[f"http://a.test/{i}" for i in range(3, 2000)]]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match="record 2 of .*a.csv has .*http://a.test/2"):
        join_lines(spark, str(tmp_path / "a.csv"), record_bytes=10_000)
    whole = join_lines(spark, str(tmp_path / "a.csv"))
    assert {r.number for r in whole.collect()} == {0, 1, 2}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_found_on_a_sample_lose_no_row(spark, how):
    left = spark.range(200_000).withColumn("k", F.when(F.col("id") % 10 < 9, F.lit(-1)).when(F.col("id") % 100 == 99, None).otherwise(F.col("id") % 50))
    right = spark.createDataFrame([(-1, "x"), (9, "y"), (9, "z")], "k long, w string")
    got = skew_join(left, right, ["k"], how, ["id"], floor=64_000)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
