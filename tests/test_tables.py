"""Listings, health, lifecycle, cache and exports on small tables."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from batchloom import schemas
from batchloom.operators import cache, filters, ingest, jobs, lifecycle, metrics, paging, relations, rollups
from batchloom.operators.paging import Listing
from batchloom.plans.views import view
from batchloom.sinks import exports, layout
from batchloom.sources.job_log import scan_job_log
from batchloom.sources.tables import conform, scan_table
from batchloom.sources.url_csv import scan_url_csv

SF = "/root/testdata/sf0.001"
NOW = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def results(spark):
    df = view(spark, SF, "f_results").withColumns(
        {"image_description": F.lit(None).cast("string"), "phone_number": F.lit(None).cast("boolean")}
    )
    return df.persist()


# --- ingest ---------------------------------------------------------------------

def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def urls_of(spark, path):
    return [r.url for r in scan_url_csv(spark, path).orderBy("seq").collect()]


def test_csv_columns(spark, tmp_path):
    path = put(tmp_path / "a.csv", "\n".join([
        "url,URL,image_url,link", "https://a/1,,,", ",https://b/1,,", '"  ",https://b/2,,', " https://c/1 ,,,",
        "HTTP://d/1,,,", "ftp://e/1,,https://e/2,", ",,,http://f/1", '"https://g/1,x""y",,,', '"https://h/1\nz",,,',
        "\thttps://t/1\t,,,",
    ]) + "\n")
    assert urls_of(spark, path) == [
        "https://a/1", "https://b/1", "https://c/1", "http://f/1", 'https://g/1,x"y', "https://h/1\nz", "https://t/1",
    ]


def test_csv_without_url_column(spark, tmp_path):
    path = put(tmp_path / "b.csv", "not,a,valid,csv\nwith,missing,columns\n")
    assert urls_of(spark, path) == []
    with pytest.raises(ValueError):
        ingest.create_batch(spark, path, "b", NOW)


def test_csv_template(spark, tmp_path):
    path = put(tmp_path / "c.csv", "url,batch_name,priority\nhttps://example.com/image1.jpg,Example Batch,normal\n")
    assert urls_of(spark, path) == ["https://example.com/image1.jpg"]


def test_create_batch(spark, tmp_path):
    lines = [f"https://example.com/store/{i % 45}/image.jpg" for i in range(50)]
    path = put(tmp_path / "d.csv", "url\n" + "\n".join(lines) + "\n")
    made = ingest.create_batch(spark, path, "b1", NOW, size=20, keys=2)
    b = made.batch.head()
    assert (b.total_urls, b.total_chunks, b.status, b.batch_name) == (45, 3, "pending", "Batch_20240131_000000")
    assert (b.original_filename, b.file_size_bytes) == ("d.csv", len("url\n" + "\n".join(lines) + "\n"))
    assert json.loads(b.processing_config) == {"chunk_size": 20, "max_retries": 3, "timeout": 30}
    assert {r.chunk_number: r.url_count for r in made.chunks.collect()} == {1: 20, 2: 20, 3: 5}
    got = [(r.position, r.url) for r in made.urls.orderBy("position").collect()]
    assert got == list(enumerate(lines[:45], 1))


def test_chunks_are_full_but_the_last(spark):
    rows = spark.range(1, 2346).select(F.lit(1).alias("batch_id"), (F.col("id") * 7919).alias("seq"), F.lit("u").alias("url"))
    sizes = {r.chunk_number: r.url_count for r in ingest.chunk_rows(ingest.assign_chunks(rows, 100)).collect()}
    assert sum(sizes.values()) == 2345 and all(sizes[k] == 100 for k in range(1, 24)) and sizes[24] == 45


def test_job_log(spark, tmp_path):
    records = [
        {"job_id": "1", "job_type": "chunk_processing", "status": "pending", "created_at": "2024-01-02T03:04:05.250000",
         "payload": {"batch_id": "b", "chunk_id": "c", "urls": ["x", "y"]}, "retry_count": 0, "max_retries": 3},
        {"job_id": "2", "job_type": "test_job", "status": "failed", "created_at": None, "payload": {"test": True}},
    ]
    path = put(tmp_path / "jobs.jsonl", "\n".join(map(json.dumps, records)) + "\nnot json\n")
    got = {r.job_id: r for r in scan_job_log(spark, path).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].batch_id, got["1"].chunk_id, got["1"].url_count) == ("b", "c", 2)
    assert got["1"].created_at.microsecond == 250_000 and got["2"].batch_id is None


# --- listing --------------------------------------------------------------------

def test_listing_filters_hold(spark, results):
    for value, want in (("true", True), ("false", False)):
        rows = paging.page_results(results, Listing(store_image=value)).collect()
        assert rows and all(r.store_image is want for r in rows)
        rows = paging.page_results(results, Listing(success=value)).collect()
        assert rows and all(r.success is want for r in rows)
    assert len(paging.page_results(results, Listing(per_page=10)).collect()) == 10
    assert paging.page_results(results, Listing()).columns == [
        "success", "store_image", "text_content", "store_name", "business_contact", "phone_number",
        "image_description", "url", "processing_time_seconds", "created_at", "batch_id",
    ]


def test_listing_order_and_limits(spark, results):
    up = [r.created_at for r in paging.page_results(results, Listing(sort="created_at:asc")).collect()]
    down = [r.created_at for r in paging.page_results(results, Listing(sort="created_at:desc")).collect()]
    assert up == sorted(up) and down == sorted(down, reverse=True)
    assert Listing(per_page=5000).size == 5000 and Listing(per_page=0).size == 1 and Listing(page=-3).offset == 0
    # an unknown field falls back to the newest first
    assert [r.created_at for r in paging.page_results(results, Listing(sort="password:desc")).collect()] == down


def test_listing_without_match(spark, results):
    ask = Listing(batch_id="00000000-0000-0000-0000-000000000000")
    assert paging.page_results(results, ask).count() == 0
    assert paging.page_total(results, ask).head().total == 0


def test_batch_id_spellings(spark):
    whole = "12345678-1234-5678-1234-567812345678"
    df = spark.createDataFrame([(whole,), ("87654321-1234-5678-1234-567812345678",)], "batch_id string")
    for text in (whole, whole.upper(), "{" + whole + "}", whole.replace("-", ""), f"urn:uuid:{whole}"):
        assert [r.batch_id for r in df.filter(filters.batch_id_matches(text)).collect()] == [whole]
    assert df.filter(filters.batch_id_matches("1234-5678")).count() == 2 and filters.batch_id_matches("") is None


def test_pages_add_up(spark, results):
    total = paging.page_total(results, Listing()).head().total
    seen = []
    for page in range(1, total // 400 + 2):
        seen += [r.url + r.created_at for r in paging.page_results(results, Listing(page=page, per_page=400)).collect()]
    assert len(seen) == total == results.count() and len(set(seen)) == total


def test_deep_page_equals_shallow(spark, results):
    ask = Listing(page=4, per_page=50, sort="store_name:asc")
    shallow = paging.page_results(results, ask).collect()
    assert paging.page_results(results, ask, deep_from=10).collect() == shallow


def test_next_page(spark, results):
    first = results.orderBy(*paging.sort_order("created_at:desc")).limit(25).collect()[-1]
    after = paging.next_page(results, Listing(), first.created_at, first.result_id)
    assert after.collect() == paging.page_results(results, Listing(page=2)).collect()


def test_soft_deleted(spark):
    df = spark.createDataFrame(
        [(1, "cancelled", "Soft deleted on x"), (2, "cancelled", "other"), (3, "cancelled", None), (4, "pending", None)],
        "batch_id int, status string, error_message string",
    )
    assert sorted(r.batch_id for r in df.filter(filters.not_soft_deleted()).collect()) == [2, 4]


def test_status_filter():
    with pytest.raises(ValueError):
        filters.status_is("nonsense")
    assert filters.status_is("nonsense", strict=False) is None
    assert filters.status_is("COMPLETED", strict=False) is not None


# --- roll-ups -------------------------------------------------------------------

HEALTH = [  # failed chunks, chunks, status, age in hours, successes, results, score
    (0, 4, "completed", 100, 10, 10, 100.0), (1, 4, "completed", 1, 10, 10, 92.5), (0, 4, "processing", 30, 10, 10, 94.0),
    (0, 4, "queued", 100, 10, 10, 80.0), (4, 4, "processing", 100, 0, 10, 10.0), (0, 0, "pending", 1, 0, 0, 100.0),
]


def test_health_score(spark):
    b, k, r = [], [], []
    for i, (bad, chunks, status, age, ok, n, _) in enumerate(HEALTH):
        b.append((i, status, n, age))
        k += [(i, "failed" if j < bad else "completed") for j in range(chunks)]
        r += [(i, j < ok) for j in range(n)]
    batches = spark.createDataFrame(b, "batch_id int, status string, total_urls int, age int").withColumn(
        "created_at", F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=F.col("age")))
    chunks = spark.createDataFrame(k, "batch_id int, status string")
    out = rollups.health_score(batches, chunks, spark.createDataFrame(r, "batch_id int, success boolean"), NOW).collect()
    got = {x.batch_id: x for x in out}
    assert [got[i].health_score for i in range(len(HEALTH))] == [h[-1] for h in HEALTH]
    assert got[4].issues == ["4 failed chunks", "Processing for 100.0 hours", "Low success rate (0.0%)"]
    assert got[3].issues == [] and len(got[4].recommendations) == 3


def test_percentile_rule(spark):
    df = spark.createDataFrame([(i, True, float(i)) for i in range(1, 21)], "s int, success boolean, response_time double")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    out = metrics.latency_report(df, (50, 95, 99)).head()
    assert (out.p50_response_time, out.p95_response_time, out.p99_response_time) == (11.0, 20.0, 20.0)
    # ties are counted, not collapsed
    tied = df.withColumn("response_time", F.when(F.col("s") <= 18, 1.0).otherwise(F.col("response_time")))
    out = metrics.latency_report(tied, (50, 90)).head()
    assert (out.p50_response_time, out.p90_response_time) == (1.0, 19.0)


def test_latency_of_nothing(spark):
    df = spark.createDataFrame([], "ts timestamp, success boolean, response_time double")
    out = metrics.latency_report(df).head()
    assert (out.total_requests, out.p95_response_time, out.requests_per_second) == (0, 0.0, 0.0)


@pytest.mark.parametrize("fold", [3, 500])
def test_adaptive_rate_bounds(spark, monkeypatch, fold):
    monkeypatch.setattr(metrics, "FOLD", fold)
    rows = [("up", i, 1.0) for i in range(60)] + [("down", i, 0.1) for i in range(60)] + [
        ("mixed", i, [1.0, 0.5, 0.9][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, h int, share double").select(
        "key", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("period"), "share")
    got = {}
    for r in sorted(metrics.adaptive_rate(df).collect(), key=lambda r: r.period):
        got.setdefault(r.key, []).append(r.rate)
    for key in ("up", "down", "mixed"):
        rate, want = 60.0, []
        for k, _, share in sorted(x for x in rows if x[0] == key):
            rate = min(rate * 1.1, 100.0) if share > 0.95 else max(rate * 0.9, 30.0) if share < 0.8 else rate
            want.append(rate)
        assert got[key] == pytest.approx(want)


def test_rollup_variants(spark):
    batches = spark.createDataFrame([(1, "queued", 2), (2, "queued", 2), (3, "paused", 1)], "batch_id int, status string, total_chunks int")
    batches = batches.withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    chunks = spark.createDataFrame(
        [(1, "completed", 5, 4, 1), (1, "failed", None, None, None), (2, "completed", 5, 5, 0), (3, "completed", 1, 1, 0)],
        "batch_id int, status string, processed_count int, successful_count int, failed_count int")
    both = {r.batch_id: r.status for r in rollups.batch_rollup(batches, chunks, NOW).collect()}
    only = {r.batch_id: r.status for r in rollups.batch_rollup(batches, chunks, NOW, count_failed_as_done=False).collect()}
    assert both == {1: "completed", 2: "processing", 3: "paused"}
    assert only == {1: "processing", 2: "processing", 3: "paused"}


# --- life cycle and jobs --------------------------------------------------------

def test_cleanup_touches_only_open_chunks(spark):
    chunks = view(spark, SF, "f_chunks")
    batches = view(spark, SF, "f_batches")
    change = lifecycle.cleanup_stuck(batches, chunks, NOW)
    hit = {r.batch_id for r in change.outcome.collect()}
    for r in change.chunks.collect():
        if r.batch_id in hit:
            assert r.status not in ("pending", "processing")
    assert change.chunks.count() == chunks.count()


def test_start_respects_slots(spark):
    batches = spark.createDataFrame(
        [(i, "queued" if i < 3 else "pending") for i in range(10)], "batch_id long, status string"
    ).withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    asked = spark.createDataFrame([(i,) for i in (9, 8, 5, 4, 0, 77)], "batch_id long")
    got = {r.batch_id: (r.accepted, r.reason) for r in lifecycle.admit_batches(batches, asked).collect()}
    assert [b for b, (ok, _) in sorted(got.items()) if ok] == [4, 5]
    assert got[0][1] == "not pending" and got[77][1] == "not found" and got[9][1].startswith("maximum")


def test_delete_is_refused_when_active(spark):
    batches = spark.createDataFrame([(1, "queued"), (2, "failed")], "batch_id int, status string")
    chunks = spark.createDataFrame([(1, 10), (2, 20)], "batch_id int, chunk_id int")
    res = spark.createDataFrame([(1, 100), (2, 200), (None, 300)], "batch_id int, result_id int")
    store = relations.Store(batches, chunks, res)
    asked = spark.createDataFrame([(1,), (2,)], "batch_id int")
    left, _ = relations.delete_batches(store, asked)
    assert [r.batch_id for r in left.batches.collect()] == [1]
    # a result without batch belongs to none and stays
    assert sorted(r.result_id for r in left.results.collect()) == [100, 300]
    left, outcome = relations.delete_batches(store, asked, force=True)
    assert left.batches.isEmpty() and outcome.filter("accepted").count() == 2


def test_failed_jobs(spark):
    df = spark.createDataFrame([(1, 0, 3), (2, 3, 3)], "job_id int, retry_count int, max_retries int")
    got = {r.job_id: r for r in jobs.fail_jobs(df, NOW, F.lit("boom")).collect()}
    assert (got[1].status, str(got[1].due_at)) == ("retrying", "2024-01-31 00:02:00")
    assert (got[2].status, got[2].due_at) == ("failed", None)


# --- cache ----------------------------------------------------------------------

def test_hits_and_misses_add_up(spark, results):
    known = view(spark, SF, "f_cache")
    rows = results.select("result_id", "url")
    misses = cache.missing(rows, known, ["result_id"]).count()
    assert misses + cache.hits(rows, known, ["result_id"]).count() == rows.count() and misses > 0


def test_upsert_on_disk(spark, tmp_path):
    path = str(tmp_path / "cache")
    known = view(spark, SF, "f_cache")
    cache.write_cache(known, path)
    old = known.orderBy("url").head()
    fresh = spark.createDataFrame([(old.url, "{}", 1), ("https://new/1", '{"a": 1}', 1), ("https://new/1", '{"a": 2}', 2)],
                                  "url string, analysis_data string, at int")
    before = set(glob.glob(path + "/rows/*/*/*.parquet"))
    cache.upsert_cache(path, fresh, NOW)
    written = set(glob.glob(path + "/rows/*/*/*.parquet"))
    # what was there stays as it was; only the two new entries are written
    assert before < written and len(written - before) <= 2
    after = cache.read_cache(spark, path)
    assert after.count() == known.count() + 1
    r = after.filter(F.col("url") == old.url).head()
    assert (r.analysis_data, r.access_count, str(r.created_at)) == ("{}", 1, NOW)
    assert after.filter(F.col("url") == "https://new/1").head().analysis_data == '{"a": 2}'
    part = cache.read_cache(spark, path, [old.url_hash[:2]])
    assert part.filter(F.col("url") == old.url).count() == 1 and part.count() < after.count()


def test_cache_changes_replace_each_other(spark, tmp_path):
    """Later writes win, also over a fold into a new whole; a write without its line in the log does not count."""
    path = str(tmp_path / "cache")
    cache.write_cache(view(spark, SF, "f_cache"), path, digits=1)
    n = cache.read_cache(spark, path).count()
    for k in range(4):
        fresh = spark.createDataFrame([("https://new/1", str(k), k), (f"https://only/{k}", "{}", k)], "url string, analysis_data string, at int")
        cache.upsert_cache(path, fresh, NOW, digits=1, compact_after=2)
        got = cache.read_cache(spark, path)
        assert got.count() == n + 2 + k and got.filter("url = 'https://new/1'").head().analysis_data == str(k)
    broken, put = cache._put, []

    def breaks(rows, *args):
        put.append(1)
        rows.write.parquet(f"{path}/rows/half-{len(put)}")
        raise RuntimeError("executor lost")

    cache._put = breaks
    try:
        with pytest.raises(RuntimeError):
            cache.upsert_cache(path, fresh.withColumn("analysis_data", F.lit("lost")), NOW)
    finally:
        cache._put = broken
    assert cache.read_cache(spark, path).filter("analysis_data = 'lost'").isEmpty()


# --- exports --------------------------------------------------------------------

def read_csv(folder):
    rows, header = [], None
    for part in sorted(glob.glob(f"{folder}/part-*")):
        with open(part, newline="", encoding="utf-8") as f:
            lines = list(csv.reader(f))
        header, rows = lines[0], rows + lines[1:]
    return header, rows


def test_csv_export_is_whole_and_ordered(spark, results, tmp_path):
    exports.write_csv(exports.csv_rows(results), str(tmp_path / "x"))
    header, rows = read_csv(tmp_path / "x")
    assert header == ["url", "store_front", "text_content", "store_name", "business_contact", "phone_number",
                      "image_description", "error_message", "processing_time_seconds", "created_at", "batch_id"]
    want = exports.csv_rows(results).collect()
    assert [r[9] for r in rows] == [r.created_at for r in want] and len(rows) == results.count()
    assert [r[2] for r in rows] == [r.text_content for r in want]


def test_special_characters_survive(spark, tmp_path):
    text = 'a "quoted", text\nwith lines; \\ and é'
    df = spark.createDataFrame([(text, "", None)], "a string, b string, c string").coalesce(1)
    exports.write_csv(df, str(tmp_path / "x"))
    assert read_csv(tmp_path / "x") == (["a", "b", "c"], [[text, "", ""]])


def test_header_only_export(spark, results, tmp_path):
    none = exports.page_rows(results, F.col("batch_id") == -1)
    exports.write_csv(none, str(tmp_path / "x"))
    header, rows = read_csv(tmp_path / "x")
    assert len(header) == 10 and rows == []


def test_listing_and_export_agree(spark, results):
    ask = Listing(store_image="true", per_page=1000)
    exported = exports.page_rows(results, ask.predicate())
    assert exported.count() == paging.page_total(results, ask).head().total
    assert [r.url for r in exported.limit(5).collect()] == [r.url for r in paging.page_results(results, ask).limit(5).collect()]


def test_json_export_keeps_nulls(spark, results, tmp_path):
    exports.write_json(results, str(tmp_path / "x"))
    lines = [line for p in sorted(glob.glob(str(tmp_path / "x/part-*"))) for line in open(p, encoding="utf-8")]
    assert len(lines) == results.count()
    assert set(json.loads(lines[0])) == set(results.columns)


def test_guard(spark, results):
    exports.require_export_size(results)
    with pytest.raises(ValueError):
        exports.require_export_size(results, 10)
    # no limit but the caller's
    assert exports.filtered_rows(results, limit=0).count() == 0
    assert exports.filtered_rows(results).count() == exports.filtered_rows(results, batch_ids=list(range(-2000, 2000))).count() == results.count()
    assert exports.multi_rows(results.select("batch_id").distinct(), results, list(range(-2000, 2000))).count() == results.count()
    with pytest.raises(ValueError):
        exports.export_metadata(results, results, "pdf", NOW)


def test_filename(spark):
    df = spark.createDataFrame([(" Mein Büro: #1/2 (a_b-c) ",)], "n string")
    got = df.select(exports.export_filename(F.col("n"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), "csv")).head()[0]
    assert got == "Mein_Büro_12_a_b-c_20240102_030405.csv"


def test_write_by_batch(spark, results, tmp_path):
    ids = [r.batch_id for r in results.select("batch_id").distinct().limit(3).collect()]
    few = results.filter(F.col("batch_id").isin(ids))
    batches = few.select("batch_id").distinct()
    exports.write_by_batch(exports.multi_rows(batches, few, ids), str(tmp_path / "x"))
    folders = {p.split("=")[-1] for p in glob.glob(str(tmp_path / "x/batch_id=*"))}
    assert folders == {str(i) for i in ids}
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "x")).count() == few.count()


def test_export_batch(spark, results, tmp_path):
    batches = view(spark, SF, "f_batches")
    some = results.filter(~F.col("success")).head().batch_id
    for fmt in exports.FORMATS:
        path = str(tmp_path / fmt)
        about = exports.export_batch(batches, results, some, path, NOW, fmt, only_failed=True).head()
        want = results.filter((F.col("batch_id") == some) & ~F.col("success")).count()
        assert about.record_count == want and about.filename.endswith("_20240131_000000." + {"xlsx": "csv"}.get(fmt, fmt))
        assert spark.read.json(f"{path}/metadata").head().filters_applied == '{"only_failed": "True"}'
    assert len(read_csv(tmp_path / "csv/data")[1]) == want
    assert read_csv(tmp_path / "xlsx/data")[0] == list(exports.SHEET_HEADINGS.values())
    with pytest.raises(ValueError, match="not found"):
        exports.export_batch(batches, results, -1, str(tmp_path / "no"), NOW)
    with pytest.raises(ValueError, match="exceeds"):
        exports.export_batch(batches, results, some, str(tmp_path / "no"), NOW, limit=1)


def test_export_batches(spark, results, tmp_path):
    batches = view(spark, SF, "f_batches")
    ids = [r.batch_id for r in results.select("batch_id").distinct().limit(2).collect()]
    exports.export_batches(batches, results, [*ids, -9], str(tmp_path / "x"))
    _, lines = read_csv(tmp_path / "x/summary")
    assert {line[0]: line[2] for line in lines} == {**{str(i): "" for i in ids}, "-9": "Batch -9 not found"}


def test_append_twice_adds_nothing(spark, results, tmp_path):
    path = str(tmp_path / "stored")
    fresh = results.withColumn("url_hash", F.sha2("url", 256))
    batches = results.select("batch_id").distinct()
    fresh.limit(0).write.parquet(path)
    exports.append_results(path, batches, fresh)
    once = spark.read.parquet(path).count()
    exports.append_results(path, batches, fresh)
    assert once == spark.read.parquet(path).count() == fresh.select("batch_id", "url").distinct().count()


def test_scan_with_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("1", "b", "completed")], "batch_id string, batch_name string, status string").write.parquet(path)
    got = scan_table(spark, path, schemas.BATCHES)
    assert got.columns == schemas.BATCHES.fieldNames() and got.head().status == "completed"


# --- declared schemas -----------------------------------------------------------

def test_declared_schemas_flow_through(spark, tmp_path):
    """Text ids and zoned times, as the declared tables have them, instead of the views' types."""
    batches = conform(view(spark, SF, "f_batches"), schemas.BATCHES)
    chunks = conform(view(spark, SF, "f_chunks"), schemas.CHUNKS)
    res = conform(view(spark, SF, "f_results"), schemas.RESULTS)
    asked = batches.select("batch_id").limit(20)
    for change in (
        lifecycle.start(batches, chunks, asked, NOW, 1000), lifecycle.pause(batches, asked, NOW),
        lifecycle.resume(batches, asked), lifecycle.cancel(batches, asked, NOW), lifecycle.retry(batches, chunks, asked, NOW),
        lifecycle.force_start(batches, chunks, asked, NOW), lifecycle.soft_delete(batches, asked, NOW),
        lifecycle.reset_stuck(batches, chunks, asked), lifecycle.cleanup_stuck(batches, chunks, NOW),
    ):
        assert change.batches.count() == batches.count() and set(batches.columns) <= set(change.batches.columns)
        if change.chunks is not None:
            assert change.chunks.count() == chunks.count() and change.chunks.columns == chunks.columns
    store = relations.Store(batches, chunks, res)
    assert rollups.health_score(batches, chunks, res, NOW).count() == batches.count()
    assert rollups.batch_status(batches, chunks, res, NOW).count() == batches.count()
    assert rollups.batch_rollup(batches, chunks, NOW).count() == batches.count()
    assert relations.batch_details(store).count() == batches.count()
    assert paging.page_batches(batches, chunks).count() == 20
    assert paging.page_results(res, Listing(batch_id="1")).count() > 0
    assert exports.csv_rows(res).count() == exports.json_rows(res).count() == res.count()
    new = spark.createDataFrame([(r.batch_id, f"n{r.batch_id}", "copy") for r in asked.limit(3).collect()],
                                "batch_id string, new_batch_id string, new_name string")
    assert relations.clone_batches(store, new, NOW, copy_results=True).batches.count() == 3


def test_empty_tables(spark):
    batches = spark.createDataFrame([], schemas.BATCHES)
    chunks = spark.createDataFrame([], schemas.CHUNKS)
    res = spark.createDataFrame([], schemas.RESULTS)
    assert rollups.system_summary(batches, res).head().overall_success_rate == 0.0
    assert rollups.export_statistics(batches, res).head().total_urls_processed == 0
    assert rollups.health_score(batches, chunks, res, NOW).count() == 0
    assert relations.retention_preview(relations.Store(batches, chunks, res), relations.in_status("failed")).head()[0] == 0
    assert paging.page_results(res, Listing()).count() == 0
    assert ingest.assign_chunks(spark.createDataFrame([], "batch_id string, seq long, url string")).count() == 0


def test_layout_by_month_prunes(spark, tmp_path):
    path = str(tmp_path / "r")
    res = view(spark, SF, "f_results").withColumn(
        "created_at", F.col("created_at") + F.make_dt_interval(days=(F.col("result_id") % 90).cast("int")))
    layout.write_by_month(res, path)
    got = layout.scan_by_month(spark, path, res.schema, "2024-02-10 00:00:00", "2024-02-20 00:00:00")
    want = filters.where(res, filters.created_from("2024-02-10 00:00:00"), filters.created_until("2024-02-20 00:00:00"))
    assert sorted(r.result_id for r in got.collect()) == sorted(r.result_id for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(created_at" in plan
    assert layout.scan_by_month(spark, path, res.schema).count() == res.count()
