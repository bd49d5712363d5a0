"""Keyed tables: versions, folds, breaks, and counters carried on by differences."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from batchloom import files
from batchloom.operators import cache, enrich, keyed, runs

NOW = "2024-01-31 00:00:00"
LAYOUT = keyed.Layout(keys=("k",), bucket="pmod(k, 4)", wins=("ok",), watch=("ok", "chunk"))
SCHEMA = "k long, ok boolean, chunk int, note string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, **more):
    return {r.k: (r.ok, r.chunk, r.note) for r in keyed.read(spark, path, **more).collect()}


def test_random_upserts_equal_a_dictionary(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "t")
    want = {k: (rng.random() < 0.5, k % 3, "first") for k in range(30)}
    keyed.create(table(spark, [(k, *v) for k, v in want.items()]), path, LAYOUT)
    old = {0: dict(want)}
    for turn in range(6):
        fresh = [(k, rng.random() < 0.5, k % 3, f"turn {turn}") for k in rng.sample(range(40), 9)]
        version = keyed.upsert(path, table(spark, fresh), fold_rows=8, most_changes=2)
        for k, *row in fresh:
            if k not in want or row[0] >= want[k][0]:
                want[k] = tuple(row)
        old[version] = dict(want)
        assert held(spark, path) == want
    for version, rows in old.items():
        assert held(spark, path, version=version) == rows
    one = held(spark, path, buckets=["1"])
    assert one == {k: v for k, v in want.items() if k % 4 == 1}


def test_nulls_repeats_and_nothing_new(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(table(spark, []), path, LAYOUT)
    rows = table(spark, [(None, True, 1, "a"), (1, False, 1, "b"), (1, True, 1, "c"), (1, True, 1, "d"), (2, None, None, None)])
    assert keyed.upsert(path, rows, [F.col("note")]) == 1
    want = {None: (True, 1, "a"), 1: (True, 1, "c"), 2: (None, None, None)}
    assert held(spark, path) == want
    assert keyed.upsert(path, rows, [F.col("note")]) == 1 and keyed.upsert(path, table(spark, [(1, False, 2, "x")])) == 1
    assert held(spark, path) == want and len(list(Path(path, "rows").iterdir())) == 2
    with pytest.raises(FileExistsError):
        keyed.create(rows, path, LAYOUT)
    with pytest.raises(ValueError):
        keyed.read(spark, str(tmp_path / "none"))


def test_changes_carry_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(table(spark, [(1, False, 1, "a"), (2, True, 1, "b")]), path, LAYOUT)
    for rows in ([(1, True, 2, "c"), (3, False, 1, "d")], [(3, True, 1, "e")]):
        keyed.upsert(path, table(spark, rows), most_changes=0)
    got = {(r.k, r[keyed.VERSION], r[keyed.FORMER] and tuple(r[keyed.FORMER])) for r in keyed.changes(spark, path, 0).collect()}
    assert got == {(1, 1, (False, 1)), (3, 1, None), (3, 3, (False, 1))}
    gone = keyed.forget(spark, path, 2)
    assert gone and held(spark, path) == {1: (True, 2, "c"), 2: (True, 1, "b"), 3: (True, 1, "e")}
    assert [r.k for r in keyed.changes(spark, path, 2).collect()] == [3]
    with pytest.raises(ValueError, match="kept after version 2"):
        keyed.changes(spark, path, 0)


@pytest.mark.parametrize("breaks_at", ["change", "fold", "manifest"])
def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch, breaks_at):
    path = str(tmp_path / "t")
    keyed.create(table(spark, [(k, True, 1, "a") for k in range(20)]), path, LAYOUT)
    fresh = table(spark, [(k, True, 2, "b") for k in range(10)])
    count = [0]

    def put(rows, at, folder):
        count[0] += 1
        keyed.put(rows, at, folder)
        if count[0] == {"change": 1, "fold": 2}.get(breaks_at):
            raise RuntimeError("executor lost")

    if breaks_at == "manifest":
        def lost(*_):
            raise RuntimeError("executor lost")

        monkeypatch.setattr(keyed.files, "put_text", lost)
    with pytest.raises(RuntimeError):
        keyed.upsert(path, fresh, most_changes=0, put=put)
    monkeypatch.undo()
    # a change that has its manifest counts, whatever becomes of the fold
    stored = sum(v[2] == "b" for v in held(spark, path).values())
    assert stored == (10 if breaks_at == "fold" else 0)
    keyed.upsert(path, fresh, most_changes=0)
    assert sum(v[2] == "b" for v in held(spark, path).values()) == 10 and len(held(spark, path)) == 20
    keyed.forget(spark, path, keyed.versions(spark, path)[-1])
    assert sum(v[2] == "b" for v in held(spark, path).values()) == 10


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(table(spark, [(k, True, 1, "a") for k in range(400)]), path, LAYOUT)
    def size():
        return sum(f.stat().st_size for f in Path(path, "rows").rglob("*.parquet"))

    whole = size()
    for turn in range(12):
        keyed.upsert(path, table(spark, [(8 + 4 * turn, True, turn, "new")]), fold_rows=1000, most_changes=100)
    # twelve small files, no bucket written anew
    assert size() - whole < 12 * 4000 and len(list(Path(path, "rows").iterdir())) == 13
    assert {p.name for p in Path(path, "rows").glob("folder=change-*/*") if p.is_dir()} == {"bucket=0"}
    plan = keyed.read(spark, path, ["3"])._jdf.queryExecution().toString()
    assert "bucket=3" in "".join(keyed.read(spark, path, ["3"]).inputFiles()) and "change-" not in plan
    assert len(held(spark, path)) == 400


def test_cache_folds_a_bucket_alone(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(f"https://x/{k}", "{}", 1) for k in range(200)]
    first = cache._latest(spark.createDataFrame(rows, "url string, analysis_data string, at int"), NOW)
    cache.write_cache(first, path, digits=1)
    one = first.filter("url_hash like 'a%'").head().url
    for k in range(3):
        cache.upsert_cache(path, spark.createDataFrame([(one, str(k), k)], "url string, analysis_data string, at int"), NOW, digits=1, compact_after=2)
    m = keyed.manifest(spark, path)
    folded = {b for b, v in m.buckets.items() if v["whole"] != m.buckets["0"]["whole"]}
    assert folded == {"a"} and not m.buckets["a"]["changes"]
    cache.tidy_cache(spark, path)
    got = cache.read_cache(spark, path)
    assert got.count() == 200 and got.filter(F.col("url") == one).head().analysis_data == "2"


# runs that are repeated

def scorer(fails):
    def score(url):
        if url.rsplit("/", 1)[1] in fails:
            raise ValueError("no image")
        return {"store_name": url}

    return enrich.per_item(score)


def start(spark, tmp_path):
    urls = [(1, 1, 1, "https://x/a"), (1, 1, 2, "https://x/b"), (1, 2, 3, "https://x/c"), (1, 2, 4, "https://x/d"), (2, 1, 5, "https://x/a"), (9, 1, 6, "https://x/z")]
    work = spark.createDataFrame(urls, "batch_id long, chunk_number int, item_id long, url string")
    chunks = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending"), (2, 1, "pending"), (2, 2, "pending")],
                                   "batch_id long, chunk_number int, status string").withColumns({
        **{n: F.lit(0).cast("long") for n in ("processed_count", "successful_count", "failed_count")}, "error_message": F.lit(None).cast("string"),
        "started_at": F.lit(None).cast("timestamp_ntz"), "completed_at": F.lit(None).cast("timestamp_ntz")})
    batches = spark.createDataFrame([(1, "queued", 2), (2, "queued", 2)], "batch_id long, status string, total_chunks int").withColumn(
        "started_at", F.lit(None).cast("timestamp_ntz"))
    none = cache._latest(spark.createDataFrame([], "url string, analysis_data string, at int"), NOW)
    cache.write_cache(none, str(tmp_path / "cache"), digits=1)
    schema = "result_id long, batch_id long, chunk_number int, url string, url_hash string, success boolean, store_name string, created_at timestamp_ntz"
    runs.create_results(spark.createDataFrame([], schema), str(tmp_path / "stored"), runs.results_layout(4, 2))
    return work, chunks, batches, str(tmp_path / "cache"), str(tmp_path / "stored")


def counters(chunks):
    return {(r.batch_id, r.chunk_number): (r.processed_count, r.successful_count, r.failed_count, r.status) for r in chunks.collect()}


def test_second_run_over_failures(spark, tmp_path):
    work, chunks, batches, cached, stored = start(spark, tmp_path)
    first = runs.enrich_run(work, batches, chunks, cached, stored, scorer({"b", "c"}), NOW, digits=1)
    assert counters(first.chunks) == {(1, 1): (2, 1, 1, "completed"), (1, 2): (2, 1, 1, "completed"), (2, 1): (1, 1, 0, "completed"), (2, 2): (0, 0, 0, "pending")}
    todo = runs.failed_items(spark, stored, batches)
    assert {r.url for r in todo.collect()} == {"https://x/b", "https://x/c"}
    again = runs.enrich_run(todo, batches, first.chunks, cached, stored, scorer({"c"}), NOW, digits=1)
    assert counters(again.chunks)[1, 1] == (2, 2, 0, "completed") and counters(again.chunks)[1, 2] == (2, 1, 1, "completed")
    assert {(r.batch_id, r.processed_count, r.successful_count, r.failed_count) for r in again.batches.collect()} == {(1, 4, 3, 1), (2, 1, 1, 0)}
    kept = keyed.read(spark, stored)
    # the batch that nobody knows has stored nothing
    assert kept.count() == 5 and {r.url for r in kept.filter("not success").collect()} == {"https://x/c"}
    # a success is not lost to a failure, and the counters do not move
    cache.write_cache(cache._latest(spark.createDataFrame([], "url string, analysis_data string, at int"), NOW), cached + "2", digits=1)
    worse = runs.enrich_run(work, batches, again.chunks, cached + "2", stored, scorer({"a", "b", "c", "d"}), NOW, digits=1)
    assert {k: v[:3] for k, v in counters(worse.chunks).items()} == {k: v[:3] for k, v in counters(again.chunks).items()}


def test_run_that_broke_off_is_counted_once(spark, tmp_path):
    work, chunks, batches, cached, stored = start(spark, tmp_path)
    first = runs.enrich_run(work.filter("item_id <= 2"), batches, chunks, cached, stored, scorer({"b"}), NOW, digits=1)
    # results are stored, but their counters are lost
    runs.enrich_run(work, batches, first.chunks, cached, stored, scorer(set()), NOW, digits=1)
    again = runs.enrich_run(work, batches, first.chunks, cached, stored, scorer(set()), NOW, digits=1, counted=first.version)
    assert {k: v[:3] for k, v in counters(again.chunks).items()} == {(1, 1): (2, 2, 0), (1, 2): (2, 2, 0), (2, 1): (1, 1, 0), (2, 2): (0, 0, 0)}
    more = runs.enrich_run(work, batches, again.chunks, cached, stored, scorer(set()), NOW, digits=1, counted=again.version)
    assert counters(more.chunks) == counters(again.chunks) and more.version == again.version


def test_sketches_lose_no_hash(spark, tmp_path):
    """Changes, folds, repeated and null hashes, a folder without a sketch; what a sketch lets pass wrongly is little."""
    path = str(tmp_path / "cache")
    known = cache.with_hash(spark.range(20_000).select(F.format_string("https://x/%d", "id").alias("url"))).select(
        "url_hash", "url", F.lit("{}").alias("analysis_data"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("accessed_at"), F.lit(1).cast("long").alias("access_count"))
    cache.write_cache(known, path, digits=1)
    more = spark.range(20_000, 20_400).select(F.format_string("https://x/%d", "id").alias("url"), F.lit("{}").alias("analysis_data"), F.col("id").alias("at"))
    cache.upsert_cache(path, more, NOW, digits=1)
    held = cache.read_cache(spark, path).select("url_hash")
    new = cache.with_hash(spark.range(100_000, 120_000).select(F.format_string("https://x/%d", "id").alias("url"))).select("url_hash")
    odd = spark.createDataFrame([(None,)], "url_hash string")
    asked = held.unionByName(held.limit(50)).unionByName(new).unionByName(odd)
    got = {r[0] for r in cache.possible(asked, path).collect()}
    inside = {r[0] for r in held.collect()}
    assert inside <= got and None not in got and len(got - inside) < 100
    # hashes that are not there lead to few buckets
    assert len(cache.buckets_for(new.limit(30), path)) <= 3
    urls = spark.createDataFrame([(1, "https://x/7"), (2, "https://y/1"), (3, "https://y/1"), (4, "https://x/20399")], "item_id long, url string")
    assert sorted(r["item_id"] for r in cache.missing_at(urls, path, ["item_id"]).collect()) == [2, 3]
    cache.tidy_cache(spark, path)
    assert inside <= {r[0] for r in cache.possible(asked, path).collect()}
    for name in files.names(spark, f"{path}/sketch")[:1]:
        files.remove(spark, f"{path}/sketch/{name}")
    assert inside <= {r[0] for r in cache.possible(asked, path).collect()}
