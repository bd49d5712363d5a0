"""Random inputs against brute force."""

import csv
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from batchloom.operators import anchors, ingest, lifecycle, metrics
from batchloom.operators.paging import Listing, page_results
from batchloom.plans.views import view
from batchloom.sources.url_csv import scan_url_csv, spans_lines

SF = "/root/testdata/sf0.001"

NASTY = ['5" disk', '"', 'a"b,c', '"\n"', "\n\n", 'x""y', ',"', '"quoted"']
CELLS = ["", " ", "\t", "https://a/{}", " http://b/{} ", "HTTPS://c/{}", "ftp://d/{}", 'https://e/{}?q="x"', "https://f/{},g", "note {}"]


def random_csv(path, seed, broken):
    rnd = random.Random(seed)
    cells = CELLS + (["https://h/{}\nnext line", 'say "{}"\nand more', *NASTY] if broken else [])
    header = rnd.sample(["url", "URL", "image_url", "link", "other", "batch_name"], 5)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(header)
        for i in range(200):
            w.writerow([rnd.choice(cells).format(rnd.randrange(60)) for _ in header])


def expected(path):
    out = []
    with open(path, newline="", encoding="utf-8") as f:
        for row in csv.DictReader(f):
            filled = [row[c] for c in ("url", "URL", "image_url", "link") if row.get(c)]
            url = filled[0].strip() if filled else ""
            if url.startswith(("http://", "https://")):
                out.append(url)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("broken", [False, True])
def test_csv_as_the_csv_module_reads_it(spark, tmp_path, seed, broken):
    path = str(tmp_path / "in.csv")
    random_csv(path, seed, broken)
    assert spans_lines(spark, path) is broken
    want = expected(path)
    assert [r.url for r in scan_url_csv(spark, path).orderBy("seq").collect()] == want
    made = ingest.create_batch(spark, path, "b", "2024-01-31 00:00:00", size=7)
    assert [r.url for r in made.urls.orderBy("position").collect()] == list(dict.fromkeys(want))


def test_stray_and_opening_quote_in_one_line(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write('note,url\n5" disk,"https://a/1\n"\nx,https://b/2\n')
    assert spans_lines(spark, path)
    assert [r.url for r in scan_url_csv(spark, path).orderBy("seq").collect()] == expected(path) == ["https://a/1", "https://b/2"]


@pytest.mark.parametrize("seed", range(3))
def test_records_over_many_splits(spark, tmp_path, seed):
    """Lines of one file in many tasks give the same records, stray quotes included."""
    path = str(tmp_path / "in.csv")
    random_csv(path, 100 + seed, True)
    with open(path, "a", encoding="utf-8") as f:
        f.write('a 5" disk,https://z/1,b"c,d,e\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert [r.url for r in scan_url_csv(spark, path).orderBy("seq").collect()] == expected(path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_file_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    urls = [f"https://x/{i}" for i in range(5000)]
    with open(path, "w") as f:
        f.write("url\n" + "\n".join(urls) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = scan_url_csv(spark, path)
        assert df.rdd.getNumPartitions() > 2
        assert [r.url for r in df.orderBy("seq").collect()] == urls
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_do_not_depend_on_splits(spark, tmp_path):
    """Several files with headers of their own, some with records over lines: same seq and same first URL for any split size."""
    folder = tmp_path / "many"
    folder.mkdir()
    for seed in range(5):
        random_csv(str(folder / f"part-{seed}.csv"), 300 + seed, seed % 2 == 1)
    got = []
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    try:
        for values in (("600", "1", "3"), ("5000", "1", "8"), ("134217728", "4194304", "1")):
            for n, v in zip(names, values):
                spark.conf.set(n, v)
            rows = scan_url_csv(spark, str(folder))
            assert rows.rdd.getNumPartitions() >= 1
            got.append(sorted((r.seq, r.url) for r in rows.collect()))
            made = ingest.dedupe_first_seen(rows.withColumn("batch_id", F.lit(1)))
            got[-1].append(sorted((r.seq, r.url) for r in made.collect()))
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert got[0] == got[1] == got[2]
    want = [u for seed in range(5) for u in expected(str(folder / f"part-{seed}.csv"))]
    assert [u for _, u in got[0][:-1]] == want and len({s for s, _ in got[0][:-1]}) == len(want)


def test_hundreds_of_headers(spark, tmp_path):
    folder = tmp_path / "heads"
    folder.mkdir()
    for k in range(530):
        (folder / f"{k:03d}.csv").write_text(f"extra{k},url\nx,https://h/{k}\n")
    got = [r.url for r in scan_url_csv(spark, str(folder)).orderBy("seq").collect()]
    assert got == [f"https://h/{k}" for k in range(530)]


@pytest.mark.parametrize("block", [3, 1000])
def test_command_sequences(spark, block):
    batches = view(spark, "/root/testdata/sf0.001", "f_batches").select("batch_id", "status")
    state = {r.batch_id: r.status for r in batches.collect()}
    rnd = random.Random(3)
    hot = next(iter(state))
    cmds = [(hot if rnd.random() < 0.4 else rnd.choice(list(state)), i, rnd.choice(["pause", "resume", "cancel", "retry", "start"]))
            for i in range(900)]
    for b, _, action in cmds:
        state[b] = lifecycle.TRANSITIONS.get(action, {}).get(state[b], state[b])
    df = spark.createDataFrame(cmds, "batch_id long, seq long, action string").orderBy(F.rand(1))
    got = lifecycle.run_sequences(batches, df, block).collect()
    assert {r.batch_id: r.status for r in got} == state and sum(r.commands for r in got) == 900


def test_rolling_means(spark):
    rnd = random.Random(5)
    rows = [(i, "hot" if rnd.random() < 0.6 else "k", rnd.randrange(0, 400), None if rnd.random() < 0.1 else rnd.random())
            for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r for r in metrics.rolling_means(df, ["v"], 60, ["k"]).collect()}
    assert len(got) == 600
    for i, k, s, _ in rows:
        near = [v for _, k2, s2, v in rows if k2 == k and s - 60 < s2 <= s]
        known = [v for v in near if v is not None]
        assert got[i].samples == len(near)
        assert got[i].avg_v == (pytest.approx(sum(known) / len(known)) if known else None)


@pytest.mark.parametrize("size", [2, 7, 500])
def test_commands_with_sparse_numbers(spark, size):
    """Numbers far apart, as micro-seconds are, and most commands of one batch."""
    rnd = random.Random(size)
    state = {k: rnd.choice(["pending", "queued", "processing", "paused", "failed"]) for k in range(4)}
    batches = spark.createDataFrame(list(state.items()), "batch_id long, status string")
    cmds = [(0 if rnd.random() < 0.8 else rnd.randrange(5), 10**15 + rnd.randrange(10**14), rnd.choice(["pause", "resume", "cancel", "retry", "start"])) for _ in range(600)]
    for b, _, action in sorted(cmds, key=lambda c: c[1]):
        if b in state:
            state[b] = lifecycle.TRANSITIONS.get(action, {}).get(state[b], state[b])
    got = lifecycle.run_sequences(batches, spark.createDataFrame(cmds, "batch_id long, seq long, action string"), size).collect()
    assert {r.batch_id: r.status for r in got} == state and sum(r.commands for r in got) == sum(b < 4 for b, _, _ in cmds)
    none = lifecycle.run_sequences(batches, spark.createDataFrame([], "batch_id long, seq long, action string"), size).collect()
    assert all(r.commands == 0 and r.status == r.previous_status for r in none)


def test_rolling_values_of_dense_series(spark):
    """A sample every few milliseconds with a window of a second, ties, nulls and gaps; one key holds most."""
    rnd = random.Random(5)
    rows, now = [], 1_700_000_000_000_000
    for i in range(1500):
        now += rnd.choice([0, 0, 1000, 3000, 250_000, 1_000_000 if i % 300 == 0 else 2000])
        rows.append((i, "a" if rnd.random() < 0.9 else "b", now, None if rnd.random() < 0.1 else rnd.randrange(-50, 50)))
    df = spark.createDataFrame(rows, "i long, k string, us long, v long").withColumn("ts", F.timestamp_micros("us")).unionByName(
        spark.createDataFrame([(-1, "a", None, 3, None)], "i long, k string, us long, v long, ts timestamp"))
    got = {r.i: r for r in metrics.rolling_values(df, {"lo": ("min", "v"), "hi": ("max", "v"), "n": ("count", "v"), "all": ("count", None),
                                                       "m": ("mean", "v"), "s": ("sum", "v")}, 1, ["k"]).collect()}
    assert len(got) == 1501 and got[-1].lo is None and got[-1].n is None
    for i, k, us, _ in rows:
        inside = [v for _, k2, us2, v in rows if k2 == k and us - 1_000_000 < us2 <= us]
        some = [v for v in inside if v is not None]
        r = got[i]
        assert (r.lo, r.hi, r.n, r.all) == (min(some, default=None), max(some, default=None), len(some), len(inside))
        assert r.s == sum(some) and (r.m is None if not some else abs(r.m - sum(some) / len(some)) < 1e-9)


@pytest.mark.parametrize("sort", ["processing_time_seconds:asc", "processing_time_seconds:desc"])
def test_pages_of_a_listing_written_once(spark, tmp_path, sort):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 0.5, 1.0, 2.5, float(i % 50)]), f"u{i}") for i in rnd.sample(range(1000), 230)]
    df = spark.createDataFrame(rows, "result_id long, processing_time_seconds double, url string")
    path, up = str(tmp_path / "l"), sort.endswith("asc")
    assert anchors.write_listing(df, path, sort, "result_id", slice_rows=32) == 230
    def place(value, key):
        return ((value is None) == up, (value or 0) * (1 if up else -1), key)

    want = sorted(rows, key=lambda r: place(r[1], r[0]))
    for page in (1, 4, 8, 9):
        assert [tuple(r) for r in anchors.read_page(spark, path, page, 30).collect()] == want[30 * (page - 1):30 * page]
    files = anchors.read_page(spark, path, 4, 30).inputFiles()
    assert {f.split("__slice=")[1].split("/")[0] for f in files} == {"2", "3"}
    for value, key in [(w[1], w[0]) for w in want[::23]] + [(0.7, 5), (None, 10**6), (-1.0, 0), (None, -1), (1e9, 1)]:
        behind = [r for r in want if place(r[1], r[0]) > place(value, key)][:11]
        assert [tuple(r) for r in anchors.read_after(spark, path, value, key, 11).collect()] == behind
    assert anchors.write_listing(df.limit(0), str(tmp_path / "none"), sort, "result_id") == 0
    assert anchors.read_page(spark, str(tmp_path / "none"), 1, 5).count() == 0


def test_listing_that_does_not_cover_falls_back(spark, tmp_path):
    df = view(spark, SF, "f_results").withColumn("image_description", F.lit("d"))
    ask = Listing(per_page=20, contact="true")
    path = str(tmp_path / "l")
    anchors.write_results_listing(df, path, ask, slice_rows=100)
    for other, covered in ((ask, True), (replace(ask, page=3, sort="nonsense"), True), (replace(ask, contact="false"), False), (replace(ask, sort="created_at:asc"), False)):
        assert anchors.covers(spark, path, other) is covered
        assert anchors.page_of_results(df, path, other).collect() == page_results(df, other).collect()
