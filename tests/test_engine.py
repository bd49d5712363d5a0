"""Numbering, running sums and joins when one key has most of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from batchloom.operators.ordering import number_rows, running_sums, top_per_key, with_previous_rows
from batchloom.operators.skew import hot_keys, skew_join


def hot_rows(n=3000, seed=7):
    rnd = random.Random(seed)
    return [
        (i, None if rnd.random() < 0.02 else ("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}"), rnd.randrange(50))
        for i in range(n)
    ]


@pytest.mark.parametrize("bucketed", [True, False])
def test_number_rows_matches_brute_force(spark, bucketed):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(7)
    bucket = F.floor(F.col("v") / 5) if bucketed else None
    out = number_rows(df, ["k"], [F.col("v").asc(), F.col("id").desc()], "n", bucket)
    want, seen = {}, defaultdict(int)
    for i, k, v in sorted(rows, key=lambda r: (r[2], -r[0])):
        seen[k] += 1
        want[i] = seen[k]
    assert {r.id: r.n for r in out.collect()} == want


def test_null_bucket_rows_stay(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "a", 1), (4, None, None)], "id long, k string, v int")
    out = number_rows(df, ["k"], [F.col("v").asc_nulls_first(), F.col("id").asc()], "n", F.floor(F.col("v") / 2))
    assert sorted((r.id, r.n) for r in out.collect()) == [(1, 1), (2, 3), (3, 2), (4, 1)]


def test_running_sums_without_keys(spark):
    rows = hot_rows(500)
    df = spark.createDataFrame(rows, "id long, k string, v int")
    out = running_sums(df, [], [F.col("id").asc()], {"total": F.col("v"), "n": F.lit(1)})
    total, want = 0, {}
    for n, (i, _, v) in enumerate(sorted(rows), 1):
        total += v
        want[i] = (total, n)
    assert {r.id: (r.total, r.n) for r in out.collect()} == want


def test_numbering_is_spread(spark):
    """A single key is numbered by more than one task."""
    df = spark.range(20_000).withColumn("k", F.when(F.col("id") >= 0, "hot"))
    out = number_rows(df, ["k"], [F.col("id").asc()], "n", bucket=F.floor(F.col("id") / 1000))
    assert out.filter(F.col("n") != F.col("id") + 1).isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("floor", [50, 1_000_000])
def test_skew_join_equals_plain_join(spark, how, floor):
    left = spark.createDataFrame(hot_rows(), "id long, k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), (None, 5), ("zz", 6)], "k string, w int")
    got = skew_join(left, right, ["k"], how, ["id"], floor=floor)
    want = left.join(right, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(want.columns)
    key = lambda d: sorted(map(str, d.select(*names).collect()))
    assert key(got) == key(want)


def test_skew_join_refuses_other_types(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        skew_join(df, df, ["id"], "full")


def test_hot_keys_are_few_and_sliced(spark):
    counts = spark.createDataFrame([("hot", 700), ("warm", 200), ("cold", 100)], "k string, n long")
    got = {r.k: r["__slices"] for r in hot_keys(counts, ["k"], share=0.15, floor=10).collect()}
    assert got == {"hot": 5, "warm": 2}


def test_hot_rows_spread_over_slices(spark):
    left = spark.range(10_000).withColumn("k", F.lit(1))
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {conf: spark.conf.get(conf, None) for conf in off}
    for conf, value in off.items():
        spark.conf.set(conf, value)
    try:
        out = skew_join(left, right, ["k"], "inner", ["id"], share=0.01, floor=10)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 10_000 and len(sizes) > 1 and max(sizes) < 5_000
    finally:
        for conf, value in before.items():
            spark.conf.unset(conf) if value is None else spark.conf.set(conf, value)


def test_top_per_key_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "id long, k string, v int")
    out = top_per_key(df, ["k"], [F.col("v").desc(), F.col("id").asc()], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    groups = defaultdict(list)
    for i, k, v in hot_rows():
        groups[k].append((-v, i))
    want = sorted((str(k), r, i) for k, g in groups.items() for r, (_, i) in enumerate(sorted(g)[:3], 1))
    assert sorted((str(r.k), r["rank"], r.id) for r in out.collect()) == want


def test_with_previous_rows(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "n")
    blocks, block = with_previous_rows(df, [], "n", 3, block=10)
    rows = blocks.collect()
    assert sorted(r.n for r in rows if r["__own"]) == list(range(1, 101))
    for r in rows:
        if r["__own"]:
            mates = {x.n for x in rows if x[block] == r[block]}
            assert {r.n - i for i in range(4) if r.n - i >= 1} <= mates
