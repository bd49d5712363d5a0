"""Sharding rounds and compression scores against plain Python, one group and one text at a time."""

import math
import random
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from batchloom.llm import quality, sharding
from batchloom.llm import queries as llm_queries
from batchloom.llm.common import table
from test_llm import SF


def plain_propagation(cells, quotas, rounds, tie, step):
    """The rounds of ``propagate``, by dictionaries; the hashes are given."""
    now = Counter(cells)
    for seed in range(rounds):
        groups = defaultdict(list)
        for (grp, shard), n in now.items():
            groups[grp].append((n, tie[grp, shard, seed], shard))
        wishes, held = [], Counter()
        for (_, shard), n in now.items():
            held[shard] += n
        for grp, own in groups.items():
            there, _, target = max(own)
            for n, _, shard in own:
                if shard != target:
                    wishes.append((target, -int(math.log2(there)), step[grp, seed], grp, shard, n))
                    held[shard] -= n
        moves = Counter()
        for target, quota in quotas.items():
            room, before = max(0, quota - held[target]), 0
            asked = Counter()
            for wish in wishes:
                if wish[0] == target:
                    asked[wish[1:3]] += wish[5]
            for key in sorted(asked):
                if before < room:
                    share = min(1.0, (room - before) / asked[key])
                    for t, pull, s, grp, shard, n in wishes:
                        if (t, pull, s) == (target, *key) and math.floor(n * share):
                            moves[grp, shard, target] += math.floor(n * share)
                before += asked[key]
        if not moves:
            break
        for (grp, shard, target), n in moves.items():
            now[grp, shard] -= n
            now[grp, target] += n
        now = Counter({k: n for k, n in now.items() if n > 0})
    return dict(now)


@pytest.mark.parametrize("seed", range(3))
def test_propagation_equals_plain_rounds(spark, seed):
    rng, shards, rounds = random.Random(seed), 5, 3
    cells = Counter()
    for g in range(25):
        for _ in range(rng.choice([2, 3, 9, 40])):
            cells[f"g{g}", rng.randrange(shards)] += 1
    quotas = {s: rng.randrange(20, 90) for s in range(shards)}
    names = sorted({g for g, _ in cells})
    hashed = spark.createDataFrame([(g, s, k) for g in names for s in range(shards) for k in range(rounds)], "grp string, shard int, seed int").select(
        "*", F.xxhash64("grp", "shard", "seed").alias("tie"), F.pmod(F.xxhash64("grp", "seed"), F.lit(1024)).alias("step")).collect()
    tie, step = {(r["grp"], r["shard"], r["seed"]): r["tie"] for r in hashed}, {(r["grp"], r["seed"]): r["step"] for r in hashed}
    got = sharding.propagate(spark.createDataFrame([(g, s, n) for (g, s), n in cells.items()], "grp string, shard int, n long"),
                             spark.createDataFrame(list(quotas.items()), "shard int, quota long"), rounds)
    want = plain_propagation(cells, quotas, rounds, tie, step)
    assert {(r["grp"], r["shard"]): r["n"] for r in got.collect()} == want and want != dict(cells)
    assert sum(want.values()) == sum(cells.values())


def test_scores_recomputed_text_by_text(spark):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in llm_queries.QUERIES["op10_quality"](spark, SF).collect()}
    assert model.good and model.bad and len(set(got.values())) > 50

    def packed(data, raw):
        # a new coder for each block, as nothing is carried from block to block
        coder = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False,
                                         write_checksum=False, write_dict_id=False)
        return len(coder.compress(data))

    for doc_id, text in texts.items():
        data, total = (text or "").encode(), 0
        for at in range(0, len(data), quality.BLOCK):
            total += packed(data[at:at + quality.BLOCK], model.bad) - packed(data[at:at + quality.BLOCK], model.good)
        x = model.slope * total / max(1, len(data)) + model.shift
        assert abs(got[doc_id] - 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))) < 1e-9
