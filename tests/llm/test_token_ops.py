"""Alignment of tokenizers, packing and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from batchloom.llm import alignment, conversations, packing, token_ids, tokens
from batchloom.llm import queries as llm_queries
from test_llm import documents, empty_docs, odd_docs


@pytest.fixture(scope="module")
def byte_level():
    return token_ids.read_byte_level(llm_queries.vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def piece_level():
    return token_ids.read_pieces(llm_queries.vocabulary_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# ids

ODD_TEXTS = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y", "it's  \n\n we'll\t", "日本語 テキスト", "😀 é ﬁ   x", "\x00\x1c a", "1234 5 6789", "  lead", "trail  "]


def test_ids_equal_the_library(byte_level, library):
    encoder = byte_level.encoder()
    rng = random.Random(4)
    pool = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x180), 0x4E00, 0x1F600, 0x0301, 0x2003, 10, 9)]
    texts = ODD_TEXTS + ["".join(rng.choices(pool + [" "] * 60, k=60)) for _ in range(300)]
    for text in texts:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_stretches(monkeypatch, byte_level, piece_level, library):
    text = " ".join(random.Random(1).choices(["the", "of,", "It's", "  ", "été", "\n", "a.b", "<|endoftext|>", "12"], k=800))
    parts = list(token_ids.stretches(text, 50))
    assert "".join(parts) == text and len(parts) > 5
    whole = piece_level.encoder().codec.encode(text)
    monkeypatch.setattr(token_ids, "STRETCH", 50)
    monkeypatch.setattr(token_ids, "stretches", lambda t: parts if t == text else [t])
    assert byte_level.encoder().ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert piece_level.encoder().ids(text).tolist() == whole


# alignment

def brute_alignments(docs):
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    letter = tokens.letters()
    rows, held, counts = [], [], Counter()
    for doc_id, text in docs:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(letter[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (bytes_a, bytes_b)):
            rows.append((doc_id, 0, 0, 0, ""))
            held.append([])
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        groups = []
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(tuple([i for i, e in zip(ids, ends) if (last if groups else 0) < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))))
            last = end
        held.append([(x, y) for g in groups for x in g[0] for y in g[1]])
        counts.update(set(held[-1]))
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(written.encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return Counter((*r[:4], len(h), sum(counts[p] == most[p[0]] for p in h), sum(counts[p] for p in h), r[4]) for r, h in zip(rows, held))


@pytest.mark.parametrize("small", [False, True])
def test_alignment_brute_force(spark, monkeypatch, byte_level, piece_level, small):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()[:60]]
    docs = [(i, t if t is None or len(t) < 4000 else t[:4000]) for i, t in docs] + [(1000 + k, t) for k, t in enumerate(ODD_TEXTS + ["a▁b", "na" * 300, "x" * 90])]
    docs += [(None, "of the of"), (None, None), docs[0], docs[0]]
    if small:  # many batches, nothing remembered for long
        monkeypatch.setattr(alignment, "BATCH_PAIRS", 300)
        monkeypatch.setattr(alignment, "_SENT", 70)
        monkeypatch.setattr(alignment, "REMEMBERED", 20)
        monkeypatch.setattr(alignment, "_LARGE", 3)
        monkeypatch.setattr(alignment, "_TOGETHER", 3000)
    found = alignment.alignments(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), byte_level, piece_level)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.columns == names
    assert Counter(tuple(r) for r in found.collect()) == brute_alignments(docs)


def test_alignment_odd(spark, byte_level, piece_level):
    rows = alignment.alignments(odd_docs(spark).withColumn("batch", F.lit("x")), byte_level, piece_level).collect()
    assert len(rows) == 11 and sum(r["groups_sha256"] == "" and r["n_a"] == r["n_links"] == r["count_sum"] == 0 for r in rows) == 4
    assert alignment.alignments(empty_docs(spark), byte_level, piece_level).count() == 0


# packing

def least_bins(lengths, capacity):
    """The fewest bins by dynamic programming over subsets."""
    best = {0: (0, 0)}  # items packed -> bins closed, fill of the open one
    for done in range(1, 1 << len(lengths)):
        best[done] = min((b, f + x) if f and f + x <= capacity else (b + 1, x) for k, x in enumerate(lengths) if done >> k & 1
                         for b, f in [best[done ^ (1 << k)]])
    return best[(1 << len(lengths)) - 1][0]


def test_islands_find_few_bins():
    rng = random.Random(7)
    over = 0
    for k in range(40):
        lengths = np.array(sorted((rng.randint(10, 70) for _ in range(11)), reverse=True))
        island = packing.Island(lengths, 100, (1, k))
        island.settle()
        first = island.members[0][0]
        island.evolve(60)
        bins, _, packed = island.members[0]
        assert bins <= first and np.bincount(packed, lengths).max() <= 100 and np.bincount(packed).min() > 0
        over += bins - least_bins(lengths.tolist(), 100)
    assert over == 0


def test_crossover_improves_on_best_fit():
    # triples that fill a bin exactly: best fit by falling length misses many of them
    rng = np.random.default_rng(3)
    cuts = np.sort(rng.integers(20, 60, (60, 2)), axis=1)
    one, two = cuts[:, 0], 100 - cuts[:, 1]
    lengths = np.sort(np.concatenate([one, two, 100 - one - two]))[::-1].copy()
    island = packing.Island(lengths[lengths > 0], 100, (5, 5))
    island.settle()
    first = island.members[0][:2]
    island.evolve(400)
    assert island.members[0][:2] < first


def check_packing(rows, docs, library, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        for k, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[start:first if k == 0 else start + capacity]
            want[doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    return len(by_sequence), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("region", [40, packing.REGION])
def test_packing(spark, byte_level, library, region):
    docs = documents(spark)
    rows = packing.packed_documents(docs, byte_level, region=region).collect()
    used, bound = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], library, 2048)
    assert used <= bound + (1 if region > 40 else 3)


def test_packing_odd(spark, byte_level, library):
    odd = odd_docs(spark).withColumnsRenamed({"lang": "number", "source": "region"})
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows = packing.packed_documents(odd, byte_level, capacity=64, region=3).collect()
    check_packing(rows, docs, library, 64)
    assert packing.packed_documents(empty_docs(spark), byte_level).count() == 0
    same = spark.createDataFrame([(1, "one two")] * 500, "doc_id long, text string")
    assert len({r["sequence_id"] for r in packing.packed_documents(same, byte_level, capacity=9, region=60).collect()}) == 167


def test_sequences(spark, byte_level, library):
    packed = packing.pack(packing.pieces(documents(spark).limit(50), byte_level, 300, keep_ids=True), 300, region=20)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


# conversations

def brute_edits(faults, initials):
    """Every way with up to four inserts."""
    best = [(10**9, "")]

    def go(at, made, cost, text, inserts):
        if cost > best[0][0]:
            return
        if at == len(faults) and re.fullmatch("(s?(ua)+)?", made):
            best[0] = min(best[0], (cost, text))
        if inserts < 4:
            for c in "ua":
                go(at, made + c, cost + 5, text + "I", inserts + 1)
        if at < len(faults):
            go(at + 1, made, cost + 2, text + "D", inserts)
            if faults[at] not in (conversations.BLANK, conversations.DUPLICATE):
                more = 5 * (faults[at] == conversations.TRUNCATED)
                go(at + 1, made + (initials[at] or "#"), cost + more, text + "K", inserts)
                for c in "ua":
                    go(at + 1, made + c, cost + more + 1, text + "R", inserts)

    go(0, "", 0, "", 0)
    return best[0]


def test_edits_brute_force():
    rng = random.Random(11)
    for _ in range(600):
        n = rng.randint(0, 5)
        faults, initials = rng.choices([1, 2, 3, 3, 4, 4, 4], k=n), rng.choices(["s", "u", "u", "a", "a", "t", "", "S"], k=n)
        assert conversations.edits(faults, initials) == brute_edits(faults, initials)


def test_edits_of_long_conversations():
    # what a short one needs in the middle, a long one needs as often
    cost, text = conversations.edits([4] * 6000, list("uau") * 2000)
    assert len(text) >= 6000 and set(text) <= set("DIKR")
    assert conversations.edits([4] * 20_000, ["u", "a"] * 10_000) == (0, "K" * 20_000)


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 5, "user", "And"),
    (2, None, "user", "First."), (2, 0, None, None), (2, 3, "tool", "Third!"), (2, 3, "assistant", "Fourth  \n"), (None, 1, "user", "No id."), (None, 0, "", "x"),
    (3, 1, "assistant", "Alone."), (4, 2, "user", " \t"), (5, 0, "user", "Gone."), (6, 0, "user", "é" * 5000 + "."), (6, 1, "agent", "Ok."),
]


def brute_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv and r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text, _ in own:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 4)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit = conversations.edits(faults, initials)
        made, at = [], 0
        for edit in audit:
            wanted = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if edit == "I":
                made.append((wanted, ""))
                continue
            if edit != "D":
                made.append((own[at][2] if edit == "K" else wanted, own[at][3]))
            at += 1
        numbers = {r[1] for r in own if r[1] is not None}
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in (1, 2, 3)),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, made)
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0][:1] for m in made))
    return out


def test_repair(spark):
    rows = [(*(r[:2]), r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ", r[0] != 5) for r in ROWS]
    df = spark.createDataFrame([(*r, r[0] != 5, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, there boolean, place string, fault int")
    made = conversations.repair(df, present=F.col("there")).cache()
    want = brute_repair(rows)
    reports = {r["conv_id"]: tuple(r)[1:] for r in conversations.reports(made).collect()}
    assert reports == {k: v[:-1] for k, v in want.items()}
    for conv, v in want.items():
        kept = conversations.turns(made).filter(F.col("conv_id").eqNullSafe(conv)).orderBy("place").collect()
        assert [(r["role"], r["text"]) for r in kept] == v[-1] and [r["place"] for r in kept] == list(range(len(kept)))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in conversations.with_digests(conversations.repair(df, present=F.col("there"))).collect()}
    assert digests == {k: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in v[-1]).encode()).hexdigest() for k, v in want.items()}


def test_repair_hot_and_empty(spark):
    rng = random.Random(2)
    rows = [(None if k % 3 else k, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "two", "", "Three!", f"n{k}."]), True) for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, there boolean")
    want = brute_repair(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in conversations.reports(conversations.repair(df)).collect()} == {k: v[:-1] for k, v in want.items()}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(none).count() == 0 and conversations.with_digests(conversations.repair(conversations.damaged(none))).count() == 0


def test_damage(spark):
    rows = [(k, t, "assistant", f"A. b! c? {k}") for k in range(40) for t in range(3)] + [(None, None, None, None)]
    got = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = Counter()
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = text or " "
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        want[conv, turn, "user" if hit == 4 else role or " ", text, hit != 0] += 2 if hit == 3 else 1
    assert Counter(tuple(r) for r in got) == want
