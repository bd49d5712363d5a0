"""SimHash near-duplicates over deletion variants of fingerprint segments.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ
in at most four bits, one of the three segments differs in at most one (two in
each would make six). So each fingerprint is filed 64 times: under the bits of a
segment with one of its positions left out. Fingerprints that share such a
variant meet by equality and are verified by their full distance. Equal texts
meet only once, because distinct fingerprints are filed rather than documents.

Crowded variants are cut into blocks and every two blocks meet in a task of
their own, so no task holds more than two blocks. Of each meeting only a
spanning forest of the verified links leaves the task: enough for the groups,
and never more rows than members.

Four bits miss most texts that share four fifths of their words in a row. Where a
``similarity`` is asked for, texts are filed under bands of a MinHash of five-word
shingles as well, and links of both kinds make the groups. The texts of a band meet
one pivot first, which joins what is alike in a row a text; bands that still hold
several groups are compared by their shingle sets inside tasks, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from batchloom.llm.common import pieces, settled, stored
from batchloom.session import stage

BITS = 64
SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: fits three segments: with more bits no segment is sure to differ in one at most
DISTANCE = 4
SHINGLE = 4
SEED = 42
BLOCK = 4096
#: a pair at similarity 0.8 shares one of the bands with probability 1 - (1 - 0.8**5)**24 = 0.99993
BANDS, BAND_ROWS = 24, 5
WORDS = 5
_SMALL = 12
CELL = 512  # texts of a band whose sets are held together
_SET_VALUES = 1 << 19
_SHINGLES_AT_ONCE = 1 << 16
_HASHES_AT_ONCE = 1 << 10
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND_ROWS, 1), np.uint32)
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 without words.

    Words are split at ASCII white space after A-Z are lower-cased. A text with
    fewer words than a shingle has one shingle, all its words.
    """
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in _hashed(text, shingle, seed):
        _add(counts, hashes)
        n += len(hashes)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _hashed(text: str | None, shingle: int, seed: int) -> Iterator[list[int]]:
    """The hashes of the shingles, some at a time."""
    some, tail = False, []
    data = (text or "").encode().translate(_PLAIN)
    for piece in pieces(data):
        words = tail + piece.split()
        got = len(words) - shingle + 1
        for at in range(0, got, _SHINGLES_AT_ONCE):
            part = words[at:min(at + _SHINGLES_AT_ONCE, got) + shingle - 1]
            grams = zip(*(part[k:] for k in range(shingle)))
            yield [xxh64_intdigest(b" ".join(g), seed) for g in grams]
            some = True
        tail = words[max(0, got):]
    if not some and tail:
        yield [xxh64_intdigest(b" ".join(tail), seed)]


def band_keys(text: str | None, shingle: int = WORDS, seed: int = SEED) -> list[int]:
    """The bands of the MinHash of a text, as signed 64-bit numbers; none without words."""
    least = None
    for hashes in _hashed(text, shingle, seed):
        high = (np.array(hashes, np.uint64) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), _HASHES_AT_ONCE):
            part = (((high[at:at + _HASHES_AT_ONCE] ^ _TURNS[0]) * (_TURNS[1] | np.uint32(1)))).min(axis=1)
            least = part if least is None else np.minimum(least, part)
    if least is None:
        return []
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def _add(counts: np.ndarray, hashes: list[int]) -> None:
    ones = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts += ones.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: bool = False) -> DataFrame:
    """Per document: doc_id, text_hash (which with the id tells rows apart) and fp, and on demand its bands.

    A null text has no words. Repeated rows stay repeated.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
            columns = {"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": fps}
            if bands:
                columns["bands"] = pa.array([band_keys(t.as_py()) for t in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long" + (", bands array<long>" if bands else ""))


def _variants(fps: DataFrame) -> DataFrame:
    """Each fingerprint with its 64 variants: position left out, and the rest of that segment."""
    made = []
    for low, high in SEGMENTS:
        mask = (1 << (high - low)) - 1
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask).cast("long"))
        for at in range(high - low):
            tag = ((low + at) << 22)
            made.append(segment.bitwiseAND(F.lit(mask & ~(1 << at)).cast("long")).bitwiseOR(F.lit(tag).cast("long")))
    return fps.select("fp", F.explode(F.array(*made)).alias("variant"))


def _forest(values: np.ndarray, distance: int) -> tuple[list, list]:
    """Links between ``values`` that connect whatever is connected, one fewer than members at most."""
    left, a, b = np.unique(values), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found)
    return a, b


def links_of_runs(starts: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside runs of fingerprints; ``starts`` holds each run's start and the end of the last."""
    sizes = np.diff(starts)
    run, a, b = np.repeat(np.arange(len(sizes)), sizes), [], []
    small = sizes[run] <= _SMALL
    for k in range(1, min(_SMALL, int(sizes.max(initial=0)))):
        hit = (run[k:] == run[:-k]) & small[k:]
        at = np.flatnonzero(hit)
        at = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= distance]
        a.append(fps[at])
        b.append(fps[at + k])
    for r in np.flatnonzero(sizes > _SMALL):
        more = _forest(fps[starts[r]:starts[r + 1]], distance)
        a += more[0]
        b += more[1]
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell (variant, a, b) come in; links leave. The last cell of a batch waits for the next one."""
    kept = np.zeros((4, 0), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [rows.shape[1]]])
        a, b = links_of_runs(starts, rows[3].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([kept, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        same = np.all(rows[:3] == rows[:3, -1:], axis=0)
        first = rows.shape[1] if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        first = 0 if same.all() else first
        if first:
            yield links(np.ascontiguousarray(rows[:, :first]))
        kept = rows[:, first:].copy()
    if kept.shape[1] > 1:
        yield links(np.ascontiguousarray(kept))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp), enough to connect all within DISTANCE bits."""
    filed = _variants(fps)
    crowded = filed.groupBy("variant").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(
        "variant", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(
        F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    cells = filed.join(crowded, "variant", "left").select(
        "variant", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)).alias("cell"), "fp",
    ).select("variant", "cell.a", "cell.b", "fp")
    met = cells.repartition("variant", "a", "b").sortWithinPartitions("variant", "a", "b").mapInArrow(_meet, "u long, v long")
    return met.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges u, v (u <> v): per node the smallest node reached.

    Large-star and small-star steps in turn until nothing changes. Each step is
    two joins on aggregated minima; no neighbour list is ever held in one place.
    Raises if ``rounds`` are not enough (they grow with the logarithm of the nodes).
    """
    def signature(df: DataFrame):
        got = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(got)

    now = stage(edges.select("u", "v").filter("u <> v"))
    seen = signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = stage(small)
        last, seen = seen, signature(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _shingle_sets(keys: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """text_hash, held (the hashes of its shingles, rising, each once) of the texts in ``keys``; stored once."""
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(
        keys.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, keys, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.unique(np.concatenate([np.array(h, np.uint64) for h in _hashed(text.as_py(), WORDS, SEED)])).view(np.int64))
                keys.append(key)
                size += len(held[-1])
                if size > _SET_VALUES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["text_hash", "held"])
                    held, keys, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["text_hash", "held"])

    return stored(texts.mapInArrow(run, "text_hash long, held array<long>"), "shingles")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two rising arrays without repeats have this Jaccard similarity or more."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) < similarity * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return common >= (len(x) + len(y) - common) * similarity


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1, initial=-1 << 63)), pa.array(pairs.min(axis=1, initial=(1 << 63) - 1))], ["u", "v"])


def _with_pivots(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links u, v of the pairs (a pivot's text a and fingerprint u, another text b and fingerprint v) that are alike.

    A pivot's partners are dealt over tasks some thousand at a time. Its set comes
    first and is held, theirs go by one after the other, and only links leave.
    """
    parts = pairs.groupBy("a").agg(F.first("u").alias("u"), F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    others = pairs.join(parts.select("a", "parts"), "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("other"), F.col("v").alias("fp"), F.col("b").alias("text_hash"))
    pivots = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("other"), F.col("u").alias("fp"),
                          F.col("a").alias("text_hash"))
    rows = others.unionByName(pivots).join(sets, "text_hash").select("a", "part", "other", "fp", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, None
        for batch in batches:
            found = []
            for other, fp, values in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                values = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if not other:
                    pivot, held = fp, values.copy()
                elif alike(held, values, similarity):
                    found.append((pivot, fp))
            if found:
                yield _link_batch(found)

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "other").mapInArrow(run, "u long, v long").distinct()


def signature(held: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingle hashes, as ``band_keys`` has them."""
    high, least = (held >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(high), _HASHES_AT_ONCE):
        part = (((high[at:at + _HASHES_AT_ONCE] ^ _TURNS[0]) * (_TURNS[1] | np.uint32(1)))).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def links_in_cell(roots: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different groups, enough to join all groups that a link joins.

    The values two signatures share tell first whether a pair can be alike (four
    standard deviations below ``similarity``); sets decide. The texts of the largest
    group are compared with all others only.
    """
    labels, found = np.unique(roots, return_inverse=True)[1], []
    signs = np.stack([signature(s) for s in sets])
    least = similarity - 4 * (similarity * (1 - similarity) / signs.shape[1]) ** 0.5
    # the largest group first: its texts need not meet each other
    order = np.argsort(labels != np.bincount(labels).argmax(), kind="stable")
    first = int((labels == np.bincount(labels).argmax()).sum())
    for at in range(first, len(order)):
        x, before = order[at], order[:at]
        others = before[labels[before] != labels[x]]
        shared = (signs[others] == signs[x]).mean(axis=1)
        likely = shared >= least
        for y in others[likely][np.argsort(-shared[likely], kind="stable")]:
            if labels[y] != labels[x] and alike(sets[x], sets[y], similarity):
                found.append((int(fps[x]), int(fps[y])))
                labels[labels == labels[y]] = labels[x]
    return found


def _in_cells(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between texts that share a band and are in different groups; rows have band, text_hash, fp, root and n.

    A band is dealt in blocks, every two blocks to a cell, so a task holds the sets
    of two blocks. No pair leaves a cell but links.
    """
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("text_hash"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))
    dealt = rows.select("band", F.explode(cells).alias("cell"), "fp", "root", "text_hash").join(sets, "text_hash").select(
        "band", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "fp", "root", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, []
        for batch in batches:
            found = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for key, fp, root, values in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                if key != now:
                    found += _of_cell(cell, similarity)
                    now, cell = key, []
                cell.append((root, fp, values.values.to_numpy(zero_copy_only=False).view(np.uint64).copy()))
            if found:
                yield _link_batch(found)
        found = _of_cell(cell, similarity)
        if found:
            yield _link_batch(found)

    return dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(run, "u long, v long").distinct()


def _of_cell(cell: list[tuple], similarity: float) -> list[tuple[int, int]]:
    if len({c[0] for c in cell}) < 2:
        return []
    return links_in_cell(np.array([c[0] for c in cell]), np.array([c[1] for c in cell]), [c[2] for c in cell], similarity)


def similar_links(prints: DataFrame, near: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """The links ``near`` and those of texts that share a band and are verified by their sets.

    First every text of a band that is in another group meets one pivot of the band:
    the text that shares its bands with most others, which in a group of copies is
    the one they were made from. That is a row a text and band. Bands that still hold
    several groups are compared in cells, inside tasks. Pairs never become rows.
    """
    filed = prints.select("text_hash", "fp", F.explode("bands").alias("band")).distinct()
    filed = filed.join(filed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "band")
    filed = stored(filed, "bands")
    crowd = filed.groupBy("text_hash").agg(F.sum("n").alias("crowd"))
    known, sets = near, None
    for first in (True, False):
        known = stored(known, "links")
        groups = components(known)
        placed = filed.join(groups, filed["fp"] == groups["node"], "left").select("band", "n", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))
        if first:
            chosen = F.max(F.struct("crowd", "text_hash", "fp", "root")).alias("one")
            shared = placed.join(crowd, "text_hash").groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), chosen)
            pairs = placed.join(shared.filter("least < most").select("band", "one"), "band").filter(F.col("root") != F.col("one.root"))
            pairs = stored(pairs.select(F.col("one.text_hash").alias("a"), F.col("one.fp").alias("u"), F.col("text_hash").alias("b"), F.col("fp").alias("v")).distinct(), "pivots")
            sets = _shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("text_hash")), docs, text_col)
            known = known.unionByName(_with_pivots(pairs, sets, similarity))
        else:
            several = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
            rows = stored(placed.join(several.select("band"), "band", "left_semi"), "cells")
            known = known.unionByName(_in_cells(rows, _shingle_sets(rows, docs, text_col), similarity))
    return stored(known, "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Per document: doc_id, text_hash, fp, root (the group), component_id.

    With ``similarity``, texts whose sets of five-word shingles have this Jaccard
    similarity or more are linked as well (bands are made for 0.8 and above).

    component_id is the smallest doc_id of the group; rows without a doc_id take
    part and count as larger than any other. Documents without words share
    fingerprint zero and are linked like any others. Repeated rows are kept.
    """
    prints = stored(fingerprints(docs, id_col, text_col, similarity is not None), "prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    near = links(distinct.select("fp"))
    groups = components(near if similarity is None else similar_links(prints, near, docs, text_col, similarity))
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.select("fp", "root").join(smallest, "root")
    return prints.join(labels, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The documents, with one of each near-duplicate group left.

    It is the one with the smallest doc_id, then the smallest hash of its text;
    a row without doc_id stays only where its group has no other. Of rows
    repeated as they are, one stays. Columns and texts are as they were.
    """
    def chosen() -> DataFrame:
        rows = near_duplicates(docs, id_col, text_col, similarity).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("k"))
        return first.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"), F.col("k.n").alias("__n"))

    # narrow tables of measured size: the texts meet them once
    keys = settled(docs.sparkSession, "chosen", chosen)
    repeated = stored(keys.filter("__n > 1"), "repeated")
    named = docs.withColumns({"__row_id": F.col(id_col), "__row_hash": F.xxhash64(text_col)})

    def those(table: DataFrame) -> DataFrame:
        return named.join(table, named["__row_id"].eqNullSafe(table["__id"]) & (named["__row_hash"] == table["__hash"]), "left_semi")

    once = those(repeated).dropDuplicates(["__row_id", "__row_hash"])
    return those(keys.filter("__n = 1")).unionByName(once).select(*docs.columns)
