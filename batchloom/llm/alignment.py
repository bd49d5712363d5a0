"""Links between the tokens of two tokenizers by anchors at white space.

Both tokenisations of a text are laid over its bytes. A byte offset where tokens of
both end is a shared end; tokens between two shared ends are a group, and every two
tokens of a group are linked. Shared ends in front of tokens of both sides that begin
with a space are anchors. They split a document into windows, and a window's groups
depend on nothing but its ids, so each task remembers them by the ids of the window.

Counts of id pairs are numbers of documents. A task gives its pairs numbers of its
own, a batch at a time, so that the corpus-wide counts come from one row a pair and
batch, and go back to documents as one row a pair and batch. A document carries the
numbers of its pairs and how often it holds them. Nothing that grows with the corpus
is broadcast, and pairs that every document has meet as one row a batch.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from batchloom.llm.common import stored
from batchloom.llm.token_ids import ByteLevel, ByteLevelEncoder, PieceEncoder, Pieces

REMEMBERED = 256  # bytes of the ids of a window that is remembered; longer ones hardly come twice
_LARGE = 1024  # links of a group that are counted before they are listed
BATCH_PAIRS, BATCH_WINDOWS, BATCH_LINKS = 200_000, 400_000, 4_000_000
_SENT = 20_000  # pairs in one row of a batch
_TOGETHER = 1 << 18  # bytes of texts that are laid out at once, one more long one aside


@dataclass
class Aligned:
    """A document's tokens, groups and links; ``pairs`` are numbers in the batch."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    digest: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The offsets, rising, that are in both rising lists."""
    at = np.searchsorted(ends_b, ends_a)
    at[at == len(ends_b)] = 0
    return ends_a[ends_b[at] == ends_a]


class Aligner:
    """Aligns texts, and numbers the pairs of ids of the batch at hand.

    Of each window that the batch has had stand the text of its groups and how many
    they are, and in two flat arrays, from ``start`` on, the numbers of its pairs and
    how often it has each.
    """

    def __init__(self, a: ByteLevelEncoder, b: PieceEncoder):
        self.a, self.b = a, b
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in x.token_bytes]) for x in (a, b))
        self.space_a, self.space_b = (np.array([t.startswith(b" ") for t in x.token_bytes]) for x in (a, b))
        self.clear()

    def clear(self) -> None:
        """Begins a new batch."""
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups, self.start, self.pair, self.times = array("q"), array("q", [0]), array("q"), array("q")
        self.numbers: dict[int, int] = {}
        self.documents = np.zeros(1 << 12, np.int64)

    @property
    def full(self) -> bool:
        return len(self.numbers) >= BATCH_PAIRS or len(self.texts) >= BATCH_WINDOWS or len(self.pair) >= BATCH_LINKS

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ids of the batch's pairs, in the order of their numbers, and in how many of its documents each is."""
        keys = np.fromiter(self.numbers, np.int64, len(self.numbers))
        return keys >> 32, keys & 0xFFFFFFFF, self.documents[:len(keys)]

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """Texts that are null or empty, or that a side does not give back, have no tokens."""
        out, kept, side_a, side_b = [Aligned()] * len(texts), [], [], []
        for place, text in enumerate(texts):
            if text:
                a, b = self.a.ids(" " + text), self.b.ids(text)
                if all(b"".join(map(side.token_bytes.__getitem__, ids.tolist())) == (" " + text).encode() for side, ids in ((self.b, b), (self.a, a))):
                    kept.append(place)
                    side_a.append(a)
                    side_b.append(b)
        if not kept:
            return out
        # one text behind the other: every text begins with a space on both sides, so it begins a window
        a, b, sizes = np.concatenate(side_a), np.concatenate(side_b), np.array([len(x) for x in side_a])
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        shared = shared_ends(ends_a, ends_b)
        # a group ends before these tokens, and a window where both of them begin with a space
        next_a, next_b = np.searchsorted(ends_a, shared, "right"), np.searchsorted(ends_b, shared, "right")
        last = np.flatnonzero(np.append(self.space_a[a[next_a[:-1]]] & self.space_b[b[next_b[:-1]]], True))
        seen = self._windows(a, b, last, next_a, next_b)
        window_ends = np.searchsorted(next_a[last], np.cumsum(sizes)) + 1
        group_ends = np.searchsorted(next_a, np.cumsum(sizes)) + 1
        doc = np.repeat(np.arange(len(kept)), np.diff(window_ends, prepend=0))
        # the different windows of each text, then its different pairs
        kinds, often = np.unique(doc * len(self.texts) + seen, return_counts=True)
        doc, kinds = kinds // len(self.texts), kinds % len(self.texts)
        start = np.frombuffer(self.start, np.int64)
        held = start[kinds + 1] - start[kinds]
        at = _ranges(start[kinds], held)
        keys, back = np.unique(np.repeat(doc, held) * len(self.numbers) + np.frombuffer(self.pair, np.int64)[at], return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, back, np.frombuffer(self.times, np.int64)[at] * np.repeat(often, held))
        doc, pairs = keys // len(self.numbers), (keys % len(self.numbers)).astype(np.int32)
        if len(self.numbers) > len(self.documents):
            self.documents = np.append(self.documents, np.zeros(len(self.numbers), np.int64))
        np.add.at(self.documents, pairs, 1)
        cuts, named = np.searchsorted(doc, np.arange(len(kept) + 1)).tolist(), seen.tolist()
        begin = 0
        for k, (place, end) in enumerate(zip(kept, window_ends.tolist())):
            digest = hashlib.sha256(";".join(map(self.texts.__getitem__, named[begin:end])).encode()).hexdigest()
            groups = int(group_ends[k] - (group_ends[k - 1] if k else 0))
            part = slice(cuts[k], cuts[k + 1])
            out[place] = Aligned(len(side_a[k]), len(side_b[k]), groups, digest, pairs[part], times[part])
            begin = end
        return out

    def _windows(self, a: np.ndarray, b: np.ndarray, last: np.ndarray, next_a: np.ndarray, next_b: np.ndarray) -> np.ndarray:
        """The number of each window, which ends with the group ``last``; new ones are filed."""
        size_a, size_b = np.diff(next_a[last], prepend=0), np.diff(next_b[last], prepend=0)
        # both id tuples of a window stand together; those of the right side are marked
        both = np.zeros(len(a) + len(b), "<u4")
        both[np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = a
        both[np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)] = b | np.uint32(1 << 31)
        ids, ends = both.tobytes(), (4 * np.cumsum(size_a + size_b)).tolist()
        keys = [ids[i:j] for i, j in zip([0, *ends], ends)]
        known, number, fresh = self.known, len(self.texts), []
        seen = list(map(known.get, keys))
        for k in [k for k, at in enumerate(seen) if at is None]:
            at = known.get(keys[k])
            if at is None:
                at = number + len(fresh)
                fresh.append(k)
                if len(keys[k]) <= REMEMBERED:
                    known[keys[k]] = at
            seen[k] = at
        if fresh:
            self._remember(np.array(fresh), last, next_a, next_b, a, b)
        return np.array(seen)

    def _remember(self, fresh: np.ndarray, last: np.ndarray, next_a: np.ndarray, next_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Files new windows (their places among a document's windows), each with the text and the pairs of its groups."""
        first = np.append(0, last[:-1] + 1)[fresh]
        size = last[fresh] + 1 - first
        group = _ranges(first, size)
        from_a, from_b = np.append(0, next_a[:-1])[group], np.append(0, next_b[:-1])[group]
        n_a, n_b = next_a[group] - from_a, next_b[group] - from_b
        ids_a, ids_b = a[_ranges(from_a, n_a)].tolist(), b[_ranges(from_b, n_b)].tolist()
        texts, at, to = [], 0, 0
        for n, m in zip(n_a.tolist(), n_b.tolist()):
            if n == 1 == m:
                texts.append(f"{ids_a[at]}|{ids_b[to]}")
            else:
                texts.append(f"{','.join(map(str, ids_a[at:at + n]))}|{','.join(map(str, ids_b[to:to + m]))}")
            at, to = at + n, to + m
        begin = (np.cumsum(size) - size).tolist()
        self.texts += [";".join(texts[k:k + n]) for k, n in zip(begin, size.tolist())]
        self.groups.extend(size.tolist())
        links = n_a * n_b
        large = links > _LARGE
        # a large group as its different pairs with their number, all others link by link
        plain = np.where(large, 0, links)
        inside = _ranges(np.zeros(len(plain), np.int64), plain)
        width = np.repeat(n_b, plain)
        left = a[np.repeat(from_a, plain) + inside // width].astype(np.int64)
        right = b[np.repeat(from_b, plain) + inside % width].astype(np.int64)
        keys, times, owner = left << 32 | right, np.ones(len(left), np.int64), np.repeat(np.repeat(np.arange(len(size)), size), plain)
        for k in np.flatnonzero(large).tolist():
            x, n = np.unique(a[from_a[k]:from_a[k] + n_a[k]], return_counts=True)
            y, m = np.unique(b[from_b[k]:from_b[k] + n_b[k]], return_counts=True)
            keys = np.append(keys, (x.astype(np.int64)[:, None] << 32 | y.astype(np.int64)).ravel())
            times = np.append(times, np.outer(n, m).ravel())
            owner = np.append(owner, np.full(len(x) * len(y), np.searchsorted(begin, k, "right") - 1))
        if large.any():
            order = np.argsort(owner, kind="stable")
            keys, times, owner = keys[order], times[order], owner[order]
        different, back = np.unique(keys, return_inverse=True)
        numbers = self.numbers
        named = np.array([numbers.setdefault(key, len(numbers)) for key in different.tolist()], np.int64)
        self.start.frombytes((len(self.pair) + np.cumsum(np.bincount(owner, minlength=len(size)))).astype(np.int64).tobytes())
        self.pair.frombytes(named[back].tobytes())
        self.times.frombytes(times.tobytes())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


_DOCUMENT = "n_a long, n_b long, n_groups long, groups_sha256 string, batch long, pairs array<int>, times array<long>"
_PAIRS = "ids_a array<int>, ids_b array<int>, documents array<long>, first int"


def aligned(docs: DataFrame, a: ByteLevel, b: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, groups_sha256, batch, pairs (numbers in the batch) and times; and the batches' pairs.

    Rows of batches have ids_a, ids_b, documents and ``first``, the number of their
    first pair; those of documents have none. Special strings are plain text. Texts
    that are null or empty, or that the tokens of a side do not give back, have no tokens.
    Repeated rows are documents of their own.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((a, b))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_DOCUMENT}, {_PAIRS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sent.value
        aligner = Aligner(left.encoder(plain=True), right.encoder())
        number, id_kind = TaskContext.get().partitionId() << 32, None
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        names = [c.split()[0] for c in schema.split(", ")]

        def rows(ids, of_docs: list[Aligned], of_pairs: list[tuple]) -> pa.RecordBatch:
            none = [None] * len(of_docs or of_pairs)
            columns = [ids if ids is not None else pa.array(none, id_kind)]
            columns += [pa.array([getattr(d, n) for d in of_docs] or none, pa.int64()) for n in ("n_a", "n_b", "n_groups")]
            columns += [pa.array([d.digest for d in of_docs] or none, pa.string()), pa.array([number] * len(none), pa.int64())]
            columns += [pa.array([d.pairs for d in of_docs] or none, ints), pa.array([d.times for d in of_docs] or none, longs)]
            columns += [pa.array([p[k] for p in of_pairs] or none, t) for k, t in enumerate((ints, ints, longs, pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names)

        def pairs_of_batch() -> Iterator[pa.RecordBatch]:
            x, y, n = aligner.pairs()
            for at in range(0, len(x), _SENT):
                part = slice(at, at + _SENT)
                yield rows(None, [], [(x[part].astype(np.int32), y[part].astype(np.int32), n[part], at)])

        for batch in batches:
            id_kind, texts, start, size = batch.schema.field(0).type, batch.column(1), 0, 0
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for at, length in enumerate(lengths):
                size += length
                if size < _TOGETHER and at + 1 < len(lengths):
                    continue
                yield rows(batch.column(0).slice(start, at + 1 - start), aligner.align(texts.slice(start, at + 1 - start).to_pylist()), [])
                start, size = at + 1, 0
                if aligner.full:
                    yield from pairs_of_batch()
                    aligner.clear()
                    number += 1
        yield from pairs_of_batch()

    return narrow.mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """id_a, id_b, count (documents that hold the pair linked), best (no pair of id_a has more)."""
    each = found.filter("first is not null").select(F.explode(F.arrays_zip("ids_a", "ids_b", "documents")).alias("x"))
    counts = each.groupBy(F.col("x.ids_a").alias("id_a"), F.col("x.ids_b").alias("id_b")).agg(F.sum("x.documents").alias("count"))
    most = counts.groupBy("id_a").agg(F.max("count").alias("most"))
    return counts.join(most, "id_a").select("id_a", "id_b", "count", (F.col("count") == F.col("most")).alias("best"))


def _summed(dealt: DataFrame, kind: str) -> DataFrame:
    """Documents with n_links, n_best, count_sum; rows of a batch come with its counts in front of its documents."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, best = None, None, None
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            taken, sums = [], []
            for at, (number, is_doc) in enumerate(zip(column["batch"].to_pylist(), column["is_doc"].to_pylist())):
                if number != now:
                    now, counts, best = number, np.zeros(0, np.int64), np.zeros(0, np.int64)
                if not is_doc:
                    where, n, top = (column[c][at].values.to_numpy(zero_copy_only=False) for c in ("pairs", "counts", "tops"))
                    need = int(where.max(initial=-1)) + 1 - len(counts)
                    if need > 0:
                        counts, best = (np.append(x, np.zeros(need + len(x) // 2, np.int64)) for x in (counts, best))
                    counts[where], best[where] = n, top
                    continue
                pairs, times = (column[c][at].values.to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
                taken.append(at)
                sums.append((int(times.sum()), int(times @ best[pairs]), int(times @ counts[pairs])))
            if taken:
                rows = batch.take(pa.array(taken, pa.int32()))
                made = {n: pa.array([s[k] for s in sums], pa.int64()) for k, n in enumerate(("n_links", "n_best", "count_sum"))}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else rows.column(rows.schema.names.index(n)) for n in names], names)

    return dealt.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def with_counts(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document of ``aligned``: its links, those whose count is the highest of their left id, and the sum of the counts."""
    kind = found.schema["doc_id"].dataType.simpleString()
    each = found.filter("first is not null").select("batch", "first", F.posexplode(F.arrays_zip("ids_a", "ids_b")).alias("at", "x"))
    numbered = each.select("batch", (F.col("first") + F.col("at")).alias("pair"), F.col("x.ids_a").alias("id_a"), F.col("x.ids_b").alias("id_b"))
    back = numbered.join(counts, ["id_a", "id_b"]).select("batch", "pair", "count", F.col("best").cast("long").alias("top"))
    # a batch's counts in rows of some thousand
    parts = back.groupBy("batch", F.expr(f"pair div {_SENT}").alias("part")).agg(F.collect_list(F.struct("pair", "count", "top")).alias("x"))
    none = F.lit(None)
    first = parts.select("batch", F.lit(False).alias("is_doc"), F.col("x.pair").alias("pairs"), F.col("x.count").alias("counts"), F.col("x.top").alias("tops"),
                         none.cast("array<long>").alias("times"), none.cast(kind).alias("doc_id"),
                         *[none.cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")], none.cast("string").alias("groups_sha256"))
    then = found.filter("first is null").select("batch", F.lit(True).alias("is_doc"), "pairs", none.cast("array<long>").alias("counts"),
                                                none.cast("array<long>").alias("tops"), "times", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    dealt = first.unionByName(then).repartition("batch").sortWithinPartitions("batch", "is_doc")
    return _summed(dealt, kind)


def alignments(docs: DataFrame, a: ByteLevel, b: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Documents without tokens (see ``aligned``) have zeros and an empty text. Repeated
    rows count as documents of their own; other columns of ``docs`` are not looked at;
    an empty table gives an empty one.
    """
    found = stored(aligned(docs, a, b, id_col, text_col), "alignment")
    return with_counts(found, stored(pair_counts(found), "pair-counts"))
