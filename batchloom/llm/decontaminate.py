"""Benchmark decontamination with an FM-index per training shard.

The phrases looked for are windows of ten words of the benchmark items. In every
task documents are gathered to shards; a shard's words become symbols, those that
no phrase has become separators, and stretches too short for any phrase fall
away, which loses no occurrence. Over the rest stands an FM-index: the
Burrows-Wheeler transform in a wavelet matrix. All phrases are searched backwards
at once, occurrences are located over sampled suffix positions, and the words
that they cover are merged to spans. Documents are not shuffled.

The phrases reach the tasks in blocks of bounded size, one pass for each block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from batchloom.llm.common import pieces
from batchloom.session import stage

WINDOW = 10
SHARD = 1 << 20  # symbols in an index, and words of a document taken at a time
PHRASE_BYTES = 8 << 20  # benchmark text that is sent to the tasks at once
ITEM_PIECE = 50_000  # words of a benchmark item that are kept together
_SAMPLE = 8
#: A-Z are lower-cased; all bytes but 0-9, a-z and those of non-ASCII characters part words
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Phrases:
    """Distinct windows of benchmark items as rows of symbols from 1 on, and the items that have each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                seen.setdefault(tuple(ids[at:at + window]), set()).add(item)
        self.vocabulary = vocabulary
        self.items = [sorted(x) for x in seen.values()]
        self.lengths = np.array([len(x) for x in seen], np.int64)
        self.symbols = np.zeros((len(seen), window), np.int64)
        for row, phrase in enumerate(seen):
            self.symbols[row, :len(phrase)] = phrase
        self.shortest = int(self.lengths.min(initial=window))


def _suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes by prefix doubling; every 0 counts as a symbol of its own, in text order."""
    n = len(symbols)
    zeros = symbols == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, symbols + int(zeros.sum()))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        key = rank[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if fresh[order[-1]] == n - 1:
            return order
        rank = fresh * (n + 1)
        rank[:-step] += fresh[step:] + 1
        step *= 2
        order = np.argsort(rank, kind="stable")


class ShardIndex:
    """An FM-index over symbols in which 0 separates; the last symbol is 0."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = _suffix_order(symbols)
        sampled = (np.arange(n) % _SAMPLE == 0) | np.concatenate([[True], symbols[:-1] == 0])
        self.position = np.where(sampled[order], order, -1)
        last = symbols[order - 1]
        top = int(symbols.max())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.levels, self.zeros, self.n = [], [], n
        row = last
        for bit in range(top.bit_length() - 1, -1, -1):
            ones = (row >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            self.zeros.append(n - int(self.levels[-1][-1]))
            row = np.concatenate([row[ones == 0], row[ones == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before ``upto``."""
        start, end = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (len(self.levels) - 1 - level)) & 1
            s1, e1 = ones[start], ones[end]
            start, end = np.where(bit, zeros + s1, start - s1), np.where(bit, zeros + e1, end - e1)
        return end - start

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(row), row
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[at + 1] - ones[at]
            at = np.where(bit, zeros + ones[at], at - ones[at])
            out = out * 2 + bit
        return out

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences, as phrase numbers and text positions."""
        alive = np.flatnonzero(phrases.symbols.max(axis=1, initial=0) < len(self.first) - 1)
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(phrases.symbols.shape[1]):
            ended = phrases.lengths[alive] == step
            done.append((alive[ended], low[ended], high[ended]))
            alive, low, high = alive[~ended], low[~ended], high[~ended]
            symbol = phrases.symbols[alive, phrases.lengths[alive] - 1 - step]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        done.append((alive, low, high))
        phrase, low, high = (np.concatenate(x) for x in zip(*done))
        counts = high - low
        row = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        return np.repeat(phrase, counts), self._locate(row)

    def _locate(self, row: np.ndarray) -> np.ndarray:
        out, steps, todo = np.empty(len(row), np.int64), 0, np.arange(len(row))
        while len(todo):
            at = self.position[row]
            there = at >= 0
            out[todo[there]] = at[there] + steps
            todo, row, steps = todo[~there], row[~there], steps + 1
            symbol = self.symbol(row)
            row = self.first[symbol] + self.rank(symbol, row)
        return out


class _Shard:
    """Words of several documents on their way into an index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.size, self.parts = phrases, 0, []

    def add(self, doc: int, start: int, ids: np.ndarray) -> None:
        """Words ``start`` on of document ``doc``: those stretches that can hold a phrase."""
        known = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.phrases.shortest
        for b, e in zip(begins[long].tolist(), ends[long].tolist()):
            self.parts.append((doc, start + b, ids[b:e]))
            self.size += e - b + 1

    def search(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per document with occurrences: its number, the words hit, the phrases."""
        if not self.parts:
            return
        lengths = np.array([len(p[2]) + 1 for p in self.parts])
        begins = np.cumsum(lengths) - lengths
        symbols = np.zeros(int(lengths.sum()), np.int64)
        for begin, (_, _, ids) in zip(begins, self.parts):
            symbols[begin:begin + len(ids)] = ids
        phrase, at = ShardIndex(symbols).search(self.phrases)
        if not len(at):
            return
        covered = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + self.phrases.lengths[phrase], -1)
        hit = np.flatnonzero(np.cumsum(covered) > 0)
        docs, firsts = np.array([p[0] for p in self.parts]), np.array([p[1] for p in self.parts])
        part = np.searchsorted(begins, hit, "right") - 1
        hit_doc, hit_word = docs[part], firsts[part] + hit - begins[part]
        found_doc = docs[np.searchsorted(begins, at, "right") - 1]
        order = np.argsort(found_doc, kind="stable")
        found_doc, phrase = found_doc[order], phrase[order]
        # both run by document, each in one stretch
        numbers = np.unique(hit_doc)
        words = np.split(hit_word, np.searchsorted(hit_doc, numbers[1:]))
        phrases = np.split(phrase, np.searchsorted(found_doc, numbers[1:]))
        for doc, own_words, own_phrases in zip(numbers.tolist(), words, phrases):
            yield doc, np.unique(own_words), np.unique(own_phrases)


def _spans(words: np.ndarray) -> list[dict]:
    cuts = np.flatnonzero(np.diff(words) > 1) + 1
    return [{"start": int(w[0]), "end": int(w[-1]) + 1} for w in np.split(words, cuts) if len(w)]


def _search(texts: list[str | None], phrases: Phrases, shard_size: int) -> tuple[list[int], dict, dict]:
    """Number of words, words hit and phrases found of each text."""
    shard, n_words, hits, found = _Shard(phrases), [], {}, {}

    def close() -> None:
        for doc, words, numbers in shard.search():
            hits[doc] = np.union1d(hits[doc], words) if doc in hits else words
            found.setdefault(doc, set()).update(numbers.tolist())

    overlap, number = phrases.symbols.shape[1] - 1, phrases.vocabulary.get
    for doc, text in enumerate(texts):
        at, tail = 0, np.zeros(0, np.int64)
        for piece in pieces((text or "").encode().translate(_WORDS)):
            words = piece.split()
            ids = np.concatenate([tail, np.fromiter((number(w, 0) for w in words), np.int64, len(words))])
            shard.add(doc, at - len(tail), ids)
            at, tail = at + len(words), ids[max(0, len(ids) - overlap):]
            if shard.size >= shard_size:
                close()
                shard = _Shard(phrases)
        n_words.append(at)
    close()
    return n_words, hits, found


def _phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """Phrases of the benchmark in blocks of about PHRASE_BYTES; long items are cut with an overlap."""
    narrow = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                parts = [b" ".join(words[at:at + ITEM_PIECE + window - 1]).decode()
                         for at in range(0, max(1, len(words) - window + 1) if words else 0, ITEM_PIECE)]
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(parts), pa.string()), "words": pa.array(parts, pa.string())})

    cut_items = stage(narrow.mapInArrow(cut, "item string, words string").distinct())
    total = cut_items.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    blocks = -(-total // PHRASE_BYTES)
    for block in range(blocks):
        rows = cut_items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).collect()
        yield Phrases([(r["item"], r["words"].encode().split()) for r in sorted(rows)], window)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW, shard_size: int = SHARD,
         made: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """The documents with n_words, spans and items of benchmark occurrences.

    spans are stretches [start, end) of word numbers from 0 that occurrences of
    windows cover, merged; items are the ids, as text and sorted, of the items
    with an occurring window. A null text has no words and no spans; an item
    without words has no windows, an item without id is called "null"; repeated
    items count once. The three columns, named in ``made``, replace others of
    these names.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = docs.drop(*made).select(
        "*", F.lit(0).cast("long").alias(made[0]), F.lit(None).cast(span).alias(made[1]),
        F.lit(None).cast("array<string>").alias(made[2]))
    text_at, kinds, names, first = out.columns.index(text_col), out.schema, out.columns, True
    sc = docs.sparkSession.sparkContext
    blocks = _phrase_blocks(benchmark, item_col, item_text, window)
    for phrases in chain([next(blocks, Phrases([], window))], blocks):
        sent = sc.broadcast(pickle.dumps(phrases))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            looked_for = pickle.loads(sent.value)
            for batch in batches:
                texts = batch.column(text_at).to_pylist()
                n_words, hits, found = _search(texts, looked_for, shard_size)
                spans, items = (batch.column(len(names) - k).to_pylist() for k in (2, 1))
                for doc, words in hits.items():
                    before = [np.arange(s["start"], s["end"]) for s in spans[doc] or []]
                    spans[doc] = _spans(np.unique(np.concatenate([words, *before])))
                    own = {x for number in found[doc] for x in looked_for.items[number]}
                    items[doc] = sorted(own.union(items[doc] or []))
                columns = [pa.array(n_words, pa.int64()), pa.array(spans, batch.schema.field(len(names) - 2).type),
                           pa.array(items, batch.schema.field(len(names) - 1).type)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], names)

        out = (out if first else stage(out)).mapInArrow(run, kinds)
        first = False
    return out.withColumns({made[1]: F.coalesce(made[1], F.array().cast(span)), made[2]: F.coalesce(made[2], F.array().cast("array<string>"))})


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, words hit, items with occurrences, their digest, and the verdict."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, as they were."""
    found = scan(docs, benchmark, text_col, made=("__n_words", "__spans", "__items"))
    return found.filter(F.size("__spans") == 0).select(*docs.columns)


def excised(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents, with the words of every span and what stands between them cut out of the text."""
    found = scan(docs, benchmark, text_col)
    at, spans_at = found.columns.index(text_col), found.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_spans(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist())]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return found.mapInArrow(run, found.schema)


def cut_spans(text: str, spans: list[dict]) -> str:
    """``text`` without the given stretches of words; what is left keeps its spelling."""
    data = text.encode()
    plain = data.translate(_WORDS)
    word = np.frombuffer(b" " + plain + b" ", np.uint8) != 32
    edges = np.flatnonzero(word[1:] != word[:-1])
    begins, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for span in spans:
        out.append(data[at:begins[span["start"]]])
        at = ends[span["end"] - 1]
    return b"".join([*out, data[at:]]).decode()
