"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging in numpy.

Texts are cut into pre-tokens by the vocabulary's pattern. Those of a batch that
the task has not met before become ragged arrays of symbols: one flat array with
the start of each sequence. In every round each sequence looks up the ranks of its
neighbouring pairs, finds its lowest, and merges all places of that pair at once;
sequences without a pair leave. What remains of a sequence is its token count.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

LIMIT = 1024
#: the pattern of byte-level vocabularies (a fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 1 << 20  # pre-tokens whose counts a task remembers
_CACHED_CHARS = 64
_FLAT = 1 << 22  # bytes of pre-tokens that are merged together, one more long one aside
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Vocabulary:
    """Merges as sorted pair keys with rank and result; symbols of the 256 bytes; special strings."""

    bytes_to_symbols: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    special: tuple[str, ...]


def letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(extra)] = b
            extra += 1
    return out


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file; read on the driver, whatever its path."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids = spec["model"]["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    keys = np.array([_key(ids[a], ids[b]) for a, b in merges], np.int64)
    results = np.array([ids[a + b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    symbols = np.zeros(256, np.int64)
    for letter, byte in letters().items():
        symbols[byte] = ids[letter]
    special = tuple(t["content"] for t in spec.get("added_tokens", ()))
    return Vocabulary(symbols, keys[order], order.astype(np.int64), results[order], special)


def _key(a: int, b: int) -> int:
    return (a << 32) | b


def _ranks(left: np.ndarray, right: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    key = (left << 32) | right
    at = np.searchsorted(vocabulary.pairs, key)
    at[at == len(vocabulary.pairs)] = 0
    return np.where(vocabulary.pairs[at] == key, vocabulary.ranks[at], _NONE)


def merged_lengths(sequences: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """The number of symbols left of each sequence, none of them empty, after all merges."""
    out = np.zeros(len(sequences), np.int64)
    lengths = np.array([len(s) for s in sequences], np.int64)
    flat = vocabulary.bytes_to_symbols[np.frombuffer(b"".join(sequences), np.uint8)]
    number = np.arange(len(sequences))
    by_rank = np.empty(len(vocabulary.ranks), np.int64)
    by_rank[vocabulary.ranks] = vocabulary.results
    # the rank of the pair that begins at each symbol; the last symbol of a sequence begins none
    last = np.zeros(len(flat), bool)
    last[np.cumsum(lengths) - 1] = True
    rank = np.full(len(flat), _NONE)
    inner = np.flatnonzero(~last)
    rank[inner] = _ranks(flat[inner], flat[inner + 1], vocabulary)
    while len(number):
        lowest = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
        done = lowest == _NONE
        out[number[done]] = lengths[done]
        hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank != _NONE))
        if not len(hit):
            break
        # equal neighbours (a run of one letter) overlap: every second place counts
        run = np.cumsum(np.concatenate([[0], np.diff(hit) != 1]))
        first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        hit = hit[(np.arange(len(hit)) - first[run]) % 2 == 0]
        flat[hit] = by_rank[rank[hit]]
        last[hit] = last[hit + 1]
        stay = np.repeat(~done, lengths)
        stay[hit + 1] = False
        lengths = lengths - np.bincount(np.searchsorted(np.cumsum(lengths), hit, "right"), minlength=len(lengths))
        flat, rank, last = flat[stay], rank[stay], last[stay]
        lengths, number = lengths[~done], number[~done]
        merged = (np.cumsum(stay) - 1)[hit]
        changed = np.concatenate([merged, merged[merged > 0] - 1])
        rank[changed] = _NONE
        changed = changed[~last[changed]]
        rank[changed] = _ranks(flat[changed], flat[changed + 1], vocabulary)
    return out


class TokenCounter:
    """Counts tokens of texts and remembers short pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def _parts(self, text: str) -> tuple[int, Counter]:
        """Special strings, and how often each pre-token stands between them."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return 0, Counter(self.cut(text))
        between = self.special.split(text)
        counts: Counter = Counter()
        for part in between:
            counts.update(self.cut(part))
        return len(between) - 1, counts

    def count(self, texts: list[str | None]) -> list[int]:
        parts = [self._parts(t or "") for t in texts]
        fresh = {w for _, words in parts for w in words if w not in self.known}
        lengths, waiting, size = {}, [], 0
        for word in fresh:
            waiting.append(word)
            size += len(word)
            if size >= _FLAT:
                lengths.update(self._merge(waiting))
                waiting, size = [], 0
        lengths.update(self._merge(waiting))
        known = self.known
        out = [n + sum((known.get(w) or lengths[w]) * k for w, k in words.items()) for n, words in parts]
        if len(known) + len(lengths) > _CACHE:
            known.clear()
        known.update((w, n) for w, n in lengths.items() if len(w) <= _CACHED_CHARS)
        return out

    def _merge(self, words: list[str]) -> dict[str, int]:
        return dict(zip(words, merged_lengths([w.encode() for w in words], self.vocabulary).tolist())) if words else {}


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts are counted, null as empty. Special strings inside a text are one
    token each, nothing is added before or after it. The vocabulary goes to the
    tasks as a broadcast whose size is that of the vocabulary file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                         F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(pickle.loads(sent.value))
        for batch in batches:
            n = pa.array(counter.count(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
