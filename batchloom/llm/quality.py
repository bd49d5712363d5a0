"""Quality classifier that compresses: which of two dictionaries fits a text better?

A zstandard dictionary is built from good and one from bad labelled texts. A text
is cut into blocks, every block is compressed with either, and the difference of
the sizes over the text's bytes is the measure. A logistic curve fitted on other
labelled rows turns it into a probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from batchloom.llm.common import kept_where

#: bounds of the sample that the classifier is fitted on: rows of each label, and bytes of a row
FIT_ROWS = 3000
FIT_BYTES = 1 << 16
DICTIONARY = 112_640
BLOCK = 2048
LEVEL = 3
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows that no classifier learns from; rows without an id are not held out."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _cut(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[at:at + BLOCK] for at in range(0, len(data), BLOCK)]


@dataclass(frozen=True)
class Classifier:
    """Two dictionaries and the curve score = 1 / (1 + exp(-(slope * measure + shift)))."""

    good: bytes
    bad: bytes
    slope: float
    shift: float

    def measure(self) -> callable:
        """A function from a text to its normalised difference; an empty text has 0."""
        if not self.good or not self.bad:
            return lambda text: 0.0
        coders = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = coders

        def difference(text: str | None) -> float:
            blocks = _cut(text)
            return sum(len(bad(b)) - len(good(b)) for b in blocks) / max(1, sum(map(len, blocks)))

        return difference

    def scorer(self) -> callable:
        measure = self.measure()
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.slope * measure(text) + self.shift, -30, 30))))


def _dictionary(texts: list[str]) -> bytes:
    blocks = [b[at:at + 400] for t in texts for b in _cut(t) for at in range(0, len(b), 400)]
    blocks = [blocks[i] for i in np.random.default_rng(1).permutation(len(blocks))]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes() if len(blocks) >= 10 else b""
    except zstandard.ZstdError:  # too little text for a dictionary
        return b""


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression by Newton steps, with a small penalty that keeps it finite."""
    spread = float(np.std(x)) or 1.0
    design = np.stack([x / spread, np.ones_like(x)], axis=1)
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * weights
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / spread), float(weights[1])


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[list, dict]:
    """Up to ``fit_rows`` rows (text, quality) of each label, chosen by a hash of the id, and how many labels there are of each.

    Rows held out, without a label of 0 or 1, with labels that contradict each
    other, or with more than FIT_BYTES of text are left out.
    """
    judged = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("__id")).agg(F.min("quality").alias("__low"), F.max("quality").alias("__quality")).filter("__low = __quality")
    short = docs.filter(F.octet_length(text_col) <= FIT_BYTES).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # the ids first, so that texts are read only for the rows chosen; at most two times fit_rows of them
    there = judged.join(short.select("__id").distinct(), "__id", "left_semi")
    chosen = None
    for label in (0, 1):
        part = there.filter(F.col("__quality") == label).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows).select("__id", "__quality")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = short.join(F.broadcast(chosen), "__id").groupBy("__id", "__quality").agg(F.min("__text").alias("__text")).collect()
    counts = {r["__quality"]: r["count"] for r in judged.groupBy("__quality").count().collect()}
    return [(r["__text"], r["__quality"]) for r in sorted(rows, key=lambda r: str(r["__id"]))], counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Classifier:
    """Half of the sample makes the dictionaries, half the curve.

    Without rows of both labels every text scores 0.5; with too few for a
    dictionary, the share of good rows.
    """
    rows, counts = sample(docs, labels, id_col, text_col, fit_rows)
    by_label = {q: [t for t, own in rows if own == q] for q in (0, 1)}
    if not by_label[0] or not by_label[1]:
        return Classifier(b"", b"", 0.0, 0.0)
    made = Classifier(_dictionary(by_label[1][::2]), _dictionary(by_label[0][::2]), 0.0, 0.0)
    measure = made.measure()
    rest = [(measure(t), q) for q in (0, 1) for t in by_label[q][1::2] or by_label[q]]
    x, y = np.array([x for x, _ in rest]), np.array([float(q) for _, q in rest])
    slope, shift = _curve(x, y)
    # the sample may hold the labels in other shares than the labels do; the curve is for the latter
    shift += np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum())
    return Classifier(made.good, made.bad, slope, float(shift))


def scored(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Whole texts are read; null counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = pickle.loads(sent.value).scorer()
        for batch in batches:
            values = pa.array([score(t) for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "held_out", "score"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_only(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The documents that score 0.5 or more, as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def keep():
        score = pickle.loads(sent.value).scorer()
        return lambda texts: [score(t) >= 0.5 for t in texts]

    return kept_where(docs, text_col, keep)
