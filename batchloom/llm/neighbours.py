"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is scaled to length one and rotated by a random orthogonal matrix; of
the result only the signs are kept, packed to bits, with two scalars: the
vector's length and how well the signs fit it. From these the inner product with
a rotated query is estimated, with a bound for the error. In each block of vectors
the best estimates are computed exactly first; then all vectors whose upper bound
reaches the worst of the best so far. Scores are inner products of the original
vectors in double precision, summed from the first component on.

All rows are compared with the stated queries, in blocks: queries travel in
broadcasts of bounded size, rows stay where they are, and tasks keep k rows a query.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from batchloom.session import staging_dir

SEED = 11
#: standard deviations of the estimate's error that the bound allows for
SURE = 3.0
#: bytes of queries that are sent to the tasks at once
QUERY_BYTES = 8 << 20
_ROWS = 4096
_QUERIES = 256


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part.

    Left out are rows without id and vectors that are null, empty, all zero, hold
    a null or non-finite component, or have another dimension than most.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    top = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.filter(F.size("vec") == (top["dim"] if top else 0))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of the unit vectors with their signs' unit vectors."""
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    length = np.linalg.norm(vectors / scale, axis=1) * scale[:, 0]
    turned = (vectors / length[:, None]) @ turn.T
    fit = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, fit


def index(rows: DataFrame, dim: int) -> DataFrame:
    """``rows`` with code, length and fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            code, length, fit = encode(_matrix(batch.column(1), dim), turn)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()),
                pa.array(length), pa.array(fit)], ["vec_id", "vec", "code", "length", "fit"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, vec array<double>, code binary, length double, fit double")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def exact(columns: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of a query with vectors that stand in columns, summed from the first component on."""
    out = np.zeros(columns.shape[1])
    for row, q in zip(columns, query):
        out += row * q
    return out


class _Best:
    """The k best rows of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def least(self, q: int) -> float:
        scores = self.rows[q][1]
        return float(scores[-1]) if len(scores) == self.k else -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = ids != self.ids[q]
        ids, scores = np.concatenate([self.rows[q][0], ids[own]]), np.concatenate([self.rows[q][1], scores[own]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.rows[q] = ids[order], scores[order]


def search_block(ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, length: np.ndarray, fit: np.ndarray,
                 queries: np.ndarray, turned: np.ndarray, best: _Best) -> int:
    """Compare a block of rows with all queries; gives the number of exact inner products."""
    dim, done = vectors.shape[1], 0
    signs = np.where(np.unpackbits(code, axis=1, count=dim), np.float32(1), np.float32(-1))
    gain = (length / (fit * np.sqrt(dim))).astype(np.float32)
    # a hair for the rounding of the estimate in single precision
    slack = (length * (SURE * np.sqrt(np.maximum(1 - fit ** 2, 0)) / fit / np.sqrt(max(dim - 1, 1)) + 1e-5)).astype(np.float32)
    columns = np.ascontiguousarray(vectors.T)
    for start in range(0, len(queries), _QUERIES):
        estimate = (turned[start:start + _QUERIES] @ signs.T) * gain
        lengths = np.linalg.norm(queries[start:start + _QUERIES], axis=1)
        first = min(best.k + 1, len(ids))
        near = np.argpartition(-estimate, first - 1, axis=1)[:, :first]
        for i in range(len(estimate)):
            q = start + i
            chosen = np.zeros(len(ids), bool)
            if best.least(q) == -np.inf:
                chosen[near[i]] = True
                best.add(q, ids[near[i]], exact(columns[:, near[i]], queries[q]))
                done += len(near[i])
            more = np.flatnonzero((estimate[i] + slack >= best.least(q) / lengths[i]) & ~chosen)
            if len(more):
                scores = exact(columns[:, more], queries[q])
                done += len(more)
                reach = scores >= best.least(q)
                best.add(q, ids[more[reach]], scores[reach])
    return done


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (vec_id divisible by ``every``) its ``k`` nearest rows: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Rows with the query's own id are no candidates;
    other rows that repeat an id count each. Of rows with the same query id the
    smallest vector is the query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    head = rows.select(F.size("vec")).first()
    folder = f"{staging_dir(spark)}/codes-{uuid.uuid4().hex}"
    dim = head[0] if head else 1
    index(rows, dim).write.parquet(folder)
    coded = spark.read.parquet(folder)
    asked = coded.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    count = asked.count()
    blocks = -(-count * dim * 8 // QUERY_BYTES)
    found = None
    for block in range(blocks):
        part = _search(coded, asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block), dim, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(coded: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    got = sorted(asked.collect())
    ids, queries = np.array([r["vec_id"] for r in got], np.int64), np.array([r["vec"] for r in got], np.float64).reshape(-1, dim)
    sent = coded.sparkSession.sparkContext.broadcast(pickle.dumps((ids, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = pickle.loads(sent.value)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        turned, best = (unit @ rotation(dim).T).astype(np.float32), _Best(query_ids, k)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                own, vec, code, length, fit = batch.slice(at, _ROWS).columns
                packed = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(own), -1)
                search_block(own.to_numpy(), _matrix(vec, dim), packed, length.to_numpy(), fit.to_numpy(), vectors, turned, best)
        for start in range(0, len(query_ids), _QUERIES):
            rows = best.rows[start:start + _QUERIES]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(query_ids[start:start + _QUERIES], [len(r[0]) for r in rows])),
                pa.array(np.concatenate([r[0] for r in rows])), pa.array(np.concatenate([r[1] for r in rows]))],
                ["query_id", "vec_id", "score"])

    return coded.select(F.col("vec_id").cast("long"), "vec", "code", "length", "fit").mapInArrow(run, "query_id long, vec_id long, score double")
