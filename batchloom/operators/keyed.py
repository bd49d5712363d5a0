"""Tables with one row per key that are brought up to date in place, bucket by bucket.

Rows lie in folders by bucket. A bucket is one whole folder and the changes since,
and a manifest per version says which folders those are. An upsert reads the buckets
that its keys fall into, writes the rows that really change, and puts a new manifest;
nothing that is there is written over, so a write that breaks off leaves the table as
it was, and readers of an older version go on. A bucket whose changes outweigh it is
folded into a new whole, alone. The manifest has a line per bucket and change, so its
size is bounded by the number of buckets, which the layout fixes.

Every change keeps what the row was before in some columns. Those changes are a log
from which counters are carried on by differences (``changes``).

One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from batchloom import files

BUCKET, VERSION, FORMER = "bucket", "__version", "__former"
#: a bucket is folded when its changes have this share of its rows, and so many rows, or when they are so many folders
FOLD_SHARE, FOLD_ROWS, MOST_CHANGES = 0.5, 100_000, 64


@dataclass(frozen=True)
class Layout:
    """How a table is laid out.

    ``bucket`` is an SQL expression over the key columns; it should have some
    thousand values at most, and no value should hold a large share of the rows.
    Where two rows have one key, the one with greater ``wins`` stays, and of equals
    the later one. Of ``watch`` columns every change keeps the former values.
    """

    keys: Sequence[str]
    bucket: str
    wins: Sequence[str] = ()
    watch: Sequence[str] = ()


@dataclass
class Manifest:
    """A version: per bucket the whole folder (or none), its rows, and the changes (folder, version, rows).

    ``log`` has the folder of each version's changes, for all versions after ``since``.
    """

    version: int
    layout: Layout
    schema: T.StructType
    buckets: dict[str, dict]
    log: list[list]
    since: int = 0

    def text(self) -> str:
        return json.dumps({"version": self.version, "layout": asdict(self.layout), "schema": self.schema.jsonValue(), "buckets": self.buckets,
                           "log": self.log, "since": self.since})


def _name(version: int) -> str:
    return f"{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifests are there, oldest first; none where there is no table."""
    return [int(n[:-5]) for n in files.names(spark, f"{path}/manifest") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest version, or the one asked for."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {'' if version is None else version} of a keyed table at {path}")
    raw = json.loads(files.read_text(spark, f"{path}/manifest/{_name(known[-1] if version is None else version)}"))
    return Manifest(raw["version"], Layout(**raw["layout"]), T.StructType.fromJson(raw["schema"]), raw["buckets"], raw["log"], raw["since"])


def put(rows: DataFrame, path: str, folder: str) -> None:
    """Write ``rows``, which have their bucket; the rebalance writes few files into a small bucket and splits a big one."""
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows/folder={folder}")


def _with_bucket(rows: DataFrame, layout: Layout) -> DataFrame:
    return rows.withColumn(BUCKET, F.coalesce(F.expr(layout.bucket).cast("string"), F.lit("none")))


def _part(spark: SparkSession, path: str, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    laid = T.StructType([*schema.fields, T.StructField("folder", T.StringType()), T.StructField(BUCKET, T.StringType())])
    return spark.read.schema(laid).option("basePath", f"{path}/rows").parquet(*paths).select(*schema.names)


def _changed_schema(m: Manifest) -> T.StructType:
    former = T.StructType([m.schema[c] for c in m.layout.watch] or [T.StructField("none", T.BooleanType())])
    return T.StructType([*m.schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(FORMER, former)])


def _key(layout: Layout) -> Column:
    # in a struct, nulls are equal to each other
    return F.struct(*layout.keys)


def _rows(spark: SparkSession, path: str, m: Manifest, buckets: Sequence[str] | None = None) -> DataFrame:
    chosen = {b: v for b, v in m.buckets.items() if buckets is None or b in set(buckets)}

    def at(folder: str, bucket: str) -> str:
        return f"{path}/rows/folder={folder}/{BUCKET}={bucket}"

    still = [at(v["whole"], b) for b, v in chosen.items() if v["whole"] and not v["changes"]]
    under = [at(v["whole"], b) for b, v in chosen.items() if v["whole"] and v["changes"]]
    over = [at(folder, b) for b, v in chosen.items() for folder, _, _ in v["changes"]]
    out = _part(spark, path, still, m.schema)
    if not over:
        return out
    newer = _part(spark, path, over, T.StructType([f for f in _changed_schema(m).fields if f.name != FORMER]))
    rest = [c for c in m.schema.names if c not in m.layout.keys]
    if any(len(v["changes"]) > 1 for v in chosen.values()):
        newer = newer.groupBy(*m.layout.keys).agg(F.max_by(F.struct(*rest), VERSION).alias("r")).select(*m.layout.keys, "r.*")
    newer = newer.select(*m.schema.names)
    kept = _part(spark, path, under, m.schema).withColumn("__key", _key(m.layout)).join(
        newer.select(_key(m.layout).alias("__key")), "__key", "left_anti").drop("__key")
    return out.unionByName(kept).unionByName(newer)


def _counts(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """Rows per bucket of a folder that was written; as many lines as buckets."""
    typed = T.StructType([T.StructField(BUCKET, T.StringType())])
    found = spark.read.schema(typed).parquet(f"{path}/rows/folder={folder}").groupBy(BUCKET).count().collect()
    return {r[BUCKET]: r["count"] for r in found}


def create(rows: DataFrame, path: str, layout: Layout, put: Callable = put) -> int:
    """A new table; of rows with one key the one with the greatest ``wins`` is taken. Raises where there is one already."""
    spark = rows.sparkSession
    if versions(spark, path):
        raise FileExistsError(path)
    folder = f"whole-{uuid.uuid4().hex}"
    put(_with_bucket(_one_per_key(rows, layout, ()), layout), path, folder)
    buckets = {b: {"whole": folder, "rows": n, "changes": []} for b, n in _counts(spark, path, folder).items()}
    made = Manifest(0, layout, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]), buckets, [])
    files.put_text(spark, f"{path}/manifest/{_name(0)}", made.text())
    return 0


def read(spark: SparkSession, path: str, buckets: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
    """The table, or some of its buckets, as it is or was; other buckets' folders are not looked at."""
    return _rows(spark, path, manifest(spark, path, version), buckets)


def buckets_of(rows: DataFrame, layout: Layout) -> list[str]:
    """The buckets that keys fall into; as many as there are buckets at most."""
    return [r[0] for r in _with_bucket(rows, layout).select(BUCKET).distinct().collect()]


def _one_per_key(rows: DataFrame, layout: Layout, first: Sequence[Column]) -> DataFrame:
    """Of rows with one key those with the greatest wins, of these the smallest by ``first``, else the greatest."""
    rest = [c for c in rows.columns if c not in layout.keys]
    if not rest:
        return rows.distinct()
    if first:
        wins = F.struct(*layout.wins) if layout.wins else F.lit(0)
        rows_of = rows.withColumn("__wins", wins).groupBy(*layout.keys, "__wins").agg(F.min_by(F.struct(*rest), F.struct(*first)).alias("__r"))
        best = rows_of.groupBy(*layout.keys).agg(F.max_by("__r", "__wins").alias("__r"))
    else:
        best = rows.groupBy(*layout.keys).agg(F.max_by(F.struct(*rest), F.struct(*layout.wins, *[c for c in rest if c not in layout.wins])).alias("__r"))
    return best.select(*layout.keys, "__r.*").select(*rows.columns)


def upsert(
    path: str, fresh: DataFrame, first: Sequence[Column] = (), fold_rows: int = FOLD_ROWS, most_changes: int = MOST_CHANGES, put: Callable = put,
) -> int:
    """Put rows in or in the place of those with their keys, and give the version that has them.

    Of fresh rows with one key and equal ``wins``, the smallest by ``first`` counts.
    A row that would lose to the one that is there, or equals it, changes nothing;
    where nothing changes there is no new version. ``fresh`` is read twice then.
    Where the layout has neither ``wins`` nor ``watch``, nothing that is there need be
    read: all fresh rows are written as they are.
    """
    spark = fresh.sparkSession
    m = manifest(spark, path)
    layout, names = m.layout, m.schema.names
    now = _with_bucket(_one_per_key(fresh.select(*[F.col(f.name).cast(f.dataType) for f in m.schema.fields]), layout, first), layout)
    number = F.lit(m.version + 1).cast("long").alias(VERSION)
    if not layout.wins and not layout.watch:
        changed = now.select(*names, number, F.lit(None).cast(_changed_schema(m)[FORMER].dataType).alias(FORMER), BUCKET)
    else:
        changed = _differing(now, _rows(spark, path, m, [r[0] for r in now.select(BUCKET).distinct().collect()]), layout, names, number)
    folder = f"change-{uuid.uuid4().hex}"
    put(changed, path, folder)
    counts = _counts(spark, path, folder)
    if not counts:
        files.remove(spark, f"{path}/rows/folder={folder}")
        return m.version
    for b, n in counts.items():
        line = m.buckets.setdefault(b, {"whole": None, "rows": 0, "changes": []})
        line["changes"].append([folder, m.version + 1, n])
    m.version += 1
    m.log.append([m.version, folder])
    files.put_text(spark, f"{path}/manifest/{_name(m.version)}", m.text())
    heavy = [b for b in counts if len(v := m.buckets[b]["changes"]) > most_changes
             or sum(n for _, _, n in v) > max(FOLD_SHARE * m.buckets[b]["rows"], fold_rows)]
    if heavy:
        _fold(spark, path, m, heavy, put)
    return m.version


def _differing(now: DataFrame, there: DataFrame, layout: Layout, names: Sequence[str], number: Column) -> DataFrame:
    """The rows of ``now`` that replace a row of ``there`` or are new, with what was there."""
    rest = [c for c in names if c not in layout.keys]
    old = there.select(_key(layout).alias("__key"), F.struct(*names).alias("__there"))
    met = now.withColumn("__key", _key(layout)).join(old, "__key", "left")
    missing = F.col("__there").isNull()
    beats = F.struct(*layout.wins) >= F.struct(*[F.col(f"__there.{c}") for c in layout.wins]) if layout.wins else F.lit(True)
    same = F.struct(*rest).eqNullSafe(F.struct(*[F.col(f"__there.{c}") for c in rest])) if rest else F.lit(True)
    former = F.struct(*[F.col(f"__there.{c}").alias(c) for c in layout.watch] or [F.lit(True).alias("none")])
    return met.filter(missing | (F.coalesce(beats, F.lit(True)) & ~same)).select(*names, number, F.when(~missing, former).alias(FORMER), BUCKET)


def _fold(spark: SparkSession, path: str, m: Manifest, buckets: Sequence[str], put: Callable) -> None:
    """New wholes of some buckets, as a version of their own; their changes stay in the log."""
    folder = f"whole-{uuid.uuid4().hex}"
    put(_with_bucket(_rows(spark, path, m, buckets), m.layout), path, folder)
    for b, n in _counts(spark, path, folder).items():
        m.buckets[b] = {"whole": folder, "rows": n, "changes": []}
    m.version += 1
    files.put_text(spark, f"{path}/manifest/{_name(m.version)}", m.text())


def changes(spark: SparkSession, path: str, after: int) -> DataFrame:
    """The rows that changed in versions after ``after``, each with its version and ``__former`` (null where the key was new)."""
    m = manifest(spark, path)
    if after < m.since:
        raise ValueError(f"of {path} changes are kept after version {m.since}, not after {after}")
    return _part(spark, path, [f"{path}/rows/folder={folder}" for number, folder in m.log if number > after], _changed_schema(m))


def forget(spark: SparkSession, path: str, upto: int) -> list[str]:
    """Remove what no version after ``upto`` needs: older manifests, folders they alone refer to, and changes up to it.

    ``upto`` must be a version that all readers and counters have passed. Gives
    the folders that went; also those of writes that broke off.
    """
    m = manifest(spark, path)
    upto = min(upto, m.version - 1)
    m.since, m.log = max(m.since, upto), [line for line in m.log if line[0] > upto]
    later = [v for v in versions(spark, path) if v > upto]
    needed = {f for _, f in m.log}
    for v in later:
        for line in manifest(spark, path, v).buckets.values():
            needed |= {line["whole"], *[c[0] for c in line["changes"]]}
    m.version += 1
    files.put_text(spark, f"{path}/manifest/{_name(m.version)}", m.text())
    for v in versions(spark, path):
        if v <= upto:
            files.remove(spark, f"{path}/manifest/{_name(v)}")
    gone = [n for n in files.names(spark, f"{path}/rows") if n.startswith("folder=") and n.removeprefix("folder=") not in needed]
    for name in gone:
        files.remove(spark, f"{path}/rows/{name}")
    return gone
