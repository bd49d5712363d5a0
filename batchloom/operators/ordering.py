"""Numbering and running totals over ordered rows, without one task per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from batchloom.session import stage

_SLICE, _KEY = "__slice", "__key"


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], bucket: Column | None = None
) -> DataFrame:
    """Add inclusive running sums per key, in ``order``; see ``running``."""
    return running(df, keys, order, {n: (F.sum, v) for n, v in sums.items()}, bucket)


def _plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


#: a running value and what comes before its slice; greatest and least pass over nulls
_WITH = {F.sum: _plus, F.max: F.greatest, F.min: F.least}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    folds: dict[str, tuple[Callable, Column]],
    bucket: Column | None = None,
) -> DataFrame:
    """Add inclusive running values per key, in ``order``: ``F.sum``, ``F.max`` or ``F.min`` of a column.

    A key is cut into consecutive slices; each slice is folded on its own, and
    the totals of the slices before it are added. Slices come either from
    ``bucket``, a value that never falls along the order and holds a bounded
    number of rows (for instance ``seq div 100000`` for unique ``seq``), or from
    a range partitioning of (keys, order). The latter is sampled from the data,
    copes with any distribution, and is staged because both passes must see the
    same slices. ``order`` must be total; a null bucket comes first.
    """
    keys = list(keys)
    if bucket is None:
        ranged = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order)
        sliced = stage(ranged.withColumn(_SLICE, F.spark_partition_id()))
    else:
        sliced = df.withColumn(_SLICE, bucket)
    # in structs, nulls are equal to each other, so none is lost, and window and join share a shuffle
    sliced = sliced.withColumns({_KEY: F.struct(*keys) if keys else F.lit(0), _SLICE: F.struct(_SLICE)})

    totals = sliced.groupBy(_KEY, _SLICE).agg(*[fold(v).alias(f"__total_{n}") for n, (fold, v) in folds.items()])
    earlier = Window.partitionBy(_KEY).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        _KEY, _SLICE, *[fold(f"__total_{n}").over(earlier).alias(f"__start_{n}") for n, (fold, _) in folds.items()]
    )
    within = Window.partitionBy(_KEY, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({n: fold(v).over(within) for n, (fold, v) in folds.items()})
    return local.join(starts, [_KEY, _SLICE]).select(
        *df.columns,
        *[_WITH[fold](F.col(n), F.col(f"__start_{n}")).alias(n) for n, (fold, _) in folds.items()],
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_num",
    bucket: Column | None = None,
) -> DataFrame:
    """``row_number`` per key that also holds up when one key has most of the rows."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, bucket)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key.

    The rank filter sits right on the window, so Spark prunes every task to
    ``k`` rows per key before the shuffle (WindowGroupLimit in the plan).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def with_previous_rows(
    df: DataFrame, keys: Sequence[str], position: str, lookback: int, block: int = 10_000
) -> tuple[DataFrame, str]:
    """Cut numbered rows into blocks that carry the ``lookback`` rows before them.

    Gives the frame and its block column: windows over (keys, block) then see
    all they need. Keep only rows whose ``__own`` is true afterwards.
    """
    home = F.floor((F.col(position) - 1) / block)
    spills = F.pmod(F.col(position) - 1, F.lit(block)) >= block - lookback
    homes = F.when(spills, F.array(home, home + 1)).otherwise(F.array(home))
    out = df.withColumn("__block", F.explode(homes)).withColumn("__own", F.col("__block") == home)
    return out, "__block"
