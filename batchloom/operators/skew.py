"""Equi-joins in which one key may hold a large share of the left rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 0.0005
HOT_FLOOR = 1_000_000
#: rows that a key at the floor has in the sample by which hot keys are found
SAMPLED = 16_000
_SLICES, _SALT = "__slices", "__salt"


def hot_keys(counts: DataFrame, on: Sequence[str], share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """Keys holding more than ``share`` of all rows, with the number of slices each needs.

    ``counts`` has one row per key with its row count ``n``. At most ``1 / share``
    keys can qualify and their slices add up to at most ``2 / share``, whatever
    the size of the data, so the answer may be broadcast.
    """
    bar = F.greatest(counts.agg(F.sum("n") * share).scalar(), F.lit(float(floor)))
    return counts.filter(F.col("n") > bar).select(*on, F.ceil(F.col("n") / bar).cast("int").alias(_SLICES))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str | Column] | None = None,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join in which hot keys of ``left`` are cut into slices.

    ``how`` is inner, left, left_semi or left_anti. The left rows of a hot key
    are dealt over its slices by a hash of ``spread`` (default: the whole row);
    only the matching right rows are copied, once per slice. Every other row
    takes part in a plain equi-join, and AQE may still broadcast a small side.
    ``counts`` (the keys and ``n``) spares the extra look at ``left`` where the
    row counts per key are known already. Otherwise hot keys are found on a
    sample of rows by the same hash, which is the same rows each time; what it
    estimates decides how rows are dealt, never which rows come out.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    dealt = F.xxhash64(*(spread if spread is not None else left.columns))
    if counts is None:
        every = max(1, floor // SAMPLED)
        # another hash than the slices', or a slice would be all of the sample
        seen = left if every == 1 else left.filter(F.pmod(F.xxhash64(F.lit("sample"), dealt), F.lit(every)) == 0)
        counts = seen.groupBy(*on).agg((F.count(F.lit(1)) * every).alias("n"))
    hot = F.broadcast(hot_keys(counts, on, share, floor))
    keyless = F.lit(False)
    for name in on:
        keyless = keyless | F.col(name).isNull()
    # a row without a key matches nothing, so any slice will do
    salted_left = left.join(hot, on, "left").withColumn(
        _SALT,
        F.when(keyless, F.pmod(dealt, F.lit(4096)))
        .when(F.col(_SLICES).isNotNull(), F.pmod(dealt, F.col(_SLICES)))
        .otherwise(F.lit(0)).cast("int"),
    ).drop(_SLICES)
    salted_right = right.join(hot, on, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SLICES), F.lit(1)) - 1))
    ).drop(_SLICES)
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)
