"""Associative folds over rows in order, of any number of rows a key.

Rows of a key are numbered, lists of consecutive numbers are folded, then the folds
by lists again, until one is left. No list is longer than ``FOLD``, whatever the
values look like that give the order, and however many rows one key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from batchloom.operators.ordering import number_rows
from batchloom.session import stage

#: rows that are folded together in one list, and folds of them, and so on
FOLD = 500

Step = Callable[[Column, Column], Column]


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column) -> DataFrame:
    """keys, no (from 0 in each key, without gaps) and x, staged."""
    numbered = number_rows(rows.select(*keys, *[c.alias(f"__o{k}") for k, c in enumerate(order)], value.alias("x")), keys,
                           [F.col(f"__o{k}").asc() for k in range(len(order))], "__n")
    return stage(numbered.select(*keys, (F.col("__n") - 1).alias("no"), "x"))


def fold_levels(numbered: DataFrame, keys: Sequence[str], empty: Column, first: Step, joined: Step, size: int = FOLD) -> tuple[list[DataFrame], DataFrame]:
    """The lists of every level (keys, up, parts of no and x), and the last: keys, no (0), n and x, the fold of all rows of a key.

    ``first`` takes a fold and a row's x, ``joined`` a fold and the fold that follows.
    """
    most = numbered.agg(F.max("no")).first()[0] or 0
    level, levels, step = numbered.select(*keys, "no", "x", F.lit(1).cast("long").alias("n")), [], first
    while True:
        lists = level.groupBy(*keys, F.expr(f"no div {size}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("no", "x"))).alias("parts"), F.sum("n").alias("n"))
        levels.append(lists)
        fold = F.aggregate("parts", empty, lambda acc, p: step(acc, p["x"]))
        level = lists.select(*keys, F.col("up").alias("no"), fold.alias("x"), "n")
        most, step = most // size, joined
        if not most:
            return levels, level


def fold_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, empty: Column, first: Step, joined: Step,
                  size: int = FOLD) -> DataFrame:
    """Per key: n (its rows) and x, the fold of ``value`` over them in ``order``, which must be total."""
    return fold_levels(in_order(rows, keys, order, value), keys, empty, first, joined, size)[1].select(*keys, "n", "x")
