"""Bit sketches of key columns: which keys a table surely lacks, told without reading it.

A sketch is cut into pages of 32,768 bits. A key belongs to one page and sets some of
its bits, so a look-up meets a single row by equality, and both sides spread over
pages however large the table is. A key whose bits are not all set is not there; one
whose bits are all set may be (about one in a thousand that are not there passes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: bits of a page: the width of Spark's bitmap aggregate
PAGE = 32_768
BITS_A_KEY, TURNS = 16, 6


def _page(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(0)), F.col("pages"))


def _bit(key: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(turn + 1)), F.lit(PAGE).cast("long"))


def build(keys: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """A sketch per group: its columns, pages (how many the group has), page, bits.

    Null keys take part like any other. ``groups`` must be few; a group may be of any
    size. Bits are set in each task before pages are shuffled.
    """
    sizes = keys.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) * BITS_A_KEY / PAGE).cast("long").alias("pages"))
    bits = F.explode(F.array(*[_bit(key, t) for t in range(TURNS)])).alias("bit")
    return keys.join(sizes, list(groups)).select(*groups, "pages", _page(key).alias("page"), bits).groupBy(
        *groups, "pages", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(rows: DataFrame, key: str, sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The rows (with ``groups``) whose key their group's sketch may hold; none that it holds is left out."""
    sizes = sketch.select(*groups, "pages").distinct()
    placed = rows.join(sizes, list(groups)).withColumn("page", _page(key)).drop("pages")
    met = placed.join(sketch.drop("pages"), [*groups, "page"])
    every = F.lit(True)
    for turn in range(TURNS):
        bit = _bit(key, turn)
        byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        every = every & (F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1)
    return met.filter(every).select(*rows.columns)
