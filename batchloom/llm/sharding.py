"""Shards of linked documents by balanced label propagation.

Documents that share a link key (here: an equal text) are linked. Groups of more
than half a shard, two a shard at most, are laid out first, over as few shards as
they need. All other linked documents start in a shard by hash, in proportion to
the places left. In each round a group's members are drawn to the shard where
most of it already is, as far as its quota allows; documents without links have
no wish and fill up at the end, so all shards have the same number of rows. The
state is the number of members of each group in each shard, 40 rows a group at
most: a group as large as a third of all rows is no larger here than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from batchloom.llm.common import numbered, settled, stored
from batchloom.session import stage

SHARDS = 40
ROUNDS = 6
#: parts into which the wishes for a shard are cut when they exceed its quota
_STEPS = 1024
#: a row with at most so many copies gets its place from a list
_LIST = 1000


def utf8_size(text_col: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long")


def _round(cells: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """The moves (grp, shard, target, n) of one round."""
    home = cells.groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard", F.lit(seed)).alias("tie"), "shard")).alias("h")).select(
        "grp", F.col("h.shard").alias("target"), F.col("h.n").alias("there"))
    wish = cells.join(home, "grp").filter("shard <> target").select(
        "grp", "shard", "n", "target", F.floor(F.log2("there")).cast("int").alias("pull"),
        F.pmod(F.xxhash64("grp", F.lit(seed)), F.lit(_STEPS)).alias("step"))
    held = cells.select("shard", "n").unionByName(wish.select("shard", (-F.col("n")).alias("n"))).groupBy("shard").agg(F.sum("n").alias("held"))
    room = quotas.join(held, "shard", "left").select(
        F.col("shard").alias("target"), F.greatest(F.lit(0), F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))
    # wishes are granted from the strongest pull on, in steps of groups, until the room is used up
    order = Window.partitionBy("target").orderBy(F.desc("pull"), "step").rowsBetween(Window.unboundedPreceding, -1)
    steps = wish.groupBy("target", "pull", "step").agg(F.sum("n").alias("asked")).withColumn(
        "before", F.coalesce(F.sum("asked").over(order), F.lit(0))).join(F.broadcast(room), "target").filter("before < room").select(
        "target", "pull", "step", F.least(F.lit(1.0), (F.col("room") - F.col("before")) / F.col("asked")).alias("share"))
    granted = wish.join(steps, ["target", "pull", "step"]).withColumn("n", F.floor(F.col("n") * F.col("share")).cast("long"))
    return granted.filter("n > 0").select("grp", "shard", "target", "n")


def propagate(cells: DataFrame, quotas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (grp, shard, n) after up to ``rounds`` rounds of moves; ``quotas`` (shard, quota) has a row a shard."""
    now = stage(cells)
    for seed in range(rounds):
        moves = stage(_round(now, quotas, seed))
        if moves.isEmpty():
            break
        gone = moves.select("grp", "shard", (-F.col("n")).alias("n"))
        come = moves.select("grp", F.col("target").alias("shard"), "n")
        now = stage(now.unionByName(gone).unionByName(come).groupBy("grp", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    return now


def lay_out(groups: list[tuple[str, int]], free: list[int]) -> list[tuple[str, int, int]]:
    """(group, shard, members) of large groups, each over few shards; ``free`` loses their places."""
    out = []
    for group, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        while n:
            # the fullest shard that takes all that is left, else the emptiest
            fits = [s for s, room in enumerate(free) if room >= n]
            shard = min(fits, key=lambda s: (free[s], s)) if fits else max(range(len(free)), key=lambda s: (free[s], -s))
            took = min(n, free[shard])
            out.append((group, shard, took))
            free[shard] -= took
            n -= took
    return out


def shard(docs: DataFrame, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, text_hash, grp, law, shard, slot, grown_shard.

    The law is ``rows``: shards differ by one row at most. ``group`` is what
    linked documents share, by default a digest of the text; null means no link.
    slot numbers a shard's rows from 0 without gaps; linked rows come first. A
    null text counts as empty. Rows without id or repeated are rows like others.
    """
    group = F.md5(F.coalesce(F.col(text_col), F.lit(""))) if group is None else group
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), utf8_size(text_col).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text_col).alias("text_hash"), group.alias("grp")))
    total = rows.count()
    sizes = rows.filter("grp is not null").groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1")
    marked = stage(rows.join(sizes, "grp", "left"))
    linked, alone = marked.filter("members is not null").drop("members"), marked.filter("members is null").drop("members")
    order = [F.col("doc_id"), F.col("text_hash"), F.col("grp")]
    spark = docs.sparkSession
    quotas = spark.range(shards).select(
        F.col("id").cast("int").alias("shard"), (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).alias("quota"))
    quota = max(1, total // shards)

    # more than half a quota: two groups a shard at most, a bounded list
    large = [tuple(r) for r in sizes.filter(F.col("members") * 2 > quota).collect()]
    left = [total // shards + (s < total % shards) for s in range(shards)]
    laid = spark.createDataFrame(lay_out(large, left), "grp string, shard int, n long")
    place, start, upto = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(max(1, sum(left)))), F.lit(0), sum(left)
    for s in reversed(range(shards)):
        upto -= left[s]
        # the last shard whose places begin at or before the hash
        start = F.when(place < upto + left[s], F.lit(s)).otherwise(start)
    cells = linked.join(F.broadcast(laid.select("grp").distinct()), "grp", "left_anti").groupBy("grp", start.cast("int").alias("shard")).agg(F.count("*").alias("n"))
    free = spark.createDataFrame([(s, n) for s, n in enumerate(left)], "shard int, quota long")
    done = stored(propagate(cells, free, rounds), "cells").unionByName(laid)
    # the members of a group, numbered, take its shares one after the other
    upto = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    shares = done.withColumn("upto", F.sum("n").over(upto)).select("grp", "shard", (F.col("upto") - F.col("n")).alias("from"), "upto")
    member = numbered(linked, ["grp"], order, "member", total)
    drawn = stage(member.join(shares, "grp").filter("member >= from and member < upto").drop("member", "from", "upto"))
    # what exceeds a quota, and what has no links, fills the free places
    placed = stage(numbered(drawn, ["shard"], [F.col("grp"), *order[:2]], "slot", total).join(F.broadcast(quotas), "shard"))
    held = placed.groupBy("shard").agg(F.least(F.count("*"), F.first("quota")).alias("held"))
    free = quotas.join(held, "shard", "left").select("shard", F.coalesce("held", F.lit(0)).alias("held"), (F.col("quota") - F.coalesce("held", F.lit(0))).alias("free"))
    by_shard = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    places = free.withColumn("last", F.sum("free").over(by_shard)).select("shard", "held", (F.col("last") - F.col("free")).alias("first"), "last")
    names = ["doc_id", "size", "text_crc32", "text_hash", "grp"]
    pool = alone.select(*names).unionByName(placed.filter("slot >= quota").select(*names))
    filled = numbered(pool, [], order, "number", total).join(
        F.broadcast(places), (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last"))).select(
        *names, "shard", (F.col("held") + F.col("number") - F.col("first")).alias("slot"))
    out = placed.filter("slot < quota").select(*names, "shard", "slot").unionByName(filled)
    return out.select(*names[:4], "grp", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents as they were, with ``shard`` and ``slot`` (which replace columns of these names).

    Rows repeated as they are get the places of their copies, in any order.
    """
    own = docs.drop("shard", "slot")
    kept = own.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")))

    def placed() -> DataFrame:
        rows = shard(docs, id_col=id_col, text_col=text_col, **options).select(
            F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("__key"), F.struct("shard", "slot").alias("__at"))
        return rows.withColumns({"__copy": F.row_number().over(Window.partitionBy("__key").orderBy("__at")),
                                 "__copies": F.count("*").over(Window.partitionBy("__key"))})

    # in a struct, nulls are equal to each other; a list of places is bounded, so the texts meet the places of few copies in one shuffle
    places = settled(docs.sparkSession, "places", placed)
    few = stored(places.filter(F.col("__copies") <= _LIST).groupBy("__key").agg(F.sort_array(F.collect_list("__at")).alias("__ats")), "few")
    many = stored(places.filter(F.col("__copies") > _LIST).select("__key", "__copy", "__at"), "many")
    copy = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    of_few = kept.join(few, "__key").withColumn("__at", F.get("__ats", copy - 1))
    crowded = kept.join(many.select("__key").distinct(), "__key", "left_semi").withColumn("__copy", copy)
    of_many = crowded.join(many, ["__key", "__copy"])
    return of_few.select(*own.columns, "__at.*").unionByName(of_many.select(*own.columns, "__at.*"))
