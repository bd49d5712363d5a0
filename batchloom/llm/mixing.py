"""Mixing sources to target weights with a tree of budgets, in DataFrame functions only.

Levels such as domain, language and source make a tree. From the root down, a
node's budget of tokens is dealt to its children by their weights. A child that
has less than its share (all its tokens, as often as they may be repeated) takes
what it has, and its siblings share the rest by their weights; since no node ever
gets more than its leaves hold, a shortage moves to siblings first and only then
to those of an ancestor. Each leaf fills its budget from epochs: whole passes over
its documents and, of the last pass, a prefix of a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from batchloom.llm.common import stored
from batchloom.session import stage

#: documents of a leaf that are ordered in one task
PER_SLICE = 50_000
_HASH_BITS = 48


def word_count(text_col: str = "text") -> Column:
    """Words parted by white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int | Column,
            default_weight: int = 1) -> DataFrame:
    """``leaves`` (levels and ``held``, the tokens each can give) with ``budget``, the tokens each shall give.

    ``weights`` has whole numbers by level and value; other values have
    ``default_weight``. Null is a value of its own. All is counted in whole
    tokens, rounded down at each node, so at most one token a node is lost.
    """
    held_by = {len(levels): leaves.select(*levels, "held")}
    for depth in range(len(levels) - 1, 0, -1):
        held_by[depth] = held_by[depth + 1].groupBy(*levels[:depth]).agg(F.sum("held").alias("held"))
    budget = F.lit(budget) if isinstance(budget, int) else budget
    now = None
    for depth in range(1, len(levels) + 1):
        level, above = levels[depth - 1], list(levels[:depth - 1])
        nodes = held_by[depth].withColumn("w", _weight(level, weights.get(level, {}), default_weight)).filter("w > 0")
        if above:
            parent = now.select(*[F.col(c).alias(f"__{c}") for c in above], "__budget")
            same = F.lit(True)
            for c in above:
                same = same & nodes[c].eqNullSafe(parent[f"__{c}"])
            nodes = nodes.join(parent, same).drop(*[f"__{c}" for c in above])
        else:
            nodes = nodes.withColumn("__budget", budget.cast("long"))
        # in the order of need met per weight, those whose share covers all they hold come first
        family = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        by_need = family.orderBy(F.col("held") / F.col("w"), F.col(level))
        nodes = nodes.withColumns({
            "held_before": F.coalesce(F.sum("held").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "w_left": F.sum("w").over(by_need.rowsBetween(0, Window.unboundedFollowing)),
        })
        full = _exact("held") * _exact("w_left") <= _exact("w") * (_exact("__budget") - _exact("held_before"))
        nodes = nodes.withColumn("full", full).withColumns({
            "held_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("held"))).over(family), F.lit(0)),
            "w_rest": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(family), F.lit(0)),
        })
        share = F.expr("cast(greatest(__budget - held_full, 0) as decimal(20,0)) * cast(w as decimal(10,0)) div w_rest")
        nodes = nodes.withColumn("given", F.when(F.col("full"), F.col("held")).otherwise(share))
        now = nodes.select(*levels[:depth], F.col("given").alias("__budget"))
    return now.withColumnRenamed("__budget", "budget")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], tokens: Column,
        id_col: str = "doc_id", budget: int | None = None, max_epochs: int = 4, seed: int = 7,
        default_weight: int = 1, prefix: str = "mix_") -> DataFrame:
    """The documents taken, with ``epochs``, how often each is taken (1 at least).

    ``levels`` names the tree's levels, outermost first, and says how each follows
    from a row; ``tokens`` counts a row's tokens. ``budget`` is the tokens of the
    whole mix, by default as many as there are. A leaf takes its documents in the
    order of a seeded digest of their id as long as its budget is not used up,
    hence at most one document beyond it. Documents without tokens (null, empty,
    blank) are never taken. Rows with equal ids in a leaf, or without id, are
    taken or left together. Columns of the input stay, and the added ones carry
    ``prefix``. The texts themselves are not shuffled: each leaf's prefix is
    found on narrow rows, and is then one bound on the digest.
    """
    names = [f"{prefix}{x}" for x in levels]
    placed = {**{f"{prefix}{x}": c for x, c in levels.items()}, f"{prefix}tokens": tokens}
    narrow = stage(docs.select(
        *[c.alias(x) for x, c in placed.items()], F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id")
    ).withColumnRenamed(f"{prefix}tokens", "tokens").filter("tokens > 0"))
    sums = stage(narrow.groupBy(*names).agg(F.sum("tokens").alias("supply"), F.count("*").alias("n")))
    whole = sums.agg(F.sum("supply")).first()[0] or 0
    dealt = budgets(sums.select(*names, (F.col("supply") * max_epochs).alias("held")), names,
                    {f"{prefix}{k}": v for k, v in weights.items()}, whole if budget is None else budget, default_weight)
    # stored tables have a measured size: joins broadcast them only where that is small
    leaf = stored(_same(sums, dealt, names).select(
        *names, F.expr("budget div supply").alias("whole_epochs"), F.expr("budget % supply").alias("rest"),
        # a power of two of slices, so that they are the leading bits of the digest
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(PER_SLICE))))).cast("int").alias("bits")), "leaves")

    key = [*names, "slice"]
    sliced = _same(narrow, leaf.filter("rest > 0"), names).withColumn("order", _order("id", seed)).withColumn(
        "slice", F.expr(f"shiftright(cast(conv(substr(order, 1, {_HASH_BITS // 4}), 16, 10) as bigint), {_HASH_BITS} - bits)"))
    earlier = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = sliced.groupBy(*key, "rest").agg(F.sum("tokens").alias("held")).withColumn(
        "start", F.coalesce(F.sum("held").over(earlier), F.lit(0))).filter("start < rest and start + held >= rest")
    # only the slice in which a leaf's budget ends is put in order
    inside = _same(sliced, edges.select(*key, "start"), key).withColumn("before", F.col("start") + F.sum("tokens").over(
        Window.partitionBy(*key).orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    ends = inside.filter("before < rest").groupBy(*names).agg(F.max("order").alias("last_order"))
    plan = stored(_same(leaf.select(*names, "whole_epochs"), ends, names, "left").select(
        *[F.col(x).alias(f"__l_{x}") for x in names], F.col("whole_epochs").alias("__whole"), F.col("last_order").alias("__last")), "plan")

    rows = docs.withColumns(placed).filter(F.col(f"{prefix}tokens") > 0)
    here = _order(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), seed, "__whole")
    same = F.lit(True)
    for x in names:
        same = same & rows[x].eqNullSafe(plan[f"__l_{x}"])
    more = F.coalesce((here <= F.col("__last")).cast("int"), F.lit(0))
    out = rows.join(plan, same).withColumn(f"{prefix}epochs", (F.col("__whole") + more).cast("int"))
    return out.filter(F.col(f"{prefix}epochs") > 0).select(*docs.columns, *placed, f"{prefix}epochs")


def _order(id_col: str | Column, seed: int, epoch: str = "whole_epochs") -> Column:
    """The place of a row in its leaf's last epoch: a digest of seed, epoch and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), id_col))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join on ``names``; one copy of them stays."""
    b = b.select(*[F.col(c).alias(f"__r_{c}") if c in names else F.col(c) for c in b.columns])
    same = F.lit(True)
    for c in names:
        same = same & a[c].eqNullSafe(b[f"__r_{c}"])
    return a.join(b, same, how).drop(*[f"__r_{c}" for c in names])


def repeated(mixed: DataFrame, columns: Sequence[str], prefix: str = "mix_") -> DataFrame:
    """A row for every epoch in which a document is taken."""
    return mixed.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col(f"{prefix}epochs")))).select(*columns)
