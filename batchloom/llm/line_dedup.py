"""Line de-duplication with a log-template tree, in DataFrame functions only.

A line's tokens that hold a digit count as variable. The tree has a fixed depth:
number of tokens, then the leading tokens; its leaves are small sets of lines. A leaf
has as many templates as recur in it: a line stands for itself, and for each run of
positions beyond the leading tokens for the template in which that run is variable.
Runs are as long as leaves seven tenths of those positions constant; lines that are
too short for that stand for themselves alone. Lines that agree on all but one run
share a template by equality, and lines whose template stands in many different
texts are dropped. Of long lines two texts are enough.

A text is parsed once, to digests of 128 bits. Only those are shuffled before the end,
where each document meets the numbers of its dropped lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from batchloom.llm.common import stored
from batchloom.operators.skew import skew_join

DEPTH = 3
MIN_TEXTS = 6
#: a line of more words than that recurs when two texts have it
LONG_LINE, LONG_TEXTS = 50, 2
#: of ten positions beyond the leading tokens, how many a template may leave open
OPEN = 3
#: runs that a line has at most
RUNS = -(-20 // OPEN) - 1
VARIABLE = "<*>"
_GAP = r"[\t\x0B\f\r ]+"
#: characters that make a line more than tokens parted by blanks
_ODD = r"[\t\x0B\f\r0-9]"
_NOT_BLANK = r"[^\t\x0B\f\r ]"
#: a token with a digit, from its start on
_HAS_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def _masked(line: Column) -> Column:
    """The line's tokens, parted by single blanks, with variable ones masked; empty if it is blank."""
    tokens = F.regexp_replace(F.trim(F.regexp_replace(line, _GAP, " ")), _HAS_DIGIT, VARIABLE)
    return F.when(line.rlike(_ODD) | line.contains("  "), tokens).otherwise(F.trim(line))


def _halves(*columns: Column | str) -> dict[str, Column]:
    """Two digests of 64 bits."""
    return {"a": F.xxhash64(*columns), "b": F.xxhash64(F.lit(7), *columns)}


def _digest(*columns: Column | str) -> Column:
    """128 bits."""
    return F.struct(*[half.alias(name) for name, half in _halves(*columns).items()])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return _has_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType)


def _row_digest(docs: DataFrame) -> Column:
    """A digest of the whole row; rows repeated as they are share it."""
    return _digest(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields])


def _lines(docs: DataFrame, text_col: str, depth: int, min_texts: int) -> DataFrame:
    """A row for each line that is not blank: row, whole (of its text), pos, leaf, exact, need (texts), templates."""
    text = F.col(text_col)
    # of texts and leaves 64 bits do: a text is counted among those of one line, and leaves only say where to look
    whole = docs.select(_row_digest(docs).alias("row"), F.xxhash64(text).alias("whole"), text.alias("text"))
    cut = whole.select("row", "whole", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # blank lines go by the plain line: a filter on the masked one would mask each line a second time
    masked = cut.filter(F.col("line").rlike(_NOT_BLANK)).select("row", "whole", "pos", _masked(F.col("line")).alias("masked"))
    tokens = masked.withColumn("tokens", F.split("masked", " ", -1)).withColumn("n", F.size("tokens"))
    tokens = tokens.withColumn("run", F.expr(f"greatest((n - {depth}) * {OPEN} div 10, 0)"))
    # every run is digested once, with its place; a template is the digests of the leading tokens and of all runs but one.
    # Places beyond the last run are empty, alike for all lines of n tokens.
    spans = [F.slice("tokens", 1, depth), *[F.slice("tokens", depth + 1 + k * F.col("run"), F.col("run")) for k in range(RUNS)]]
    parts = tokens.withColumns({f"{half}{k}": part for k, span in enumerate(spans) for half, part in _halves("n", F.lit(k), span).items()})
    every = parts.withColumns({half: reduce(Column.bitwiseXOR, [F.col(f"{half}{k}") for k in range(RUNS + 1)]) for half in "ab"})
    templates = F.array(*[F.struct(*[F.col(half).bitwiseXOR(F.col(f"{half}{k}")).alias(half) for half in "ab"]) for k in range(1, RUNS + 1)])
    return every.select(
        "row", "whole", "pos", F.col("a0").alias("leaf"), _digest("masked").alias("exact"),
        F.when(F.col("n") > LONG_LINE, LONG_TEXTS).otherwise(min_texts).cast("short").alias("need"),
        F.when(F.col("run") > 0, F.slice(templates, F.lit(1), F.expr(f"(n - {depth} - 1) div run + 1"))).alias("templates"))


def recurring(docs: DataFrame, text_col: str, depth: int = DEPTH, min_texts: int = MIN_TEXTS) -> tuple[DataFrame, DataFrame]:
    """The lines (row, pos, exact), and the ``exact`` of those that recur, by themselves or by a template."""
    lines = stored(_lines(docs, text_col, depth, min_texts), "lines")
    exacts = stored(lines.groupBy("exact", "whole").agg(F.first("leaf").alias("leaf"), F.first("need").alias("need")).groupBy("exact").agg(
        F.count("*").alias("texts"), F.first("leaf").alias("leaf"), F.first("need").alias("need")), "exacts")
    by_line = exacts.filter("texts >= need").select("exact")
    # only leaves that hold several lines, in texts enough, can have a template that recurs and is no line
    crowded = stored(exacts.groupBy("leaf").agg(F.count("*").alias("forms"), F.sum("texts").alias("texts"), F.first("need").alias("need")).filter(
        "forms > 1 and texts >= need").select("leaf"), "leaves")
    placed = lines.filter("templates is not null").join(crowded, "leaf", "left_semi").select("exact", "whole", "need", F.explode("templates").alias("template"))
    placed = stored(placed.distinct(), "templates")
    wide = placed.groupBy("template", "whole").agg(F.first("need").alias("need")).groupBy("template").agg(
        F.count("*").alias("texts"), F.first("need").alias("need")).filter("texts >= need").select("template")
    by_template = placed.select("exact", "template").distinct().join(wide, "template", "left_semi").select("exact")
    return lines.select("row", "pos", "exact"), by_line.unionByName(by_template).distinct()


def drop_recurring(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The documents with recurring lines cut out of the text, and n_lines and n_dropped.

    A template recurs if ``min_texts`` different texts have it (two where it has more
    than 50 tokens): copies of one text count once, for they are the business of
    document de-duplication. Blank lines are neither counted as templates nor dropped.
    A null text stays null and has no lines, an empty one has one blank line. n_lines
    and n_dropped replace columns of these names; all other columns, of any type, stay,
    as do repeated rows. An empty table gives an empty one.
    """
    kept = docs.drop("n_lines", "n_dropped")
    lines, bad = recurring(kept, text_col, depth, min_texts)
    marked = skew_join(lines, stored(bad, "recurring"), ["exact"], "left_semi", ["row", "pos"])
    marks = marked.groupBy("row").agg(F.collect_set("pos").alias("__dropped")).withColumnRenamed("row", "__r")
    joined = kept.withColumn("__row", _row_digest(kept)).join(marks, F.col("__row") == F.col("__r"), "left")
    text = F.col(text_col)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__cut") - 1), F.col("__dropped"))
    less = joined.withColumn("__cut", F.when(F.col("__dropped").isNotNull(), F.split(text, "\n", -1))).withColumns({
        "n_lines": F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"),
        "n_dropped": F.when(F.col("__dropped").isNull(), F.lit(0)).otherwise(F.size("__dropped")).cast("long"),
        text_col: F.when(F.col("__dropped").isNull(), text).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get(F.col("__cut"), i)), "\n")),
    })
    return less.select(*[F.col(f"`{c}`") for c in kept.columns], "n_lines", "n_dropped")
