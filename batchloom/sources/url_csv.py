"""URL lists in CSV files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from batchloom.functions.scalars import first_filled, strip, url_valid
from batchloom.operators.ordering import running
from batchloom.operators.skew import skew_join
from batchloom.schemas import URL_COLUMNS
from batchloom.session import stored


def clean_url(columns: Sequence[Column]) -> Column:
    """The URL of a row: first filled column, stripped; null when it is no http(s) URL.

    A column of blanks is filled, so it wins and the row has no URL.
    """
    picked = strip(first_filled(*columns))
    return F.when(url_valid(picked), picked)


def with_clean_url(df: DataFrame, columns: Sequence[str], name: str = "url") -> DataFrame:
    return df.withColumn(name, clean_url([F.col(c) for c in columns])).filter(F.col(name).isNotNull())


# A field that is quoted and closed, and one that is not quoted. Possessive: no way back, no deep stack.
_QUOTED, _PLAIN = r'"(?:[^"]++|"")*+"[^,]*+', r'(?!")[^,]*+'
_MORE = rf"(?:,(?:{_QUOTED}|{_PLAIN}))*+\z"
CLOSED_FROM_OUTSIDE = rf"^(?:{_QUOTED}|{_PLAIN}){_MORE}"
CLOSED_FROM_INSIDE = rf'^(?:[^"]++|"")*+"[^,]*+{_MORE}'


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether any record goes over a line end: some line then leaves a quoted field open."""
    return not spark.read.text(path).filter(~F.col("value").rlike(CLOSED_FROM_OUTSIDE)).isEmpty()


#: bytes of one record, far below what a row can hold; an unclosed quote would make a record of all that follows
RECORD_BYTES = 256 << 20
_BLOCK = 100_000  # lines of a file that are folded together
_FEW_FILES = 20_000  # the places of so many files may be broadcast


class Lines(NamedTuple):
    """Lines of text files by their place, and the files."""

    #: file, line (from 0 in its file), value, open (a quoted field goes on behind it)
    lines: DataFrame
    #: file, n (its lines), base (the lines of all files whose paths are smaller)
    files: DataFrame


def number_lines(spark: SparkSession, path) -> Lines:
    """The lines of the files at ``path`` with places that depend on the files alone.

    The text is read once and staged as it comes, split by split. A split knows
    which part of its file it is and has its lines one after the other; the counts
    of the splits before it make a line's number, however many splits or tasks there are.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        "value", (~F.col("value").rlike(CLOSED_FROM_OUTSIDE)).alias("open"))
    text = stored(read, "lines")
    splits = text.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored(splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "splits")
    # a row per file
    smaller = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    lines = text.join(splits, ["file", "split"]).select("file", (F.col("start") + F.col("at") - F.col("first")).alias("line"), "value", "open")
    return Lines(lines, stored(files, "files"))


def join_lines(spark: SparkSession, path: str, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """(file, at, number, value): the records of CSV files whose quoted fields span lines; ``at`` is a record's first line."""
    return _records(number_lines(spark, path).lines, record_bytes)


def _records(lines: DataFrame, record_bytes: int) -> DataFrame:
    """The records of numbered lines.

    A line maps "inside a quoted field" before it to "inside" after it. Seen
    from both states a line is constant, a swap, or changes nothing, so the state
    after any line follows from the last constant line and the swaps since: a
    running maximum and a running sum over the lines of all tasks. A file need
    not be read by one task; only the lines of one record come together. A record
    of more than ``record_bytes`` raises before its lines do.
    """
    block, order = F.floor(F.col("line") / _BLOCK), [F.col("line").asc()]
    seen = lines.select("file", "line", "value", F.col("open").alias("o"), (~F.col("value").rlike(CLOSED_FROM_INSIDE)).alias("i")).withColumns({
        "constant": F.col("o") == F.col("i"), "swap": (F.col("o") & ~F.col("i")).cast("long")
    })
    swaps = running(seen, ["file"], order, {"swaps": (F.sum, F.col("swap"))}, block)
    mark = F.when(F.col("constant"), F.struct("line", "o", "swaps"))
    known = running(swaps, ["file"], order, {"last": (F.max, mark)}, block)
    since = F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0)) + F.coalesce(F.col("last.o"), F.lit(False)).cast("long")
    closed = known.select("file", "line", "value", (since % 2 == 0).cast("long").alias("ends"))
    counted = stored(running(closed, ["file"], order, {"upto": (F.sum, F.col("ends"))}, block).select(
        "file", "line", "value", (F.col("upto") - F.col("ends")).alias("number")), "records")
    _refuse_long(counted, record_bytes)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda s: s.value), "\n")
    return counted.groupBy("file", "number").agg(F.min("line").alias("at"), text.alias("value"))


def _refuse_long(lines: DataFrame, record_bytes: int) -> None:
    """Raise for records (file, number) that are too long to hold, with the place where the first one begins."""
    longest = lines.groupBy("file", "number").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.min_by("value", "line").alias("line")
    ).filter(F.col("bytes") > record_bytes).orderBy("file", "number").select(
        "file", "number", "bytes", F.substring("line", 1, 100).alias("line")).head()
    if longest:
        raise ValueError(f"record {longest['number']} of {longest['file']} has {longest['bytes']} bytes; "
                         f"a quote may be left open in the line that begins {longest['line']!r}")


def scan_url_csv(spark: SparkSession, path: str, spanning: bool | None = None, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """(seq, url) of the valid rows of the CSV file or files at ``path``.

    ``seq`` is the number of the row's first line, files one behind the other by
    their paths: it is unique, and the same however the files are split and whatever
    runs the scan. Files may have different headers, each read by its own; of equal
    names the last one counts, and names that differ in case are different. Where
    records span lines, which is seen file by file when ``spanning`` is left open,
    lines are joined to records before they are parsed.
    """
    lines, files = number_lines(spark, path)
    single = lines.select("file", F.col("line").alias("at"), F.col("line").alias("number"), "value")
    if spanning is None:
        several = stored(lines.filter("open").select("file").distinct(), "spanning")
        spanning = not several.isEmpty()
        records = single if not spanning else single.join(several, "file", "left_anti").unionByName(
            _records(lines.join(several, "file", "left_semi"), record_bytes).select(*single.columns))
    else:
        records = _records(lines, record_bytes).select(*single.columns) if spanning else single
    heads = stored(records.filter("number = 0").select("file", "value"), "headers")
    width = heads.agg(F.max(F.size(F.split("value", ",", -1)))).first()[0] or 1
    named = heads.select("file", _fields(width).alias("names")).select("file", *[_place(n).alias(f"p{k}") for k, n in enumerate(URL_COLUMNS)])
    places = stored(named.join(files, "file").select("file", "base", *[f"p{k}" for k in range(len(URL_COLUMNS))]), "places")
    found = records.filter("number > 0")
    if places.count() <= _FEW_FILES:  # a row of some bytes each
        rows = found.join(F.broadcast(places), "file")
    else:
        rows = skew_join(found, places, ["file"], "inner", ["at"], counts=files.select("file", "n"))
    cells = rows.select((F.col("base") + F.col("at")).alias("seq"), _fields(width).alias("f"), *[f"p{k}" for k in range(len(URL_COLUMNS))])
    picked = cells.select("seq", *[F.try_element_at("f", f"p{k}").alias(f"u{k}") for k in range(len(URL_COLUMNS))])
    return with_clean_url(picked, [f"u{k}" for k in range(len(URL_COLUMNS))]).select("seq", "url")


def _fields(width: int) -> Column:
    """The fields of the record in ``value``; those that it does not have are null."""
    schema = ", ".join(f"c{k} string" for k in range(width))
    parsed = F.from_csv("value", schema, {"quote": '"', "escape": '"', "emptyValue": ""})
    return F.array(*[parsed[f"c{k}"] for k in range(width)])


def _place(name: str) -> Column:
    """Where the last field of that name is in ``names``, from 1; null where there is none."""
    plain = F.transform("names", lambda n: F.regexp_replace(n, "^\ufeff+", ""))
    from_end = F.array_position(F.reverse(plain), name)
    return F.when(from_end > 0, F.size("names") - from_end + 1).cast("int")
