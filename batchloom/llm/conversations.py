"""Conversation structure repair by scalar big-integer weights.

A conversation is wanted whose role initials read ``(s?(ua)+)?``. Each row may be
kept, get another role or go, and empty rows may be put in. The automaton of that
pattern has four states, and rows in order make a DAG of (row, state). A node's
weight is one integer: above ``width`` bits stands the cost of the best way from
there to the end, below it that way's edits, one digit of three bits each, the first
edit in the highest digit and zeros behind the last. An edit in front of a way moves
the digits one place down. So the smaller of two integers is the cheaper way and,
of equally cheap ones, that with the smaller text of edits; plain ``min`` decides.

Only one state can follow an inserted or renamed row, so the text of edits says all.

Rows reach a task sorted by conversation, first as faults and initials (a few bytes a
row), then once more with their texts, which are passed on as they come. What a task
holds of a conversation is its faults, its edits and four integers: a conversation
of any length needs memory for its rows' digits, never for its texts. Time grows with
the square of a conversation's rows, by words of 64 bits (see README for figures).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLANKS = " \t\n\x0b\f\r"
#: faults of a row; a row that is not there counts for its conversation alone
ABSENT, BLANK, DUPLICATE, TRUNCATED, SOUND = range(5)
RENAME_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: edits in the order of their letters; digit 0 is the padding
LETTERS = "DIKR"
_DELETE, _INSERT, _KEEP, _RENAME = range(1, 5)
_DIGIT = 3
_WRITTEN = str.maketrans("1234", LETTERS)
#: states: nothing yet, after s, after u, after a; the row that the pattern wants next, and where it leads
_NEXT = (2, 2, 3, 2)
_STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}
_LEGAL = {"su", "ua", "au"}
_HELD_ROWS, _HELD_CHARS = 4096, 1 << 23


def edits(faults: Sequence[int], initials: Sequence[str]) -> tuple[int, str]:
    """The least cost, and the least text of edits of that cost (initials of delete, insert, keep, rename)."""
    # no best way from any node has more inserts than two fifths of its rows and two; one pass can try two more
    places = len(faults) + 2 * len(faults) // 5 + 6
    width = places * _DIGIT
    low, top = (1 << width) - 1, width - _DIGIT

    def before(edit: int, cost: int, way: int) -> int:
        return ((way >> width) + cost << width) | (edit << top) | ((way & low) >> _DIGIT)

    def with_inserts(ways: list[int | None]) -> list[int | None]:
        out = ways
        for _ in range(2):
            out = [min((w for w in (ways[q], None if out[_NEXT[q]] is None else before(_INSERT, INSERT_COST, out[_NEXT[q]])) if w is not None), default=None)
                   for q in range(4)]
        return out

    ways = with_inserts([0 if q in _ENDS else None for q in range(4)])
    for fault, initial in zip(reversed(faults), reversed(initials)):
        now = []
        for q in range(4):
            options = [before(_DELETE, DELETE_COST, ways[q])]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED_COST if fault == TRUNCATED else 0
                options.append(before(_RENAME, RENAME_COST + more, ways[_NEXT[q]]))
                if initial in _STEPS[q]:
                    options.append(before(_KEEP, more, ways[_STEPS[q][initial]]))
            now.append(min(options))
        ways = with_inserts(now)
    # a digit is an octal figure
    written = f"{ways[0] & low:0{places}o}".rstrip("0")
    return ways[0] >> width, written.translate(_WRITTEN)


@lru_cache(1 << 16)
def _known_edits(faults: bytes, initials: tuple[str, ...]) -> tuple[int, str]:
    return edits(faults, initials)


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    space = F.lit(" ")
    named = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"),
                      F.coalesce(text_col, space).alias("text"), F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("there"))
    return named.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, fault, copies of ``_rows``: equal rows are one row with their number.

    The first of equal (role, text) in the order of turns is no duplicate.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(~F.col("there"), ABSENT).when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(*".!?"), TRUNCATED).otherwise(SOUND)
    alike = rows.select("conv_id", "turn", "role", "digest", fault.alias("fault")).groupBy("conv_id", "turn", "role", "digest", "fault").agg(
        F.count("*").alias("copies"))
    seen = Window.partitionBy("conv_id", "role", "digest", F.col("fault") == ABSENT).orderBy(F.col("turn").asc_nulls_first())
    return alike.withColumn("fault", F.when((F.row_number().over(seen) > 1) & (F.col("fault") >= TRUNCATED), DUPLICATE).otherwise(F.col("fault")))


class _Conversation:
    """What is known of one conversation while its rows go by."""

    def __init__(self, conv_id):
        self.conv_id, self.faults, self.roles = conv_id, bytearray(), []
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.audit = None

    def add(self, turn, role: str, fault: int, copies: int) -> None:
        if fault == ABSENT:
            return
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        initial = role[:1]
        again = DUPLICATE if fault in (TRUNCATED, SOUND) else fault
        for k in range(copies):
            if self.roles and self.roles[-1] + initial not in _LEGAL:
                self.illegal += 1
            self.faults.append(again if k else fault)
            self.roles.append(initial)

    def report(self) -> dict:
        if len(self.faults) <= 64:
            cost, self.audit = _known_edits(bytes(self.faults), tuple(self.roles))
        else:
            cost, self.audit = edits(self.faults, self.roles)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        count = self.faults.count
        self.edits, self.state, self.place = iter(self.audit), 0, 0
        return {"conv_id": self.conv_id, "place": None, "role": None, "text": None, "gaps": gaps, "blank": count(BLANK), "duplicate": count(DUPLICATE),
                "truncated": count(TRUNCATED), "illegal": self.illegal, "cost": cost, "audit": self.audit}

    def _row(self, role: str, text: str, state: int) -> dict:
        self.state, self.place = state, self.place + 1
        return {"conv_id": self.conv_id, "place": self.place - 1, "role": role, "text": text}

    def repaired(self, row: tuple[str, str] | None) -> Iterator[dict]:
        """The rows that the edits make of ``row`` (role, text); of None, those behind the last."""
        for edit in self.edits:
            wanted = _NEXT[self.state]
            if edit == "I":
                yield self._row(ROLES[wanted], "", wanted)
                continue
            if edit == "R":
                yield self._row(ROLES[wanted], row[1], wanted)
            elif edit == "K":
                yield self._row(*row, _STEPS[self.state][row[0][:1]])
            return


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair(df: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Per conversation a row with its report (place is null), then its repaired rows: conv_id, place, role, text.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the digest
    of their text. Null roles and texts are one space, rows without conv_id one
    conversation. Repeated rows are duplicates of the first. A role without letters
    fits nowhere. Where ``present`` is false a row counts for nothing but that its
    conversation is reported. Other columns are not looked at; an empty table gives
    an empty one.

    report: gaps in the turns, rows by their first fault, adjacent roles that do not
    follow each other, the cost, and the edits' initials.
    """
    rows = _rows(df, conv_col, turn_col, role_col, text_col, present)
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = F.lit(None)
    first = faults(rows).select("conv_id", F.lit(0).alias("pass"), "turn", "role", "digest", "fault", "copies", none.cast("string").alias("text"))
    then = rows.filter("there").select("conv_id", F.lit(1).alias("pass"), "turn", "role", "digest", none.cast("int").alias("fault"),
                                       none.cast("long").alias("copies"), "text")
    order = [F.col("conv_id"), F.col("pass"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = first.unionByName(then).repartition("conv_id").sortWithinPartitions(*order).drop("digest")
    names = ["conv_id", "place", "role", "text", *[c.split()[0] for c in _REPORT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chars, schema = None, [], 0, None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r.get(n) for r in held], t) for n, t in zip(names, schema)]
            return pa.RecordBatch.from_arrays(columns, names)

        for got in batches:
            schema = [got.schema.field(0).type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
            for conv_id, again, turn, role, fault, copies, text in zip(*(c.to_pylist() for c in got.columns)):
                if now is None or conv_id != now.conv_id:
                    held += _ended(now)
                    now = _Conversation(conv_id)
                if not again:
                    now.add(turn, role, fault, copies)
                    continue
                if now.audit is None:
                    held.append(now.report())
                held += now.repaired((role, text))
                chars += len(text)
                if len(held) >= _HELD_ROWS or chars >= _HELD_CHARS:
                    yield batch()
                    held, chars = [], 0
        held += _ended(now)
        if held:
            yield batch()

    return dealt.mapInArrow(run, f"conv_id {kind}, place long, role string, text string, {_REPORT}")


def _ended(conversation: _Conversation | None) -> Iterator[dict]:
    if conversation is not None:
        if conversation.audit is None:
            yield conversation.report()
        yield from conversation.repaired(None)


def reports(repaired: DataFrame) -> DataFrame:
    """One row per conversation of what ``repair`` gave."""
    return repaired.filter("place is null").drop("place", "role", "text")


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place, role, text."""
    return repaired.filter("place is not null").select("conv_id", "place", "role", "text")


def with_digests(repaired: DataFrame) -> DataFrame:
    """The reports with repaired_sha256, over ``role:text`` of the repaired rows joined by newlines.

    Reads the rows of ``repair`` in the order in which they leave it, so nothing is shuffled.
    """
    kept = [f for f in repaired.schema.fields if f.name not in ("place", "role", "text")]
    at = {n: repaired.columns.index(n) for n in ("place", "role", "text")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, some = None, None, False

        def closed() -> pa.RecordBatch:
            return last.append_column("repaired_sha256", pa.array([digest.hexdigest()]))

        for batch in batches:
            parts = []
            for k, (place, role, text) in enumerate(zip(*(batch.column(at[n]).to_pylist() for n in ("place", "role", "text")))):
                if place is None:
                    if last is not None:
                        parts.append(closed())
                    last = pa.Table.from_batches([batch.slice(k, 1)]).select([f.name for f in kept])
                    digest, some = hashlib.sha256(), False
                else:
                    digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                    some = True
            if parts:
                yield from pa.concat_tables(parts).combine_chunks().to_batches()
        if last is not None:
            yield from closed().to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return repaired.mapInArrow(run, f"{fields}, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(``conv_id:turn``) modulo 20, for trials of ``repair``: conv_id, turn, role, text, there.

    0 drops a row (there is false), 1 empties its text, 2 takes ``.!?`` out of it,
    3 repeats it, 4 makes it a user's. Nulls are written as one space.
    """
    space = F.lit(" ")
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), space), F.lit(":"))][:-1])
    hit = F.crc32(key) % 20
    text = F.coalesce("text", space)
    return df.select(
        "conv_id", "turn",
        F.when(hit == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (hit != 0).alias("there"), F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    ).drop("__copy")

