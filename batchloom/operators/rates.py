"""User functions behind a limit of calls a minute for each of several keys.

Items are dealt to keys in turn, and each key's items to one task, in order. The task
keeps the gap between two calls of a key, so no minute has more calls of it than the
limit allows, however many tasks run. As many keys work at a time as tasks do.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from batchloom.functions.scalars import assign_key
from batchloom.operators.enrich import OUTCOME, Work
from batchloom.operators.ordering import number_rows

#: calls a minute of a key, and the share of them that is kept free
PER_MINUTE, BUFFER = 55.0, 0.1


class Clock:
    """Seconds that pass; tests put another one in its place."""

    def now(self) -> float:
        return time.time()

    def wait(self, seconds: float) -> None:
        time.sleep(seconds)


def with_keys(rows: DataFrame, keys: int, order: Sequence[Column]) -> DataFrame:
    """``rows`` with api_key (from 0) and turn: the item's number among those of its key, from 0, in ``order``, which must be total."""
    numbered = number_rows(rows, [], order, "__n")
    return numbered.withColumns({"api_key": assign_key(F.col("__n"), keys), "turn": F.expr(f"(__n - 1) div {keys}")}).drop("__n")


def gap_seconds(per_minute: float = PER_MINUTE, buffer: float = BUFFER) -> float:
    """Seconds between two calls of a key."""
    if per_minute <= 0 or not 0 <= buffer < 1:
        raise ValueError("a limit is above 0, a buffer from 0 to below 1")
    return 60.0 / (per_minute * (1 - buffer))


def planned_start(turn: Column, per_minute: float = PER_MINUTE, buffer: float = BUFFER) -> Column:
    """Seconds after the start at which an item's call is due at the earliest."""
    return turn * F.lit(gap_seconds(per_minute, buffer))


def enrich_at_rate(
    keyed: DataFrame, work: Work, per_minute: float = PER_MINUTE, buffer: float = BUFFER, text: str = "url", clock: Clock | None = None,
) -> DataFrame:
    """Run ``work`` item by item over ``with_keys`` rows; adds called_at and what ``enrich`` adds.

    A failure is data. A task that is repeated after its executor was lost first
    waits for one gap, as it does not know when its key was called last.
    """
    gap, clock = gap_seconds(per_minute, buffer), clock or Clock()
    one = getattr(work, "each", None)

    def call(item):
        import json

        try:
            if one is not None:
                answer = one(item)
            else:
                answer = work([item])[0]
                if isinstance(answer, Exception):
                    raise answer
            return True, json.dumps(answer, ensure_ascii=False), None
        except Exception as e:
            return False, None, str(e)

    def run(frames):
        from pyspark import TaskContext

        again = TaskContext.get().attemptNumber() > 0
        free_at: dict[int, float] = {}
        for frame in frames:
            out, rows = frame.copy(), []
            for key, item in zip(frame["api_key"].tolist(), frame[text].tolist()):
                due = free_at.get(key, clock.now() + gap if again else 0.0)
                if due > clock.now():
                    clock.wait(due - clock.now())
                begun = clock.now()
                free_at[key] = begun + gap
                rows.append((begun, *call(item), clock.now() - begun))
            for at, name in enumerate(("called_at", "success", "analysis", "error", "processing_time")):
                out[name] = [r[at] for r in rows]
            yield out

    schema = T.StructType([*keyed.schema.fields, T.StructField("called_at", T.DoubleType()), *OUTCOME])
    return keyed.repartition("api_key").sortWithinPartitions("api_key", "turn").mapInPandas(run, schema)


def most_in_a_minute(called: DataFrame) -> DataFrame:
    """api_key, calls, most: the largest number of its calls in any 60 seconds."""
    # a key's calls are as many as its limit allows while the run lasts; minutes are cut, each carrying the one before
    home = F.floor(F.col("called_at") / 60)
    cut = called.select("api_key", "called_at", F.explode(F.array(home, home + 1)).alias("minute"), home.alias("own"))
    lists = cut.groupBy("api_key", "minute").agg(F.sort_array(F.collect_list(F.struct("called_at", "own"))).alias("all"))
    inside = F.transform(F.filter("all", lambda x: x["own"] == F.col("minute")), lambda x: F.size(
        F.filter("all", lambda y: (y["called_at"] <= x["called_at"]) & (y["called_at"] > x["called_at"] - 60))))
    counted = lists.select("api_key", F.array_max(inside).alias("most"), F.size(inside).alias("calls"))
    return counted.groupBy("api_key").agg(F.sum("calls").alias("calls"), F.max("most").alias("most"))
