"""Life cycle of batches: commands on a table of current rows give new rows and an outcome.

``commands`` holds one row per batch_id. Nothing is changed in place; write the
frames of a ``Change`` as the next version of their tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from batchloom import schemas
from batchloom.functions.scalars import is_active, share_pct
from batchloom.functions.timing import hours_before, moment, seconds_between
from batchloom.operators import folds
from batchloom.operators.ordering import top_per_key
from batchloom.operators.relations import fail_chunks_of
from batchloom.operators.skew import skew_join

BULK_ACTIONS = ["pause", "resume", "cancel", "retry"]


class Change(NamedTuple):
    batches: DataFrame
    chunks: DataFrame | None
    outcome: DataFrame


def _status() -> Column:
    return F.col("status")


def _not(*allowed: str) -> Column:
    return ~_status().isin(*allowed)


def judge(batches: DataFrame, commands: DataFrame, *refusals: tuple[Column, str]) -> DataFrame:
    """(batch_id, previous_status, accepted, reason) for every command.

    ``refusals`` are tried in order on the batch's status.
    """
    reason = F.when(_status().isNull(), F.lit("not found"))
    for condition, text in refusals:
        reason = reason.when(condition, F.lit(text))
    asked = commands.select("batch_id").distinct().join(batches.select("batch_id", "status"), "batch_id", "left")
    return asked.select(
        "batch_id", _status().alias("previous_status"), reason.isNull().alias("accepted"), reason.alias("reason")
    )


def _column_or_null(df: DataFrame, name: str, like: Column) -> Column:
    return F.col(name) if name in df.columns else F.when(F.lit(False), like)


def change_batches(batches: DataFrame, outcome: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set ``values`` on the accepted batches; both sides hold one row per batch."""
    hits = outcome.filter("accepted").select("batch_id", F.lit(True).alias("__hit"))
    hit = F.coalesce("__hit", F.lit(False))
    out = batches.join(hits, "batch_id", "left")
    changed = {n: F.when(hit, v).otherwise(_column_or_null(batches, n, v)) for n, v in values.items()}
    return out.withColumns(changed).drop("__hit")


def change_chunks(
    chunks: DataFrame, outcome: DataFrame, values: dict[str, Column], only: Column | None = None,
    starting: DataFrame | None = None, as_of=None, n: int = schemas.INITIAL_CHUNKS,
) -> DataFrame:
    """Set ``values`` on the chunks of the accepted batches, and put the first chunks to work.

    ``only`` picks the chunks that take the values. Of the batches accepted in
    ``starting``, the first ``n`` chunks that are pending afterwards become
    processing. Where they end is found per batch beforehand, so that one join
    does it all; a batch may own most of the chunks.
    """
    plan = outcome.filter("accepted").select("batch_id", F.lit(True).alias("__hit"))
    taken = only if only is not None else F.lit(True)
    if starting is not None:
        # for a batch that starts: what it takes is what will be pending
        pending = (_status() == "pending") | (taken if "status" in values else F.lit(False))
        ends = top_per_key(chunks.filter(pending), ["batch_id"], [F.col("chunk_number").asc()], n).groupBy(
            "batch_id"
        ).agg(F.max("chunk_number").alias("__end"))
        go = starting.filter("accepted").select("batch_id").join(ends, "batch_id", "left")
        plan = plan.join(go, "batch_id", "left")
    else:
        plan = plan.withColumn("__end", F.lit(None).cast("int"))
    marked = skew_join(chunks, plan, ["batch_id"], "left", ["chunk_id"])
    hit = F.coalesce("__hit", F.lit(False)) & taken
    # the mark is taken before any value changes
    out = marked.withColumn("__hit", hit).withColumns(
        {c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in values.items() if c in chunks.columns}
    )
    if starting is not None:
        first = F.coalesce((_status() == "pending") & (F.col("chunk_number") <= F.col("__end")), F.lit(False))
        out = out.withColumn("__hit", first).withColumns({
            "status": F.when(F.col("__hit"), F.lit("processing")).otherwise(_status()),
            "started_at": F.when(F.col("__hit"), moment(as_of)).otherwise(F.col("started_at")),
        })
    return out.select(*chunks.columns)


def _no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def _blank_chunk() -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    return {
        "status": F.lit("pending"), "started_at": _no_time(), "completed_at": _no_time(), "processed_count": zero,
        "successful_count": zero, "failed_count": zero, "processing_time_seconds": F.lit(None).cast("double"),
        "worker_id": F.lit(None).cast("string"),
    }


def _blank_counters() -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    return {"processed_count": zero, "successful_count": zero, "failed_count": zero}


def admit_chunks(chunks: DataFrame, outcome: DataFrame, as_of, n: int = schemas.INITIAL_CHUNKS) -> DataFrame:
    """The first ``n`` pending chunks of each accepted batch become processing."""
    return change_chunks(chunks, outcome, {}, starting=outcome, as_of=as_of, n=n)


def requeue_pending(chunks: DataFrame, outcome: DataFrame) -> DataFrame:
    """All pending chunks of the accepted batches, as work to hand out."""
    ids = outcome.filter("accepted").select("batch_id")
    return skew_join(chunks.filter(_status() == "pending"), ids, ["batch_id"], "left_semi", ["chunk_id"])


def admit_batches(
    batches: DataFrame, commands: DataFrame, max_active: int = schemas.MAX_ACTIVE_BATCHES, occupied: DataFrame | None = None
) -> DataFrame:
    """Who may start: pending batches, in order of batch_id, while slots are free.

    No more than ``max_active`` requests can win, so only that many are ranked.
    """
    judged = judge(batches, commands, (_not("pending"), "not pending"))
    active = (occupied if occupied is not None else batches).agg(
        F.count_if(_status().isin("queued", "processing"))
    ).scalar()
    front = judged.filter("accepted").orderBy("batch_id").limit(max_active)
    ranked = front.select("batch_id", F.row_number().over(Window.orderBy("batch_id")).alias("__turn"))
    admitted = ranked.filter(F.col("__turn") + active <= max_active).select("batch_id", F.lit(True).alias("__in"))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.col("__in").isNull(), F.lit("maximum concurrent batches reached")
    )
    return judged.join(admitted, "batch_id", "left").select(
        "batch_id", "previous_status", reason.isNull().alias("accepted"), reason.alias("reason")
    )


def start(
    batches: DataFrame, chunks: DataFrame, commands: DataFrame, as_of, max_active: int = schemas.MAX_ACTIVE_BATCHES
) -> Change:
    outcome = admit_batches(batches, commands, max_active)
    new = change_batches(batches, outcome, {"status": F.lit("queued"), "started_at": moment(as_of)})
    return Change(new, admit_chunks(chunks, outcome, as_of), outcome)


def pause(batches: DataFrame, commands: DataFrame, as_of) -> Change:
    outcome = judge(batches, commands, (_not("queued", "processing"), "not running"))
    return Change(
        change_batches(batches, outcome, {"status": F.lit("paused"), "paused_at": moment(as_of)}), None, outcome
    )


def resume(batches: DataFrame, commands: DataFrame) -> Change:
    outcome = judge(batches, commands, (_not("paused"), "not paused"))
    return Change(
        change_batches(batches, outcome, {"status": F.lit("queued"), "paused_at": _no_time()}), None, outcome
    )


def cancel(batches: DataFrame, commands: DataFrame, as_of) -> Change:
    outcome = judge(batches, commands, (_status().isin("completed", "cancelled"), "already over"))
    return Change(
        change_batches(batches, outcome, {"status": F.lit("cancelled"), "completed_at": moment(as_of)}), None, outcome
    )


def _with_chunk_counts(outcome: DataFrame, chunks: DataFrame, counted: Column) -> DataFrame:
    """Add how many chunks of each accepted batch are ``counted``."""
    n = chunks.groupBy("batch_id").agg(F.count_if(counted).alias("__chunks"))
    return outcome.join(n, "batch_id", "left").withColumn(
        "reset_chunks", F.when(F.col("accepted"), F.coalesce("__chunks", F.lit(0))).otherwise(F.lit(0))
    ).drop("__chunks")


def retry(batches: DataFrame, chunks: DataFrame, commands: DataFrame, as_of) -> Change:
    """Any batch starts over: counters at zero, all chunks pending, the first ones at work."""
    outcome = judge(batches, commands)
    new = change_batches(
        batches, outcome,
        {"status": F.lit("queued"), "started_at": moment(as_of), "current_chunk": F.lit(0).cast("long"), **_blank_counters()},
    )
    changed = change_chunks(chunks, outcome, _blank_chunk(), starting=outcome, as_of=as_of)
    return Change(new, changed, _with_chunk_counts(outcome, chunks, F.lit(True)))


def force_start(
    batches: DataFrame, chunks: DataFrame, commands: DataFrame, as_of, skip_validation: bool = False,
    max_active: int = schemas.MAX_ACTIVE_BATCHES,
) -> Change:
    """Back to pending, open chunks reset, then a normal start while slots are free.

    The reset stays even when no slot is free. ``reset_chunks`` counts the chunks
    that are not completed after the reset.
    """
    done = F.lit(False) if skip_validation else _status() == "completed"
    allowed = judge(batches, commands, (done, "completed"))
    reset = change_batches(
        batches, allowed,
        {"status": F.lit("pending"), "started_at": _no_time(), "paused_at": _no_time(),
         "error_message": F.lit(None).cast("string")},
    )
    turn = admit_batches(reset, allowed.filter("accepted"), max_active)
    new = change_batches(reset, turn, {"status": F.lit("queued"), "started_at": moment(as_of)})
    still_open = _status() != "completed"
    changed = change_chunks(
        chunks, allowed,
        {"status": F.lit("pending"), "started_at": _no_time(), "error_message": F.lit(None).cast("string")},
        still_open, starting=turn, as_of=as_of,
    )
    started = turn.select("batch_id", F.col("accepted").alias("started"))
    outcome = allowed.join(started, "batch_id", "left").withColumn("started", F.coalesce("started", F.lit(False)))
    # the reset leaves completed chunks alone, so the open ones are the same before and after
    return Change(new, changed, _with_chunk_counts(outcome, chunks, still_open))


def soft_delete(batches: DataFrame, commands: DataFrame, as_of, retention_days: int = 30) -> Change:
    outcome = judge(batches, commands)
    now = moment(as_of)
    message = F.concat(
        F.lit(f"{schemas.SOFT_DELETE_MARK} on "), F.date_format(now, "yyyy-MM-dd HH:mm:ss"),
        F.lit(f" (retention: {retention_days} days)"),
    )
    values = {"status": F.lit("cancelled"), "completed_at": now, "error_message": message}
    return Change(change_batches(batches, outcome, values), None, outcome)


def reset_stuck(batches: DataFrame, chunks: DataFrame, commands: DataFrame, force: bool = False) -> Change:
    refuse = F.lit(False) if force else ~is_active(_status())
    outcome = judge(batches, commands, (refuse, "not stuck"))
    new = change_batches(
        batches, outcome,
        {"status": F.lit("pending"), "started_at": _no_time(), "completed_at": _no_time(),
         "current_chunk": F.lit(0).cast("long"), **_blank_counters()},
    )
    cleared = change_chunks(chunks, outcome, _blank_chunk())
    return Change(new, cleared, _with_chunk_counts(outcome, chunks, F.lit(True)))


# --- several actions at once ----------------------------------------------------

# Status after each action, by the status before; absent means refused.
TRANSITIONS = {
    "pause": {"queued": "paused", "processing": "paused"},
    "resume": {"paused": "queued"},
    "cancel": {s: "cancelled" for s in ("pending", "queued", "processing", "paused", "failed")},
    "retry": {s: "queued" for s in schemas.BATCH_STATUSES},
}


def after_action(status: Column, action: Column) -> Column:
    """Status after an action, null when it is refused."""
    out = F.when(F.lit(False), status)
    for name, moves in TRANSITIONS.items():
        for old, new in moves.items():
            out = out.when((action == name) & (status == old), F.lit(new))
    return out


def run_sequences(batches: DataFrame, commands: DataFrame, block: int = folds.FOLD) -> DataFrame:
    """Status of every batch after all its commands (batch_id, seq, action), in order of ``seq``.

    A refused command leaves the status as it is. A run of commands is a mapping
    from old to new status, and mappings can be chained, so commands are folded in
    order, ``block`` at a time. A batch may have most of the commands, and ``seq`` any
    values; it must be unique within a batch.
    """
    names = F.array(*[F.lit(s) for s in schemas.BATCH_STATUSES])

    def step(mapping: Column, action: Column) -> Column:
        return F.transform(mapping, lambda s: F.coalesce(after_action(s, action), s))

    def chain(mapping: Column, later: Column) -> Column:
        return F.transform(mapping, lambda s: F.element_at(later, F.array_position(names, s).cast("int")))

    whole = folds.fold_in_order(commands, ["batch_id"], [F.col("seq")], F.col("action"), names, step, chain, block)
    whole = whole.withColumnsRenamed({"n": "commands", "x": "m"})
    place = F.array_position(names, _status()).cast("int")
    # a row per batch on both sides
    return batches.join(whole, "batch_id", "left").select(
        "batch_id", _status().alias("previous_status"),
        F.coalesce(F.element_at("m", place), _status()).alias("status"), F.coalesce("commands", F.lit(0)).alias("commands"),
    )


def bulk_action(batches: DataFrame, commands: DataFrame) -> DataFrame:
    """Outcome per command (batch_id, action); every action stands for itself."""
    asked = commands.select("batch_id", "action").join(batches.select("batch_id", "status"), "batch_id", "left")
    new = after_action(_status(), F.col("action"))
    reason = (
        F.when(~F.col("action").isin(BULK_ACTIONS), F.concat(F.lit("unknown action: "), F.col("action")))
        .when(_status().isNull(), F.lit("not found"))
        .when(new.isNull(), F.concat(F.lit("refused in status "), _status()))
    )
    return asked.select(
        "batch_id", "action", _status().alias("previous_status"), F.coalesce(new, _status()).alias("status"),
        reason.isNull().alias("accepted"), reason.alias("reason"),
    )


def bulk_outcome(outcome: DataFrame) -> DataFrame:
    """n of n accepted, per action."""
    ok, n = F.count_if("accepted"), F.count(F.lit(1))
    return outcome.groupBy("action").agg(
        ok.alias("successful"), n.alias("requested"),
        F.concat(ok.cast("string"), F.lit("/"), n.cast("string")).alias("summary"),
    )


def stuck_batches(batches: DataFrame, as_of, hours: int = 1) -> DataFrame:
    now = moment(as_of)
    late = seconds_between(F.col("started_at"), now) > hours * 3600
    return batches.filter(_status().isin("queued", "processing") & late).select(
        "batch_id", "batch_name", "status", "total_urls", "processed_count",
        share_pct(F.col("processed_count"), F.col("total_urls")).alias("progress_percentage"), "started_at", "created_at",
    )


def cleanup_stuck(batches: DataFrame, chunks: DataFrame, as_of, max_age_hours: int = 24) -> Change:
    """Active batches older than the cutoff are cancelled and their open chunks fail."""
    late = is_active(_status()) & (F.col("created_at") < hours_before(moment(as_of), max_age_hours))
    outcome = batches.filter(late).select(
        "batch_id", _status().alias("previous_status"), F.lit(True).alias("accepted"),
        F.lit(None).cast("string").alias("reason"),
    )
    new = batches.withColumns({
        "error_message": F.when(late, F.lit(schemas.CLEANUP_BATCH_MESSAGE)).otherwise(F.col("error_message")),
        "status": F.when(late, F.lit("cancelled")).otherwise(_status()),
    })
    return Change(new, fail_chunks_of(chunks, outcome), outcome)


def requeue_failed_results(results: DataFrame) -> DataFrame:
    """Work list of the failed results; what succeeded is not repeated."""
    return results.filter(~F.col("success")).select(
        "url", "batch_id", "chunk_id", F.lit(True).alias("retry"), F.col("result_id").alias("original_result_id")
    )
