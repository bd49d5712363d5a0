"""Reports and transitions over the job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from batchloom import schemas
from batchloom.functions.scalars import retry_delay
from batchloom.functions.timing import add_seconds, days_before, hours_before, moment, seconds_between
from batchloom.operators.ordering import number_rows

# Job types.
CHUNK_JOB, FINAL_JOB, OLD_CHUNK_JOB = "chunk_processing", "finalize_batch", "process_chunk"
STALLED = ["retrying", "processing"]


def _is(status: str) -> Column:
    return F.col("status") == status


def queue_stats(jobs: DataFrame) -> DataFrame:
    names = ["pending", "processing", "completed", "failed", "retrying"]
    return jobs.agg(*[F.count_if(_is(s)).alias(s) for s in names])


def queue_stats_folded(jobs: DataFrame) -> DataFrame:
    """Four counters; a status outside them counts as pending."""
    known = ["processing", "completed", "failed"]
    other = ~F.coalesce(F.col("status"), F.lit("pending")).isin(known)
    return jobs.agg(F.count_if(other).alias("pending"), *[F.count_if(_is(s)).alias(s) for s in known])


def worker_activity(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(_is("processing")).alias("processing_jobs")
    )


def dispatch_order(jobs: DataFrame, n: int) -> DataFrame:
    """The next ``n`` pending jobs: priority first, then the higher id."""
    return jobs.filter(_is("pending")).orderBy(F.desc("priority"), F.desc("job_id")).limit(n)


def lease(jobs: DataFrame, workers: DataFrame, as_of) -> DataFrame:
    """All jobs, the next pending ones leased: processing, with start and worker.

    ``workers`` has a row (worker_id) for each free worker, repeated if it takes
    several jobs. The first in the order of ids takes the first in dispatch order.
    """
    free = number_rows(workers.select("worker_id"), [], [F.col("worker_id").asc()], "__place").withColumnRenamed("worker_id", "__worker")
    waiting = jobs.filter(_is("pending")).select("job_id", "priority")
    queue = number_rows(waiting, [], [F.col("priority").desc(), F.col("job_id").desc()], "__place")
    taken = queue.join(free, "__place").select("job_id", "__worker")
    hit = F.col("__worker").isNotNull()
    return jobs.join(taken, "job_id", "left").withColumns({
        "status": F.when(hit, F.lit("processing")).otherwise(F.col("status")),
        "started_at": F.when(hit, moment(as_of)),
        "worker_id": F.coalesce("__worker", "worker_id"),
    }).drop("__worker")


def queue_advice(jobs: DataFrame) -> DataFrame:
    """The queue as the admin page shows it: jobs by status, jobs of the obsolete type, and what to do."""
    names = ["pending", "processing", "retrying", "completed", "failed"]
    counts = jobs.agg(*[F.count_if(_is(n)).alias(n) for n in names], F.count_if(F.col("job_type") == OLD_CHUNK_JOB).alias("total_stuck"))
    stuck, known = F.col("total_stuck"), sum((F.col(n) for n in names[1:]), F.col(names[0]))
    told = F.when(stuck > 0, F.concat(F.lit("Remove "), stuck.cast("string"), F.lit(f" jobs with invalid type '{OLD_CHUNK_JOB}'"))).when(
        known == 0, F.lit("No jobs in queue - system is idle")).otherwise(F.lit("Queue is operating normally"))
    return counts.withColumn("recommendations", F.array(told))


def stuck_jobs(jobs: DataFrame, by_type_only: bool = False) -> DataFrame:
    """Jobs of the obsolete type and, unless ``by_type_only``, stalled ones."""
    old = F.col("job_type") == OLD_CHUNK_JOB
    return jobs.filter(old if by_type_only else old | F.col("status").isin(STALLED))


def cleanup_advice(jobs: DataFrame) -> DataFrame:
    """Advice lines about stuck jobs, as one row."""
    counts = jobs.agg(
        F.count_if(_is("retrying")).alias("retrying"), F.count_if(_is("processing")).alias("processing"),
        F.count_if(F.col("job_type") == OLD_CHUNK_JOB).alias("old"),
    )

    def line(name: str, before: str, after: str) -> Column:
        n = F.col(name)
        return F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after)))

    lines = F.array_compact(F.array(
        line("retrying", "Clear ", " stuck retrying jobs"),
        line("processing", "Clear ", " old processing jobs with no active worker"),
        line("old", "Remove ", f" jobs with obsolete job type '{OLD_CHUNK_JOB}'"),
    ))
    clean = F.array(F.lit("Queue is clean - no action needed"))
    return counts.select("*", F.when(F.size(lines) > 0, lines).otherwise(clean).alias("recommendations"))


def mark_cleanup(
    jobs: DataFrame, as_of, job_types: tuple[str, ...] = (OLD_CHUNK_JOB,), max_age_hours: int | None = 24
) -> DataFrame:
    """All jobs with a ``removed`` mark: a listed type, or stalled and old; without an age only the type counts."""
    removed = F.col("job_type").isin(*job_types)
    if max_age_hours is not None:
        old = F.col("created_at") < hours_before(moment(as_of), max_age_hours)
        removed = removed | (F.col("status").isin(STALLED) & F.coalesce(old, F.lit(False)))
    return jobs.withColumn("removed", removed)


def expire_jobs(jobs: DataFrame, as_of, days: int = schemas.JOB_RETENTION_DAYS, ttl: int | None = None) -> DataFrame:
    """What remains once over jobs are past their retention and records past their time to live."""
    now = moment(as_of)
    over = F.col("status").isin("completed", "failed") & (F.col("completed_at") < days_before(now, days))
    gone = F.coalesce(over, F.lit(False))
    if ttl is not None:
        gone = gone | (seconds_between(F.col("created_at"), now) > ttl)
    return jobs.filter(~gone)


def fail_jobs(jobs: DataFrame, as_of, message: Column, retry: bool = True) -> DataFrame:
    """Each job has failed once more: another attempt is due later, or it is over."""
    count = F.col("retry_count") + 1
    again = (count <= F.col("max_retries")) & F.lit(retry)
    return jobs.select(
        "job_id", count.alias("retry_count"), "max_retries", message.alias("error_message"),
        F.when(again, F.lit("retrying")).otherwise(F.lit("failed")).alias("status"),
        F.when(again, add_seconds(moment(as_of), retry_delay(count).cast("double"))).alias("due_at"),
        F.when(~again, moment(as_of)).alias("completed_at"),
    )


def complete_jobs(jobs: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Jobs with a row in ``results`` (job_id, result) are completed and carry it."""
    hit = F.col("result").isNotNull()
    return jobs.join(results, "job_id", "left").withColumns({
        "status": F.when(hit, F.lit("completed")).otherwise(F.col("status")),
        "completed_at": F.when(hit, moment(as_of)),
    })
