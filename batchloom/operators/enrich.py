"""User functions over items: enrichment, handlers per job type, retries, and the cached pipeline.

A work function takes a list of texts and gives one entry per text: a dict with
the analysis, or an exception. It runs inside ``mapInPandas`` on Arrow batches;
a failure is data, so a bad item never fails a task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from batchloom import schemas
from batchloom.functions.answers import parse_whole
from batchloom.functions.phone import phone_flag
from batchloom.functions.scalars import url_sha256
from batchloom.functions.timing import moment
from batchloom.operators import cache as store
from batchloom.operators.skew import skew_join
from batchloom.session import stage

Work = Callable[[list[str]], list]

OUTCOME = [
    T.StructField("success", T.BooleanType()), T.StructField("analysis", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("processing_time", T.DoubleType()),
]


def per_item(fn: Callable[[str], dict]) -> Work:
    """A work function from one that handles a single item and may raise; each item is timed on its own."""

    def work(items: list[str]) -> list:
        out = []
        for item in items:
            try:
                out.append(fn(item))
            except Exception as e:
                out.append(e)
        return out

    work.each = fn
    return work


def _runner(work_for: Callable[[str | None], Work | None], text: str, kind: str | None):
    """The mapInPandas body. It is a closure, so executors need not have this package."""

    def run(frames):
        import json
        import time

        def outcome(answer, seconds):
            if isinstance(answer, Exception):
                return False, None, str(answer), seconds
            return True, json.dumps(answer, ensure_ascii=False), None, seconds

        def call(work, items):
            if hasattr(work, "each"):
                done = []
                for item in items:
                    begun = time.perf_counter()
                    try:
                        answer = work.each(item)
                    except Exception as e:
                        answer = e
                    done.append(outcome(answer, time.perf_counter() - begun))
                return done
            begun = time.perf_counter()
            try:
                answers = list(work(items))
                if len(answers) != len(items):
                    raise ValueError(f"work function gave {len(answers)} answers for {len(items)} items")
            except Exception as e:
                answers = [e] * len(items)
            share = (time.perf_counter() - begun) / max(len(items), 1)
            return [outcome(a, share) for a in answers]

        for pdf in frames:
            rows = [None] * len(pdf)
            kinds = pdf[kind] if kind else None
            groups = {None: range(len(pdf))} if kinds is None else {
                k: [i for i, v in enumerate(kinds) if v == k] for k in kinds.unique()
            }
            texts = pdf[text].tolist()
            for name, places in groups.items():
                work = work_for(name)
                items = [texts[i] for i in places]
                if work is None:
                    done = [(False, None, f"no handler registered for job type: {name}", 0.0)] * len(items)
                else:
                    done = call(work, items)
                for i, d in zip(places, done):
                    rows[i] = d
            out = pdf.copy()
            for at, name in enumerate(("success", "analysis", "error", "processing_time")):
                out[name] = [r[at] for r in rows]
            yield out

    return run


def enrich(rows: DataFrame, work: Work, text: str = "url", slots: int | None = None) -> DataFrame:
    """Run ``work`` over column ``text``; adds success, analysis, error and processing_time.

    ``slots`` caps how many tasks call the function at once, for services with
    a rate limit; the rows are spread evenly over them.
    """
    source = rows.repartition(slots) if slots else rows
    schema = T.StructType([*rows.schema.fields, *OUTCOME])
    return source.mapInPandas(_runner(lambda _: work, text, None), schema)


def run_handlers(jobs: DataFrame, handlers: dict[str, Work], text: str = "payload") -> DataFrame:
    """Run the function registered for each job's type, in one pass; unknown types fail with a message."""
    table = dict(handlers)
    schema = T.StructType([*jobs.schema.fields, *OUTCOME])
    return jobs.mapInPandas(_runner(lambda name: table.get(name), text, "job_type"), schema)


def retry_rounds(
    rows: DataFrame, work_for: Callable[[int], Work], max_retries: int = schemas.MAX_RETRIES, text: str = "url"
) -> DataFrame:
    """Enrich, then repeat what failed up to ``max_retries`` times; adds ``attempts``.

    The loop runs on the driver but holds no rows: each round is staged, so a
    function is not called again for rows that are done.
    """
    done: DataFrame | None = None
    todo = rows
    for attempt in range(1, max_retries + 2):
        tried = stage(enrich(todo, work_for(attempt), text).withColumn("attempts", F.lit(attempt)))
        last = attempt == max_retries + 1 or tried.filter(~F.col("success")).isEmpty()
        kept = tried if last else tried.filter("success")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        todo = tried.filter(~F.col("success")).select(*rows.columns)
    return done


def with_analysis(rows: DataFrame) -> DataFrame:
    """Typed result columns from the JSON text in ``analysis``, parsed once per row."""
    doc = F.col("__doc")
    fields = {n: F.try_variant_get(doc, f"$.{n}", "string") for n in schemas.ANALYSIS_FIELDS}
    fields["store_image"] = F.coalesce(F.try_variant_get(doc, "$.store_image", "boolean"), F.lit(False))
    parsed = rows.withColumn("__doc", F.when(F.col("success"), parse_whole(F.col("analysis")))).withColumns(fields)
    return parsed.withColumn("phone_number", phone_flag(F.col("business_contact"))).drop("__doc")


def union_cached_new(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """All answers of a run, cached and new; a URL has only one of the two."""
    return cached.unionByName(fresh)


class Enriched(NamedTuple):
    results: DataFrame
    cache_rows: DataFrame


def enrich_with_cache(
    rows: DataFrame, cache: DataFrame, work: Work, as_of, slots: int | None = None, retry_unreadable: bool = True
) -> Enriched:
    """Results for ``rows`` (batch_id, chunk_number, item_id, url), calling ``work`` once per missing URL.

    Cached URLs are answered from the cache. Entries that cannot be read are
    worked on again; with ``retry_unreadable=False`` their rows give no result.
    URLs and the outcome of the function are staged, because both are used twice;
    ``rows`` is read once for the URLs and once for the results.
    """
    hashed = store.with_hash(rows)
    # one row per URL: both the work list and the row counts of the join below
    per_url = stage(hashed.groupBy("url_hash").agg(F.first("url").alias("url"), F.count(F.lit(1)).alias("n")))
    readable = cache.select("url_hash", "analysis_data").filter(parse_whole(F.col("analysis_data")).isNotNull())
    known = readable if retry_unreadable else cache
    work_list = per_url.select("url_hash", "url").join(known.select("url_hash"), "url_hash", "left_anti")
    done = stage(enrich(work_list, work, slots=slots))

    from_cache = readable.select(
        "url_hash", F.lit(True).alias("success"), F.col("analysis_data").alias("analysis"),
        F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("processing_time"), F.lit(True).alias("cache_hit"),
    )
    answers = union_cached_new(from_cache, done.drop("url").withColumn("cache_hit", F.lit(False)))
    everything = skew_join(
        hashed, with_analysis(answers), ["url_hash"], "inner", ["item_id"], counts=per_url.select("url_hash", "n")
    )
    results = everything.select(
        F.col("item_id").alias("result_id"), "batch_id", "chunk_number", "url", url_sha256(F.col("url")).alias("url_hash"),
        "success",
        *[F.when(F.col("success"), F.col(n)).alias(n) for n in [*schemas.ANALYSIS_FIELDS, "phone_number"]],
        F.col("error").alias("error_message"), F.col("processing_time").alias("processing_time_seconds"),
        "cache_hit", moment(as_of).alias("created_at"),
    )
    cache_rows = done.filter(F.col("success") & F.col("analysis").isNotNull()).select(
        "url", F.col("analysis").alias("analysis_data"), moment(as_of).alias("at")
    )
    return Enriched(results, cache_rows)
