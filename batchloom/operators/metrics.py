"""Reports over metric samples: latency, targets, trends, alerts and adaptive rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from batchloom.operators import folds
from batchloom.operators.ordering import number_rows, running, running_sums, with_previous_rows
from batchloom.operators.skew import skew_join

# --- fixed values ---------------------------------------------------------------
# Targets by batch size: largest size, then (metric, direction, target).
TARGETS = {
    "small": (1_000, [("processing_time", "max", 300.0), ("throughput_per_minute", "min", 60.0),
                      ("error_rate", "max", 0.02), ("memory_usage_mb", "max", 2048.0)]),
    "medium": (100_000, [("processing_time", "max", 3600.0), ("throughput_per_minute", "min", 100.0),
                         ("error_rate", "max", 0.05), ("memory_usage_mb", "max", 4096.0)]),
    "large": (None, [("processing_time", "max", 86400.0), ("throughput_per_minute", "min", 150.0),
                     ("error_rate", "max", 0.1), ("memory_usage_mb", "max", 8192.0)]),
}
# Alerts: name, metric, threshold, direction, seconds the breach must last, what to do.
ALERTS = [
    ("high_error_rate", "error_rate", 0.1, "above", 300, "alert"),
    ("low_throughput", "processing_rate", 30.0, "below", 600, "alert"),
    ("high_memory", "memory_usage_percent", 85.0, "above", 180, "scale_up"),
    ("large_queue", "queue_size", 5000.0, "above", 600, "scale_up"),
    ("database_slow_queries", "db_query_time_p95", 5000.0, "above", 300, "investigate"),
]
# Advice on low throughput.
ERROR_ADVICE = [
    "High error rate detected - check API key limits",
    "Review error logs for specific failure patterns",
    "Consider implementing exponential backoff",
    "Verify network connectivity to external APIs",
]
QUEUE_ADVICE = [
    "Large queue backlog - increase worker capacity",
    "Add more API keys to increase rate limits",
    "Increase MAX_CONCURRENT_WORKERS",
    "Consider horizontal scaling",
]
GENERAL_ADVICE = [
    "Check database connection pool exhaustion",
    "Monitor Redis performance",
    "Verify Cloud Run/Function resource allocation",
    "Review network latency to external APIs",
]
RATE_START, RATE_MIN, RATE_MAX = 60.0, 30.0, 100.0
RATE_UP, RATE_DOWN = 1.1, 0.9
GOOD_SHARE, BAD_SHARE = 0.95, 0.8
# --------------------------------------------------------------------------------


def latency_report(samples: DataFrame, percentiles: Sequence[int] = (95, 99)) -> DataFrame:
    """Totals, rates and exact percentiles of (ts, success, response_time), as one row.

    The p-th percentile is the value at 0-based rank min(int(p/100 * n), n-1).
    Equal values are counted together first; the distinct values are then range
    partitioned and summed up, so neither ties nor outliers crowd one task.
    """
    times = F.when(F.col("success"), F.col("response_time"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = samples.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if("success").alias("successful_requests"),
        F.avg(times).alias("a"), F.min(times).alias("lo"), F.max(times).alias("hi"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("span"),
    )
    counts = samples.filter("success").groupBy("response_time").agg(F.count(F.lit(1)).alias("n"))
    upto = running_sums(counts, [], [F.col("response_time").asc()], {"upto": F.col("n")})
    total = F.col("__total")
    ranked = upto.select("response_time", "upto").withColumn("__total", whole.select("successful_requests").scalar())
    picks = ranked.agg(*[
        F.min(F.when(F.col("upto") >= F.least(F.floor(F.lit(p / 100) * total) + 1, total), F.col("response_time")))
        .alias(f"p{p}") for p in percentiles
    ])
    n, ok = F.col("total_requests"), F.col("successful_requests")
    zero = F.lit(0.0)
    p_of = picks.select(F.struct("*")).scalar()
    return whole.withColumn("__picks", p_of).select(
        "total_requests", "successful_requests", (n - ok).alias("failed_requests"),
        F.when(n > 0, ok * F.lit(100.0) / n).alias("success_rate"),
        F.coalesce("a", zero).alias("avg_response_time"), F.coalesce("lo", zero).alias("min_response_time"),
        F.coalesce("hi", zero).alias("max_response_time"),
        *[F.coalesce(F.col("__picks")[f"p{p}"], zero).alias(f"p{p}_response_time") for p in percentiles],
        F.when((n > 1) & (F.col("span") > 0), ok / F.col("span")).otherwise(zero).alias("requests_per_second"),
    )


def _targets(df: DataFrame) -> DataFrame:
    rows = [(tier, m, d, t) for tier, (_, metrics) in TARGETS.items() for m, d, t in metrics]
    return df.sparkSession.createDataFrame(rows, "tier string, metric string, direction string, target double")


def _tier(size: Column) -> Column:
    out = None
    for name, (limit, _) in TARGETS.items():
        if limit is None:
            return out.otherwise(F.lit(name))
        out = F.when(size <= limit, F.lit(name)) if out is None else out.when(size <= limit, F.lit(name))
    return out


def target_check(actuals: DataFrame) -> DataFrame:
    """(id, metric, target, actual, passed) for rows of id, batch_size and the metrics.

    A missing metric does not pass.
    """
    metrics = [m for m, _, _ in TARGETS["small"][1]]
    long = actuals.withColumn("tier", _tier(F.col("batch_size"))).unpivot(
        ["id", "tier"], metrics, "metric", "actual"
    )
    # the target table is fixed: three tiers of four metrics
    joined = long.join(F.broadcast(_targets(actuals)), ["tier", "metric"])
    within = F.when(F.col("direction") == "max", F.col("actual") <= F.col("target")).otherwise(
        F.col("actual") >= F.col("target")
    )
    return joined.select("id", "tier", "metric", "direction", "target", "actual", F.coalesce(within, F.lit(False)).alias("passed"))


def target_overall(checked: DataFrame) -> DataFrame:
    return checked.groupBy("id").agg(F.every("passed").alias("overall_passed"), F.count_if("passed").alias("passed"))


def rolling_window(
    samples: DataFrame, aggregates: dict[str, Column], seconds: int = 3600, keys: Sequence[str] = ()
) -> DataFrame:
    """Each sample with aggregates over the samples of the ``seconds`` before it, itself included.

    Time is cut into stretches of that length, each carrying the one before, so
    every window lies in one stretch and long series spread over tasks. Takes any
    aggregate, and is meant for series with a bounded sampling rate; ``rolling_values``
    takes any density.
    """
    length = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    home = F.floor(F.col("__at") / length)
    cut = (
        samples.withColumn("__at", at)
        .withColumn("__stretch", F.explode(F.array(home, home + 1)))
        .withColumn("__own", F.col("__stretch") == home)
    )
    # a sample exactly ``seconds`` old is out
    w = Window.partitionBy(*keys, "__stretch").orderBy("__at").rangeBetween(-(length - 1), 0)
    out = cut.withColumns({n: a.over(w) for n, a in aggregates.items()})
    return out.filter("__own").drop("__at", "__stretch", "__own")


#: how a window's value is made of those of its parts
_ROLLING = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def rolling_values(samples: DataFrame, wanted: dict[str, tuple[str, str | None]], seconds: int = 3600, keys: Sequence[str] = ()) -> DataFrame:
    """Each sample with values over the ``seconds`` before it, itself included.

    ``wanted`` has for each new column its kind, one of count, sum, mean, min and max,
    and the column it is of (count: None counts samples). Time is cut into slices as
    long as a window, so a window is the start of one slice up to the sample and the
    end of the slice before. Both are running values inside a slice, one forwards and
    one backwards, and nothing from outside a window enters it. Neither a dense hour
    nor equal times crowd a task.
    """
    keys, length = list(keys), seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    parts: dict[str, tuple[str, str | None]] = {}
    for name, (kind, of) in wanted.items():
        if kind == "mean":
            parts |= {f"__s_{name}": ("sum", of), f"__c_{name}": ("count", of)}
        else:
            parts[f"__v_{name}"] = (kind, of)
    ways = {n: _ROLLING[kind] for n, (kind, _) in parts.items()}

    def of_moment(kind: str, of: str | None) -> Column:
        if kind == "count":
            return F.count(F.lit(1) if of is None else F.col(of))
        return F.sum(F.coalesce(F.col(of).cast("double"), F.lit(0.0))) if kind == "sum" else _ROLLING[kind](of)

    # samples of one moment share their window
    points = samples.filter(F.col("ts").isNotNull()).groupBy(*keys, at.alias("__at")).agg(
        *[of_moment(kind, of).alias(n) for n, (kind, of) in parts.items()])
    sliced = points.withColumn("__stretch", F.expr(f"(__at - pmod(__at, {length})) div {length}"))
    runs = {f"{n}_run": (ways[n], F.col(n)) for n in parts}
    heads = running(sliced, [*keys, "__stretch"], [F.col("__at").asc()], runs).select(*keys, "__at", *runs)
    ends = sliced.select(*keys, "__stretch", "__at", F.lit(None).cast("long").alias("__of"), *parts)
    # a sample exactly ``seconds`` old is out, so coming from the end the mark stands before it
    nothing = {n: F.lit(0 if ways[n] is F.sum else None).cast(sliced.schema[n].dataType).alias(n) for n in parts}
    marks = sliced.select(*keys, (F.col("__stretch") - 1).alias("__stretch"), (F.col("__at") - length).alias("__at"),
                          F.col("__at").alias("__of"), *nothing.values())
    backwards = [F.col("__at").desc(), F.col("__of").desc_nulls_last()]
    tails = running(ends.unionByName(marks), [*keys, "__stretch"], backwards, runs).filter(F.col("__of").isNotNull()).select(
        *keys, F.col("__of").alias("__at"), *runs)
    windows = heads.unionByName(tails).groupBy(*keys, "__at").agg(*[ways[n](f"{n}_run").alias(n) for n in parts])

    def value(name: str) -> Column:
        if wanted[name][0] != "mean":
            return F.col(f"__v_{name}").alias(name)
        return F.when(F.col(f"__c_{name}") > 0, F.col(f"__s_{name}") / F.col(f"__c_{name}")).alias(name)

    found = windows.select(*keys, "__at", *[value(n) for n in wanted])
    return skew_join(samples.withColumn("__at", at), found, [*keys, "__at"], "left").drop("__at")


def rolling_means(samples: DataFrame, columns: Sequence[str], seconds: int = 3600, keys: Sequence[str] = ()) -> DataFrame:
    """Each sample with the count and the means of ``columns`` over the ``seconds`` before it, itself included."""
    return rolling_values(samples, {"samples": ("count", None), **{f"avg_{c}": ("mean", c) for c in columns}}, seconds, keys)


def _last(samples: DataFrame, keys: Sequence[str], lookback: int) -> tuple[DataFrame, list[str]]:
    """Numbered samples in blocks that carry the ``lookback`` samples before them."""
    # samples of one moment stand in the order of their values, so that runs agree
    rest = [F.col(c).asc() for c in sorted(samples.columns) if c != "ts" and c not in keys]
    numbered = number_rows(samples, keys, [F.col("ts").asc(), *rest], "__n")
    blocks, block = with_previous_rows(numbered, keys, "__n", lookback)
    return blocks, [*keys, block]


def _over(parts: list[str], rows: int):
    return Window.partitionBy(*parts).orderBy("__n").rowsBetween(-(rows - 1), 0)


def scale_decision(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether to scale up or down at each sample (ts, cpu_percent, queue_size, error_rate)."""
    blocks, parts = _last(samples, keys, 9)
    five, ten = _over(parts, 5), _over(parts, 10)
    five_ago = F.lag("queue_size", 4).over(Window.partitionBy(*parts).orderBy("__n"))
    up = (F.col("__n") >= 5) & (F.avg("cpu_percent").over(five) > 80) & (F.col("queue_size") > five_ago)
    down = (
        (F.col("__n") >= 10) & (F.avg("cpu_percent").over(ten) < 30) & (F.avg("queue_size").over(ten) < 100)
        & (F.avg("error_rate").over(ten) < 0.05)
    )
    no = F.lit(False)
    out = blocks.withColumns({"scale_up": F.coalesce(up, no), "scale_down": F.coalesce(down, no)})
    return out.filter("__own").select(*keys, "ts", "scale_up", "scale_down")


def throughput_diagnosis(
    samples: DataFrame, keys: Sequence[str] = (), low_rate: float = 50, high_errors: float = 0.1, long_queue: float = 1000
) -> DataFrame:
    """Averages of the last five samples and advice when the rate is low; too few samples give none."""
    blocks, parts = _last(samples, keys, 4)
    five = _over(parts, 5)
    averaged = blocks.withColumns({
        f"avg_{n}": F.avg(n).over(five) for n in ("processing_rate", "error_rate", "queue_size")
    }).filter(F.col("__own") & (F.col("__n") >= 5))

    def lines(condition: Column, texts: list[str]) -> Column:
        return F.when(condition, F.array(*[F.lit(t) for t in texts])).otherwise(F.array().cast("array<string>"))

    advice = F.concat(
        lines(F.col("avg_error_rate") > high_errors, ERROR_ADVICE),
        lines(F.col("avg_queue_size") > long_queue, QUEUE_ADVICE), lines(F.lit(True), GENERAL_ADVICE),
    )
    low = F.col("avg_processing_rate") < low_rate
    return averaged.select(
        *keys, "ts", "avg_processing_rate", "avg_error_rate", "avg_queue_size",
        F.when(low, advice).otherwise(F.array().cast("array<string>")).alias("recommendations"),
    )


def sustained_alerts(samples: DataFrame, alerts: Sequence[tuple] = tuple(ALERTS)) -> DataFrame:
    """Stretches in which a metric stayed beyond its threshold for the whole duration.

    ``samples`` is long: (ts, metric, value), one value per metric and time.
    """
    rules = samples.sparkSession.createDataFrame(
        [tuple(a) for a in alerts], "alert string, metric string, threshold double, direction string, seconds int, action string"
    )
    # the rules are the caller's short list
    ruled = samples.join(F.broadcast(rules), "metric")
    breach = F.when(F.col("direction") == "above", F.col("value") > F.col("threshold")).otherwise(
        F.col("value") < F.col("threshold")
    )
    marked = ruled.withColumn("__bad", F.coalesce(breach, F.lit(False)).cast("long"))
    one = F.lit(1).cast("long")
    summed = running_sums(marked, ["alert"], [F.col("ts").asc()], {"__n": one, "__bads": F.col("__bad")})
    # consecutive breaches share the distance between place and count
    islands = summed.filter(F.col("__bad") == 1).groupBy(
        "alert", "action", "seconds", (F.col("__n") - F.col("__bads")).alias("__island")
    ).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("samples"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
    )
    lasted = F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at"))
    return islands.withColumn("lasted_seconds", lasted).filter(F.col("lasted_seconds") >= F.col("seconds")).select(
        "alert", "action", "started_at", "ended_at", "samples", "lowest", "highest", "lasted_seconds"
    )


#: periods that are folded together in one list
FOLD = folds.FOLD


def adaptive_rate(shares: DataFrame) -> DataFrame:
    """Rate per key after each period, for (key, period, share) of successes.

    A good period raises the rate, a bad one lowers it, within bounds. Each step
    is a clamped multiplication, and so is any run of steps: x becomes
    least(greatest(x * a, lo), hi). Numbered periods are folded by lists, the folds
    by lists again; from the top down every fold then learns the rate it starts with.
    """
    good, bad = F.col("share") > GOOD_SHARE, F.col("share") < BAD_SHARE
    up, none = F.lit(float("inf")), F.lit(float("-inf"))
    step = F.struct(
        F.when(good, F.lit(RATE_UP)).when(bad, F.lit(RATE_DOWN)).otherwise(F.lit(1.0)).alias("a"),
        F.when(bad, F.lit(RATE_MIN)).otherwise(none).alias("lo"), F.when(good, F.lit(RATE_MAX)).otherwise(up).alias("hi"),
    )

    def after(x: Column, f: Column) -> Column:
        return F.least(F.greatest(x * f.a, f.lo), f.hi)

    def joined(acc: Column, f: Column) -> Column:
        return F.struct((acc.a * f.a).alias("a"), after(acc.lo, f).alias("lo"), after(acc.hi, f).alias("hi"))

    same = F.struct(F.lit(1.0).alias("a"), none.alias("lo"), up.alias("hi"))
    numbered = folds.in_order(shares, ["key"], [F.col("period")], F.struct("period", step.alias("f")))
    levels, top = folds.fold_levels(numbered.select("key", "no", F.col("x.f").alias("x")), ["key"], same, joined, joined, FOLD)

    def walk(acc: Column, p: Column) -> Column:
        rate = after(acc.rate, p["x"])
        line = F.struct(p.no.alias("no"), acc.rate.alias("start"), rate.alias("rate"))
        return F.struct(rate.alias("rate"), F.concat(acc.out, F.array(line)).alias("out"))

    starts = top.select("key", F.col("no").alias("up"), F.lit(RATE_START).alias("start"))
    for lists in reversed(levels):
        begun = F.struct(F.col("start").alias("rate"), F.array().cast("array<struct<no:bigint,start:double,rate:double>>").alias("out"))
        rates = lists.join(starts, ["key", "up"]).select(
            "key", F.explode(F.aggregate("parts", begun, walk).out).alias("r")).select("key", "r.no", "r.start", "r.rate")
        starts = rates.select("key", F.col("no").alias("up"), "start")
    periods = numbered.select("key", F.col("x.period").alias("period"), "no")
    return periods.join(rates.select("key", "no", "rate"), ["key", "no"]).select("key", "period", "rate")
