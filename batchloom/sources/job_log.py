"""Job records kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchloom.schemas import JOBS


def decode_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed job rows: ISO texts become timestamps, batch and chunk come out of the payload."""
    j = F.from_json(F.col(column), JOBS)
    rows = lines.select(j.alias("j")).select("j.*")
    times = {c: F.try_to_timestamp(F.col(c)) for c in ("created_at", "started_at", "completed_at")}
    return (
        rows.filter(F.col("job_id").isNotNull())
        .withColumns(times)
        .withColumn("batch_id", F.get_json_object("payload", "$.batch_id"))
        .withColumn("chunk_id", F.get_json_object("payload", "$.chunk_id"))
        .withColumn("url_count", F.size(F.from_json(F.get_json_object("payload", "$.urls"), "array<string>")))
    )


def scan_job_log(spark: SparkSession, path: str) -> DataFrame:
    return decode_jobs(spark.read.text(path))
