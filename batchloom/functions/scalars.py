"""Column functions of the data model. All are plain expressions, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from batchloom import schemas
from batchloom.functions.timing import add_seconds, minutes_between

# Bytes per exported row, polling intervals in seconds.
BYTES_PER_ROW = {"csv": 200, "json": 400, "xlsx": 150}
IDLE_POLL = 30

# Characters that count as blank at the ends of a text.
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"


def strip(text: Column) -> Column:
    """Remove blanks of any kind, tabs and line ends included, from both ends."""
    return F.regexp_replace(text, rf"^{_BLANK}|{_BLANK}$", "")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty; blanks count as filled."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def url_valid(url: Column) -> Column:
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def url_sha256(url: Column) -> Column:
    return F.sha2(url, 256)


def url_md5(url: Column) -> Column:
    return F.md5(url)


def share_pct(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; 0 when there is nothing to divide by."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def is_active(status: Column) -> Column:
    return status.isin(schemas.ACTIVE)


def is_complete(status: Column) -> Column:
    return status.isin(schemas.DONE)


def yes_no(flag: Column, yes: str = "Yes", no: str = "No") -> Column:
    return F.when(flag, F.lit(yes)).otherwise(F.lit(no))


def blank_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def zero_null(number: Column) -> Column:
    return F.coalesce(number, F.lit(0.0))


def zero_blank(number: Column) -> Column:
    """Text of a number, where null and zero give an empty text."""
    return F.when(number != 0, number.cast("string")).otherwise(F.lit(""))


def truncate_text(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def error_class(message: Column) -> Column:
    """The part of an error message before its first colon."""
    return F.substring_index(message, ":", 1)


def default_batch_name(name: Column, as_of: Column) -> Column:
    return F.coalesce(
        F.nullif(name, F.lit("")), F.concat(F.lit("Batch_"), F.date_format(as_of, "yyyyMMdd_HHmmss"))
    )


def chunk_count(total: Column, size: int | Column = schemas.CHUNK_SIZE) -> Column:
    return F.ceil(total / size)


def size_estimate_mb(rows: Column, fmt: str) -> Column:
    return F.round(rows * BYTES_PER_ROW[fmt] / (1024 * 1024), 2)


def elapsed_minutes(started_at: Column, as_of: Column) -> Column:
    return F.coalesce(minutes_between(started_at, as_of), F.lit(0.0))


def processing_rate(processed: Column, started_at: Column, as_of: Column) -> Column:
    """Items per minute; 0 when not started, nothing processed, or under a minute old."""
    minutes = minutes_between(started_at, as_of)
    return F.when((processed != 0) & (minutes >= 1), processed / minutes).otherwise(F.lit(0.0))


def remaining_minutes(total: Column, processed: Column, rate: Column) -> Column:
    return F.when(rate > 0, (total - processed) / rate)


def eta(total: Column, processed: Column, rate: Column, as_of: Column) -> Column:
    return add_seconds(as_of, remaining_minutes(total, processed, rate) * 60)


def avg_seconds_per_url(processed: Column, minutes: Column) -> Column:
    return F.when((processed > 0) & (minutes > 0), minutes * 60 / processed).otherwise(F.lit(0.0))


def estimate_hours(total: Column, key_count: int, per_key_rate: bool = True) -> Column:
    """Hours for ``total`` items at 60 per minute.

    ``per_key_rate`` divides the hourly rate by the number of keys, so that more
    keys give a longer estimate; pass False to multiply instead.
    """
    hourly = 3600.0 / key_count if per_key_rate else 3600.0 * key_count
    return total / F.lit(hourly)


def poll_interval(progress: Column, active: Column) -> Column:
    """Seconds to wait before asking again."""
    return (
        F.when(~active, IDLE_POLL).when(progress < 10, 5).when(progress < 50, 10).when(progress < 90, 15).otherwise(5)
    )


def resize_dims(width: Column, height: Column, limit: int = schemas.IMAGE_MAX_SIDE) -> Column:
    """Target width and height as a struct; sides shrink only above ``limit``."""
    longest = F.greatest(width, height)
    ratio = F.lit(float(limit)) / longest
    return F.struct(
        F.when(longest > limit, (width * ratio).cast("int")).otherwise(width.cast("int")).alias("width"),
        F.when(longest > limit, (height * ratio).cast("int")).otherwise(height.cast("int")).alias("height"),
    )


def retry_delay(retry_count: Column) -> Column:
    """Seconds until the next attempt, for the count after the failure was added."""
    # beyond 2^3 the cap holds anyway; least() keeps the power from overflowing
    return F.least(F.lit(300), F.lit(60) * F.pow(F.lit(2), F.least(retry_count, F.lit(10)))).cast("int")


def assign_key(position: Column, key_count: int) -> Column:
    """Index of the key for the item at 1-based ``position``, dealt in turn."""
    return F.pmod(position - 1, F.lit(key_count)).cast("int")


def current_chunk(completed: Column, processing: Column) -> Column:
    return F.when(completed > 0, completed).when(processing > 0, F.lit(1)).otherwise(F.lit(0))


def has_contact(contact: Column) -> Column:
    return F.coalesce(contact, F.lit("")) != ""


def payload_problem(batch_id: Column, chunk_id: Column, url_count: Column) -> Column:
    """Name of the first missing part of a job, or null when the job can run."""
    def missing(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("")) == ""

    return (
        F.when(missing(batch_id), F.lit("batch_id"))
        .when(missing(chunk_id), F.lit("chunk_id"))
        .when(F.coalesce(url_count, F.lit(0)) <= 0, F.lit("urls"))
    )
