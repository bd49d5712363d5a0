"""Declared table schemas and the fixed values the semantics rest on."""

from __future__ import annotations

from pyspark.sql import types as T

# Life-cycle states.
BATCH_STATUSES = ["pending", "queued", "processing", "paused", "completed", "failed", "cancelled"]
CHUNK_STATUSES = ["pending", "processing", "completed", "failed", "retrying"]
JOB_STATUSES = ["pending", "processing", "completed", "failed", "retrying", "cancelled"]
ACTIVE = ["pending", "queued", "processing"]
DONE = ["completed", "failed", "cancelled"]

# Defaults and limits.
CHUNK_SIZE = 1000
MAX_ACTIVE_BATCHES = 5
MAX_EXPORT_ROWS = 1_000_000
MAX_EXPORT_BATCHES = 10
IMAGE_MAX_SIDE = 2048
INITIAL_CHUNKS = 3
SUB_BATCH = 100
JOB_TTL_SECONDS = 86_400
CACHE_RETENTION_DAYS = 30
JOB_RETENTION_DAYS = 7
MAX_PAGE_ROWS = 1000  # page keys up to here may be broadcast
MAX_RETRIES = 3
REQUEST_TIMEOUT = 30
MAX_LIST_ROWS = 100
URL_COLUMNS = ["url", "URL", "image_url", "link"]
SOFT_DELETE_MARK = "Soft deleted"
CLEANUP_BATCH_MESSAGE = "Cleaned up by admin - stuck for too long"
CLEANUP_CHUNK_MESSAGE = "Batch cleaned up by admin"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, I, L, D, B, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

BATCHES = _struct(
    ("batch_id", S), ("batch_name", S), ("total_urls", I), ("chunk_size", I), ("total_chunks", I),
    ("processed_count", I), ("successful_count", I), ("failed_count", I), ("current_chunk", I),
    ("status", S), ("created_at", TS), ("started_at", TS), ("completed_at", TS), ("paused_at", TS),
    ("estimated_completion", TS), ("processing_rate", D), ("success_rate", D),
    ("original_filename", S), ("file_size_bytes", L), ("processing_config", S),
    ("error_message", S), ("retry_count", I), ("max_retries", I),
)

CHUNKS = _struct(
    ("chunk_id", S), ("batch_id", S), ("chunk_number", I), ("urls", T.ArrayType(S)), ("url_count", I),
    ("processed_count", I), ("successful_count", I), ("failed_count", I), ("status", S),
    ("created_at", TS), ("started_at", TS), ("completed_at", TS), ("processing_time_seconds", D),
    ("average_time_per_url", D), ("worker_id", S), ("failed_urls", S), ("error_message", S),
    ("retry_count", I),
)

RESULTS = _struct(
    ("result_id", S), ("url", S), ("url_hash", S), ("batch_id", S), ("chunk_id", S),
    ("analysis_result", S), ("store_image", B), ("text_content", S), ("store_name", S),
    ("business_contact", S), ("phone_number", B), ("image_description", S), ("success", B),
    ("error_message", S), ("processing_time_seconds", D), ("api_key_used", S), ("created_at", TS),
    ("updated_at", TS), ("cache_hit", B), ("model_used", S),
)

CACHE = _struct(
    ("url_hash", S), ("url", S), ("analysis_data", S), ("created_at", TS), ("accessed_at", TS),
    ("access_count", L),
)

JOBS = _struct(
    ("job_id", S), ("job_type", S), ("payload", S), ("status", S), ("created_at", S), ("started_at", S),
    ("completed_at", S), ("retry_count", I), ("max_retries", I), ("error_message", S),
    ("worker_id", S), ("priority", I),
)

ANALYSIS_FIELDS = ["store_image", "text_content", "store_name", "business_contact", "image_description"]

# What a work function must give back for each item.
OUTCOME = _struct(
    ("url", S), ("success", B), ("analysis", S), ("error", S), ("processing_time", D),
)


def check_status(value: str, allowed: list[str], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {what}: {value!r}; expected one of {', '.join(allowed)}")
    return value
