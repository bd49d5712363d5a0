"""The data model laid over the given tables.

The catalogue's queries need batches, chunks, results, jobs and a cache. These
are derived from ``events``, ``customer`` and ``documents`` as a whole. Each view
is defined twice, as DataFrame for Spark and as SQL text for the comparison.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchloom.operators.ordering import number_rows

AS_OF = "2024-01-31 00:00:00"
CHUNK = 10

_SQL = {
    "f_urls": """
SELECT event_id AS seq, user_id AS batch_id,
 CASE event_id % 13 WHEN 0 THEN 'ftp://img.example.com/' || CAST(event_id AS STRING) WHEN 1 THEN 'HTTP://img.example.com/' || CAST(event_id AS STRING) WHEN 2 THEN '' WHEN 3 THEN '  ' WHEN 4 THEN CAST(NULL AS STRING)
  WHEN 5 THEN '  https://img.example.com/' || CAST(event_id % 900 AS STRING) || '.jpg ' ELSE 'https://img.example.com/' || CAST(event_id % 900 AS STRING) || '.jpg' END AS url,
 CASE WHEN event_id % 2 = 0 THEN 'http://alt.example.com/' || CAST(event_id % 700 AS STRING) ELSE CAST(NULL AS STRING) END AS image_url
FROM events""",
    "f_results": """
SELECT event_id AS result_id, user_id AS batch_id,
 'https://img.example.com/' || CAST(event_id % 4000 AS STRING) || '.jpg' AS url,
 event_type <> 'error' AS success,
 CASE WHEN event_type = 'purchase' THEN true WHEN event_type IN ('view','click') THEN false ELSE CAST(NULL AS BOOLEAN) END AS store_image,
 CASE WHEN event_type = 'purchase' THEN 'Store ' || CAST(event_id % 50 AS STRING) ELSE CAST(NULL AS STRING) END AS store_name,
 CASE event_id % 9 WHEN 0 THEN 'Phone: 555-123-' || LPAD(CAST(event_id % 10000 AS STRING), 4, '0')
  WHEN 1 THEN '55' || LPAD(CAST(event_id AS STRING), 8, '0') WHEN 2 THEN '+1 (555) 010-' || LPAD(CAST(event_id % 10000 AS STRING), 4, '0')
  WHEN 3 THEN 'N/A' WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS STRING) WHEN 6 THEN 'Order id 55' || LPAD(CAST(event_id AS STRING), 8, '0')
  WHEN 7 THEN '0123456789' ELSE 'www.shop.example.com' END AS business_contact,
 CASE WHEN event_type <> 'error' THEN CAST(NULL AS STRING) WHEN event_id % 11 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 3 = 0 THEN 'Connection timeout: host ' || CAST(event_id % 5 AS STRING)
  WHEN event_id % 3 = 1 THEN 'API key not valid: rotate' ELSE 'Failed to download image' END AS error_message,
 CASE WHEN event_id % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE value END AS processing_time_seconds,
 CASE WHEN event_type <> 'error' THEN REPEAT('abc,"d" ', CAST(event_id % 80 AS INT)) ELSE CAST(NULL AS STRING) END AS text_content,
 event_id % 4 = 0 AS cache_hit, ts AS created_at
FROM events""",
    "f_results_c": """
SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY created_at, result_id) - 1) / 10) AS INT) + 1 AS chunk_number
FROM f_results""",
    "f_chunks": """
SELECT batch_id, chunk_number, batch_id * 1000000000 + chunk_number AS chunk_id, n AS url_count,
 CASE WHEN m < 2 THEN 0 ELSE n END AS processed_count, CASE WHEN m < 2 THEN 0 ELSE ok END AS successful_count, CASE WHEN m < 2 THEN 0 ELSE n - ok END AS failed_count,
 CASE m WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN m = 2 THEN 'Worker error: slot ' || CAST(chunk_number AS STRING) ELSE CAST(NULL AS STRING) END AS error_message,
 CASE WHEN m > 0 THEN t0 ELSE CAST(NULL AS {NTZ}) END AS started_at, CASE WHEN m > 1 THEN t1 ELSE CAST(NULL AS {NTZ}) END AS completed_at
FROM (SELECT batch_id, chunk_number, (batch_id + chunk_number) % 6 AS m, COUNT(*) AS n, CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS ok, MIN(created_at) AS t0, MAX(created_at) AS t1
      FROM f_results_c GROUP BY batch_id, chunk_number) t""",
    "f_batches": """
SELECT c.c_custkey AS batch_id, 'Batch #' || CAST(c.c_custkey AS STRING) || ' (' || c.c_mktsegment || ')' AS batch_name,
 CASE c.c_custkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN 'paused' WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' ELSE 'cancelled' END AS status,
 CASE c.c_custkey % 14 WHEN 6 THEN 'Soft deleted on 2024-01-20 00:00:00 (retention: 30 days)' WHEN 5 THEN 'Worker error: lost' ELSE CAST(NULL AS STRING) END AS error_message,
 CAST(TIMESTAMP '2024-01-01 00:00:00' AS {NTZ}) + (c.c_custkey % 700) * INTERVAL '1' HOUR AS created_at,
 CASE WHEN c.c_custkey % 7 = 0 THEN CAST(NULL AS {NTZ}) ELSE CAST(TIMESTAMP '2024-01-01 00:05:00' AS {NTZ}) + (c.c_custkey % 700) * INTERVAL '1' HOUR END AS started_at,
 COALESCE(r.n, 0) + c.c_custkey % 3 AS total_urls, COALESCE(k.chunks, 0) AS total_chunks,
 COALESCE(r.n, 0) AS processed_count, COALESCE(r.ok, 0) AS successful_count, COALESCE(r.n, 0) - COALESCE(r.ok, 0) AS failed_count
FROM customer c
LEFT JOIN (SELECT batch_id, COUNT(*) AS n, CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM f_results GROUP BY batch_id) r ON c.c_custkey = r.batch_id
LEFT JOIN (SELECT batch_id, COUNT(*) AS chunks FROM f_chunks GROUP BY batch_id) k ON c.c_custkey = k.batch_id""",
    "f_jobs": """
SELECT event_id AS job_id, CASE WHEN event_type = 'signup' THEN 'finalize_batch' WHEN event_type = 'view' THEN 'process_chunk' ELSE 'chunk_processing' END AS job_type,
 CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'retrying' ELSE 'cancelled' END AS status,
 CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS priority, CAST(event_id % 4 AS INT) AS retry_count, 3 AS max_retries, user_id AS batch_id, 'worker-' || CAST(event_id % 5 + 1 AS STRING) AS worker_id, ts AS created_at
FROM events""",
    "f_cache": """
SELECT 'https://img.example.com/' || CAST(k AS STRING) || '.jpg' AS url, md5('https://img.example.com/' || CAST(k AS STRING) || '.jpg') AS url_hash, n AS access_count, t0 AS created_at, t1 AS accessed_at,
 CASE WHEN k % 7 = 0 THEN '{"store_image": tr' ELSE '{"store_image": true, "store_name": "Cached ' || CAST(k AS STRING) || '"}' END AS analysis_data
FROM (SELECT event_id % 4000 AS k, COUNT(*) AS n, MIN(ts) AS t0, MAX(ts) AS t1 FROM events GROUP BY event_id % 4000) t WHERE k % 3 = 0""",
    "f_responses": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '```json' || j || '```' WHEN 1 THEN j WHEN 2 THEN 'not json: ' || text WHEN 3 THEN '{"store_image": "yes", "store_name": "S"}' WHEN 4 THEN '[1, 2]' ELSE '' END AS response_text
FROM (SELECT doc_id, text, '{"store_image": true, "text_content": "t' || CAST(doc_id AS STRING) || '", "store_name": null, "business_contact": "Phone: 555-123-4567", "image_description": "d"}' AS j FROM documents) d""",
    "f_metrics": """
SELECT CAST(h AS {NTZ}) AS ts, requests, errors, response_time,
 CASE EXTRACT(DAY FROM h) % 3 WHEN 0 THEN 85 + requests % 10 WHEN 1 THEN 10 + requests % 15 ELSE 50 END AS cpu_percent,
 CASE WHEN EXTRACT(DAY FROM h) % 3 = 0 THEN EXTRACT(HOUR FROM h) * 10 ELSE requests % 50 END AS queue_size
FROM (SELECT DATE_TRUNC('hour', ts) AS h, COUNT(*) AS requests, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, ROUND(AVG(value), 6) AS response_time
      FROM events GROUP BY DATE_TRUNC('hour', ts)) t""",
    "f_commands": """
SELECT c_custkey AS batch_id, CASE c_nationkey % 5 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' WHEN 2 THEN 'cancel' WHEN 3 THEN 'retry' ELSE 'start' END AS action
FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT CAST(-1 AS BIGINT), 'pause'""",
}

_BASE = {"f_urls": "events", "f_results": "events", "f_jobs": "events", "f_cache": "events",
         "f_responses": "documents", "f_metrics": "events", "f_commands": "customer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, chunked: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view of the data model as DataFrame; results once numbered are kept in ``chunked`` for other views."""
    chunked = {} if chunked is None else chunked
    if name in _BASE:
        source = _BASE[name]
        text = re.sub(rf"\bFROM {source}\b", f"FROM {{{source}}}", _spark_text(name))
        return spark.sql(text, **{source: table(spark, sf_dir, source)})
    if name == "f_results_c":
        if name not in chunked:
            chunked[name] = _in_chunks(view(spark, sf_dir, "f_results"))
        # columns of its own, so that the view can be joined to itself
        return chunked[name].select(*[F.col(c).alias(c) for c in chunked[name].columns])
    if name == "f_chunks":
        if name not in chunked:
            narrow = view(spark, sf_dir, "f_results").select("result_id", "batch_id", "success", "created_at")
            chunked[name] = _in_chunks(narrow)
        return spark.sql(_spark_text(name).replace("FROM f_results_c", "FROM {r}"), r=chunked[name])
    if name == "f_batches":
        text = _spark_text(name).replace("FROM customer", "FROM {c}")
        text = text.replace("FROM f_results", "FROM {r}").replace("FROM f_chunks", "FROM {k}")
        return spark.sql(text, c=table(spark, sf_dir, "customer"), r=view(spark, sf_dir, "f_results"),
                         k=view(spark, sf_dir, "f_chunks", chunked))
    raise KeyError(name)


def _in_chunks(results: DataFrame) -> DataFrame:
    """``results`` with chunk_number, numbered in ranges of bounded size whatever the density of a batch or an hour."""
    order = [F.col("created_at").asc(), F.col("result_id").asc()]
    number = F.floor((F.col("n") - 1) / CHUNK).cast("int") + 1
    return number_rows(results, ["batch_id"], order, "n").withColumn("chunk_number", number).drop("n")


def _spark_text(name: str) -> str:
    # braces of JSON texts have to be doubled where Spark looks for parameters
    text = _SQL[name].replace("{NTZ}", "TIMESTAMP_NTZ")
    return text.replace("{", "{{").replace("}", "}}")


def with_views(sql: str) -> str:
    """Put the views that ``sql`` uses in front of it."""
    def uses(text: str) -> set[str]:
        return {n for n in re.findall(r"\bf_\w+", text) if n in _SQL}

    wanted, todo = set(), uses(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= uses(_SQL[name]) - {name}
    parts = [f"{n} AS ({_SQL[n].replace('{NTZ}', 'TIMESTAMP').strip()})" for n in _SQL if n in wanted]
    if not parts:
        return sql.strip()
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(parts) + "\n" + body
