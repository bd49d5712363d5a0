"""WARC archives with an index: write records, select from the index, read byte ranges.

Every record is a gzip member of its own. Writing gives the index (file, offset,
length, URL, digest per record); only files of tasks that succeeded are in it.
Reading sorts the selected entries by file and offset, joins those that lie close
together to one range, and fetches each range with one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from batchloom.session import stage

FILE_BYTES = 1 << 30
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: consecutive bytes of one file that a task reads
SPAN_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_RECORD = pa.schema([
    ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([
    ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_SQL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record, a revisit if ``refers_to`` names the page that holds its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<{_ID}{quote(page_id or '', safe='')}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{_ID}{quote(refers_to, safe='')}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, headers by lower-case name, and what follows."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(data: bytes) -> dict:
    """The fields of an uncompressed record; payload is None for revisits."""
    version, head, rest = _headers(data)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[:int(head["content-length"])]
    _, http, payload = _headers(block)
    named = [unquote(head[k][1 + len(_ID):-1]) if k in head else None for k in ("warc-record-id", "warc-refers-to")]
    revisit = head["warc-type"] == "revisit"
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != stated:
        raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    uri = head.get("warc-target-uri")
    return {
        "page_id": named[0] or None, "url": uri, "record_type": head["warc-type"], "refers_to": named[1],
        "payload_digest": stated, "payload_bytes": int(http["content-length"]) if revisit else len(payload),
        "payload": None if revisit else payload}


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Columns page_id, url (as text), payload, refers_to: null, or the page whose payload it repeats.

    Of equal payloads of at least ``least`` bytes the smallest page_id responds;
    rows that repeat this id respond as well. Rows without id refer to it; if no
    row of a payload has an id, all respond. A null html is an empty payload.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("__id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn(
        "__sha", F.sha1("payload"))
    firsts = rows.filter(F.octet_length("payload") >= least).groupBy("__sha").agg(
        F.min("__id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").select("__sha", "__first")
    revisit = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    return rows.join(firsts, "__sha", "left").select(
        F.col("__id").cast("string").alias("page_id"), "url", "payload",
        F.when(revisit, F.col("__first").cast("string")).alias("refers_to"))


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``rows`` (of ``with_revisits``) to archives in ``folder``, a URI that all executors reach; gives the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = gzip.compress(record(page_id, url, payload, refers_to), 4, mtime=0)
                    out.write(data)
                    made.append((page_id, url, "response" if refers_to is None else "revisit", refers_to, digest(payload), len(payload), name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _RECORD)] if made else [
                    pa.array([], f.type) for f in _RECORD], schema=_RECORD)
        finally:
            if out is not None:
                out.close()

    return stage(rows.mapInArrow(run, _ddl(_RECORD)))


def _ranges(entries: Iterable[tuple[str, int, int]], most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted entries (file, offset, length) in groups that one read fetches."""
    now: list[tuple[str, int, int]] = []
    for entry in entries:
        if now and (entry[0] != now[0][0] or entry[1] - (now[-1][1] + now[-1][2]) > gap or entry[1] + entry[2] - now[0][1] > most):
            yield now
            now = []
        now.append(entry)
    if now:
        yield now


def read(selected: DataFrame, folder: str) -> DataFrame:
    """The records of index entries; a payload that belies its digest raises."""
    places = selected.select("file", "offset", "length", F.floor(F.col("offset") / SPAN_BYTES).alias("span"))
    # a fixed number: the rows are few bytes, the ranges that they stand for are not
    tasks = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_places = places.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset").drop("span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        entries = (e for b in batches for e in zip(*(c.to_pylist() for c in b.columns)))
        for group in _ranges(entries):
            if group[0][0] != name:
                if source is not None:
                    source.close()
                name = group[0][0]
                source = store.open_input_file(f"{root}/{name}")
            start = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - start, start)
            found = [parse(gzip.decompress(data[at - start:at - start + n])) for _, at, n in group]
            yield pa.RecordBatch.from_pylist(found, schema=_READ)
        if source is not None:
            source.close()

    return sorted_places.mapInArrow(run, _ddl(_READ))
