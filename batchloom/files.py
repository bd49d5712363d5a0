"""Small files in any store that Spark reaches: names, one text, removal."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in ``folder``, sorted; none where there is no folder."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file; readers see all of it or none. A file of that name raises."""
    fs, place = _at(spark, path)
    _, half = _at(spark, f"{path}.{uuid.uuid4().hex}.half")
    out = fs.create(half, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(place) or not fs.rename(half, place):
        fs.delete(half, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds."""
    fs, place = _at(spark, path)
    fs.delete(place, True)
