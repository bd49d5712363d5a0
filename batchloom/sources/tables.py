"""Stored tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def scan_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet under ``path``; the declared schema spares the footer merge."""
    return spark.read.schema(schema).parquet(path)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, parts: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read in ``parts`` ranges of ``column``."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts,
        properties=properties or {},
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring ``df`` to a declared schema: cast what is there, null what is not."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
