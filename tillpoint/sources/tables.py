"""Table scans (S1/S2), request readers (S4) and sinks.

Scans are plain ``spark.read.parquet``: Catalyst prunes columns and pushes
filters (including partition filters on ``client_id``) into the reader, so
operators select only what they use and never call ``inferSchema``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def table_path(root: str, name: str) -> str:
    single = os.path.join(root, f"{name}.parquet")
    if root.startswith(("s3", "gs:", "abfs", "hdfs")) or os.path.exists(single):
        return single
    return os.path.join(root, name)


_RELATIONS: dict = {}


def _relation(spark: SparkSession, path: str) -> DataFrame:
    """The parquet relation of ``path``, reused within a session while the files are unchanged.

    Building a relation lists files and reads a footer on the driver; queries
    that touch the same table several times share one definition.
    """
    try:
        stamp = os.stat(path).st_mtime_ns
    except OSError:          # remote store: no cheap change test, build afresh
        return spark.read.parquet(path)
    key = (id(spark), path, stamp)
    df = _RELATIONS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _RELATIONS[key] = df
    return df


def read_table(spark: SparkSession, root: str, name: str, columns=None,
               client_id: int | None = None) -> DataFrame:
    """Scan a table; with ``client_id`` the tenant filter prunes partitions."""
    df = _relation(spark, table_path(root, name))
    if client_id is not None and "client_id" in df.columns:
        df = df.filter(F.col("client_id") == F.lit(client_id))
    if columns:
        df = df.select(*columns)
    return df


def read_requests(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON request rows with an explicit schema (no inference)."""
    return spark.read.schema(schema).json(path)


def requests_from_json(df: DataFrame, column: str, schema: StructType) -> DataFrame:
    """Parse a JSON body column into typed fields."""
    return df.withColumn("_body", F.from_json(F.col(column), schema)).select("*", "_body.*").drop("_body")


def to_response(df: DataFrame, name: str = "response") -> DataFrame:
    """Rows as JSON documents (one string column)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def append(df: DataFrame, path: str, partition_by: str | None = "client_id") -> DataFrame:
    """INSERT ... RETURNING: append the rows and hand them back."""
    w = df.write.mode("append")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return df


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
