"""Snapshots of web responses: the table that a crawl reads instead of the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

SNAPSHOT = StructType(
    [
        StructField("url", StringType(), False),
        StructField("status", IntegerType()),
        StructField("content_type", ArrayType(StringType())),
        StructField("content_encoding", ArrayType(StringType())),
        StructField("location", StringType()),
        StructField("body", BinaryType()),
        StructField("error", StringType()),
    ]
)


def response(url: str, status: int = 200, content_type: str | None = "text/html", body: str | bytes = b"", location: str | None = None, encoding: str | None = None, error: str | None = None) -> tuple:
    """One row of a snapshot."""
    data = body.encode() if isinstance(body, str) else body
    return (url, status, [content_type] if content_type is not None else [], [encoding] if encoding else [], location, bytearray(data), error)


def snapshot(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SNAPSHOT)


def from_pages(pages: DataFrame) -> DataFrame:
    """A snapshot in which every row of ``pages`` (url, html) answers 200 with its HTML."""
    empty = F.array().cast("array<string>")
    return pages.select(
        "url", F.lit(200).alias("status"), F.array(F.lit("text/html; charset=utf-8")).alias("content_type"), empty.alias("content_encoding"),
        F.lit(None).cast("string").alias("location"), F.col("html").cast("binary").alias("body"), F.lit(None).cast("string").alias("error"),
    )
