"""Canonical decimals, identifiers and exact unsigned sums as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = 18_446_744_073_709_551_615
I64_MAX = 9_223_372_036_854_775_807


def canonical_decimal(text: Column, most: int = U64_MAX) -> Column:
    """The number of a decimal without sign, spaces or leading zeros, up to ``most``; null for any other text."""
    value = F.when(text.rlike(r"\A(0|[1-9][0-9]{0,37})\z"), text).try_cast("decimal(38,0)")
    return F.when(value <= F.lit(str(most)).cast("decimal(38,0)"), value)


def job_id(text: Column) -> Column:
    value = canonical_decimal(text, I64_MAX)
    return F.when(value >= 1, value.cast("long"))


def is_worker_id(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9_-]{1,128}\z")


def is_namespace(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9:_-]{1,128}\z")


def exact_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def overflows(total: Column, most: int = U64_MAX) -> Column:
    return total > F.lit(str(most)).cast("decimal(38,0)")
