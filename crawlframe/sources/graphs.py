"""Generated link graphs with known results, as snapshots: nothing but ranges and format strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "http://bench.example/site/"
#: The five benchmark shapes and their results (files, extensions, words).
BENCHMARKS = {
    "latency": {"leaves": 240, "expected": (241, {"html": 241}, 964)},
    "large": {"leaves": 120, "units": 32_768, "expected": (121, {"html": 121}, 15_728_644)},
    "broad": {"leaves": 400, "expected": (401, {"html": 401}, 1_604)},
    "deep": {"depth": 80, "expected": (81, {"html": 81}, 324)},
    "mixed": {"leaves": 200, "images": True, "expected": (401, {"html": 201, "png": 200}, 804)},
}


def _rows(df: DataFrame, url: Column, body: Column, kind: str = "text/html") -> DataFrame:
    nothing = F.array().cast("array<string>")
    return df.select(
        url.alias("url"), F.lit(200).alias("status"), F.array(F.lit(kind)).alias("content_type"), nothing.alias("content_encoding"),
        F.lit(None).cast("string").alias("location"), body.cast("binary").alias("body"), F.lit(None).cast("string").alias("error"),
    )


def benchmark(spark: SparkSession, case: str) -> DataFrame:
    """The snapshot of one benchmark shape below BASE."""
    spec = BENCHMARKS[case]
    words = "<p>ant bee cat dog</p>"
    if "depth" in spec:
        chain = spark.range(spec["depth"] + 1)
        url = F.when(F.col("id") == 0, BASE).otherwise(F.format_string(BASE + "page-%d.html", "id"))
        link = F.when(F.col("id") < spec["depth"], F.format_string("<a href='" + BASE + "page-%d.html'></a>", F.col("id") + 1)).otherwise("")
        return _rows(chain, url, F.concat(F.lit(words), link))
    leaves = spark.range(1, spec["leaves"] + 1)
    all_links = leaves.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("<a href='leaf-%d.html'></a>", "id"))), "").alias("links"))
    parts = [_rows(all_links, F.lit(BASE), F.concat(F.lit(words), F.col("links")))]
    body = F.lit("<p>" + "ant bee cat dog " * 1 + "</p>") if "units" not in spec else F.concat(F.lit("<p>"), F.repeat(F.lit("ant bee cat dog 1234567890123 "), spec["units"]), F.lit("</p>"))
    if spec.get("images"):
        body = F.concat(body, F.format_string("<img src='image-%d.png'>", "id"))
        parts.append(_rows(leaves, F.format_string(BASE + "image-%d.png", "id"), F.lit("png"), "image/png"))
    parts.append(_rows(leaves, F.format_string(BASE + "leaf-%d.html", "id"), body))
    return reduce(DataFrame.unionByName, parts)


def hierarchy(region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """(src, dst): the foreign keys region, nation, customer and orders as links between paths."""
    edge = lambda df, up, a, down, b: df.select(F.format_string(f"{up}/%d", a).alias("src"), F.format_string(f"{down}/%d", b).alias("dst"))
    return (
        region.select(F.lit("root").alias("src"), F.format_string("region/%d", "r_regionkey").alias("dst"))
        .unionByName(edge(nation, "region", "n_regionkey", "nation", "n_nationkey"))
        .unionByName(edge(customer, "nation", "c_nationkey", "customer", "c_custkey"))
        .unionByName(edge(orders, "customer", "o_custkey", "order", "o_orderkey"))
    )
