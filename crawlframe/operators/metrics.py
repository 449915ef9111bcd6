"""Timings, gauges and benchmark summaries as aggregates and event sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stage_timing(events: DataFrame, stage: str, value: str) -> DataFrame:
    return events.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def gauges(events: DataFrame, *keys: str, at: str = "ts_ns", delta: str = "delta") -> DataFrame:
    """keys, peak, integral, current of a gauge that steps by ``delta`` at ``at``; steps at one time count together."""
    steps = events.groupBy(*keys, at).agg(F.sum(delta).alias("step"))
    w = Window.partitionBy(*keys).orderBy(at)
    swept = steps.withColumn("active", F.sum("step").over(w)).withColumn("next", F.lead(at).over(w))
    return swept.groupBy(*keys).agg(
        F.max("active").alias("peak"), F.sum(F.col("active") * (F.coalesce(F.col("next"), F.col(at)) - F.col(at))).alias("integral"), F.max_by("active", at).alias("current")
    )


def utilization(integrals: DataFrame, elapsed: str, permits: int = 10) -> DataFrame:
    """Share of admitted time: sum of integrals over permits x sum of elapsed times."""
    return integrals.agg((F.sum("integral") / (permits * F.sum(elapsed))).alias("http_utilization"))


def bench_summary(runs: DataFrame, *keys: str, value: str = "elapsed") -> DataFrame:
    """median, least, most and stdev (0 for one run) by keys."""
    return runs.groupBy(*keys).agg(
        F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp(value)), F.lit(0.0)).alias("stdev")
    )


#: What a report names, in this order after elapsed_ns.
STAGES = ("http_admission", "http_transfer", "cpu_admission", "decode", "parse", "publication")
GAUGES = ("http", "cpu", "owned")


def report(timing: DataFrame, gauge: DataFrame, elapsed: DataFrame) -> DataFrame:
    """(node, line): one JSON line a node of elapsed (node, elapsed_ns), with ten keys, whether or not they occurred.

    timing: node and what :func:`stage_timing` gives; gauge: node, gauge and what :func:`gauges` gives.
    """
    of = lambda kind, name, value: F.coalesce(F.max(F.when(F.col(kind) == name, F.col(value))), F.lit(0).cast("decimal(38,0)"))
    long = lambda df, *names: df.withColumns({c: F.col(c).cast("decimal(38,0)") for c in names})
    timed = long(timing, "n", "total", "most").groupBy("node").agg(
        *[F.struct(of("stage", s, "n").alias("count"), of("stage", s, "total").alias("total_ns"), of("stage", s, "most").alias("max_ns")).alias(s) for s in STAGES]
    )
    held = long(gauge, "current", "peak", "integral").groupBy("node").agg(
        *[F.struct(of("gauge", g, "current").alias("active"), of("gauge", g, "peak").alias("peak"), of("gauge", g, "integral").alias("active_ns")).alias(g) for g in GAUGES]
    )
    zero = lambda *names: F.struct(*[F.lit(0).cast("decimal(38,0)").alias(n) for n in names])
    both = elapsed.join(timed, "node", "left").join(held, "node", "left")
    parts = [F.coalesce(s, zero("count", "total_ns", "max_ns")).alias(s) for s in STAGES] + [F.coalesce(g, zero("active", "peak", "active_ns")).alias(g) for g in GAUGES]
    return both.select("node", F.to_json(F.struct("elapsed_ns", *parts)).alias("line"))
