"""Exact statistics of crawls: files, extensions and words per job, merges, invariants, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum, overflows


def per_extension(visits: DataFrame, *keys: str) -> DataFrame:
    """(keys, ext, n, words) of published files."""
    files = visits.where("outcome = 'file' and done") if "done" in visits.columns else visits.where("outcome = 'file'")
    return files.groupBy(*keys, "ext").agg(F.count("*").alias("n"), exact_sum(F.col("words")).alias("words"))


def web_stats(visits: DataFrame, *keys: str) -> DataFrame:
    """(keys, num_files, num_exts, ext_counts, total_word_count, overflow); two levels, partial sums first."""
    each = per_extension(visits, *keys)
    return each.groupBy(*keys).agg(
        F.sum("n").alias("num_files"), F.count("*").alias("num_exts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("ext_counts"),
        exact_sum(F.col("words")).alias("total_word_count"), overflows(exact_sum(F.col("words"))).alias("overflow"),
    )


def job_stats(visits: DataFrame, states: DataFrame) -> DataFrame:
    """Final statistics of jobs that are done; a job without files has empty ones. Other jobs have none."""
    total = web_stats(visits, "job_id")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c)
    kept = states.where("state = 'done'").select("job_id").join(total, "job_id", "left")
    counts = F.coalesce("ext_counts", F.create_map().cast("map<string,bigint>")).alias("ext_counts")
    return kept.select("job_id", zero("num_files", "long"), zero("num_exts", "long"), counts, zero("total_word_count", "decimal(38,0)")).where(~overflows(F.col("total_word_count")))


def settled(visits: DataFrame, states: DataFrame) -> DataFrame:
    """``states`` (job_id, base, state, failure), in which a job whose statistics overflow has failed for that."""
    over = web_stats(visits, "job_id").where("overflow").select("job_id", "overflow")
    failed = F.coalesce("overflow", F.lit(False)) & (F.col("state") == "done")
    joined = states.join(over, "job_id", "left")
    return joined.withColumn("failure", F.when(failed, "statistics").otherwise(F.col("failure"))).withColumn("state", F.when(failed, "failed").otherwise(F.col("state"))).drop("overflow")


def merge_counts(a: Column, b: Column) -> Column:
    """Sum of two maps of counts by extension."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Merged statistics of partial ones (ext_counts, total_word_count), all or nothing: null fields on overflow."""
    exploded = parts.select(*keys, F.explode("ext_counts").alias("ext", "n"))
    counts = exploded.groupBy(*keys, "ext").agg(exact_sum(F.col("n")).alias("n")).groupBy(*keys).agg(
        exact_sum(F.col("n")).alias("num_files"), F.count("*").alias("num_exts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("ext_counts")
    )
    words = parts.groupBy(*keys).agg(exact_sum(F.col("total_word_count")).alias("total_word_count"))
    both = words.join(counts, list(keys), "left")
    bad = overflows(F.col("total_word_count")) | F.coalesce(overflows(F.col("num_files")), F.lit(False))
    return both.select(*keys, *[F.when(~bad, F.col(c)).alias(c) for c in ("num_files", "num_exts", "ext_counts", "total_word_count")])


def broken_rules(stats: DataFrame) -> DataFrame:
    """``stats`` with ``broken``: names of the invariants that a row breaks."""
    exts, counts = F.map_keys("ext_counts"), F.map_values("ext_counts")
    total = F.aggregate(counts, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    rules = {
        "extension empty": F.exists(exts, lambda e: e == ""),
        "extension not lower case": F.exists(exts, lambda e: e != F.lower(e)),
        "count not positive": F.exists(counts, lambda n: n <= 0),
        "counts do not add up": total != F.col("num_files"),
        "extensions miscounted": F.size("ext_counts") != F.col("num_exts"),
        "words without files": (F.col("num_files") == 0) & (F.col("total_word_count") > 0),
    }
    return stats.withColumn("broken", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))


def stats_text(stats: DataFrame) -> DataFrame:
    """job_id and the printed form, extensions in byte order."""
    head = F.format_string("files: %s   extensions: %s   words: %s", F.col("num_files").cast("string"), F.col("num_exts").cast("string"), F.col("total_word_count").cast("string"))
    lines = F.transform(F.array_sort(F.map_entries("ext_counts")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" "), e["value"].cast("string")))
    return stats.select("job_id", F.array_join(F.concat(F.array(head), lines), "\n").alias("line"))
