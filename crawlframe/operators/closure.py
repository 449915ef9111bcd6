"""The recursive part: all URLs that each job reaches, level by level, for all jobs at once.

Semi-naive: only the newest level is joined with the outcomes; its links, filtered by scope and made
distinct, lose those already seen by an anti-join. Every level is written to the shared folder, so lineage
stays short and a lost executor costs a reread. Small crawls and large ones go the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.store import scratch_path
from .outcomes import failure_column


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, roots: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(job_id, node, level): least fixpoint over edges (src, dst) from roots (job_id, node), levels from 0."""
    level = 0
    frontier = _written(roots.select("job_id", "node").distinct().withColumn("level", F.lit(0)), "level")
    seen = frontier
    while not frontier.isEmpty() and (max_levels is None or level < max_levels):
        level += 1
        near = frontier.join(edges, frontier["node"] == edges["src"]).select("job_id", F.col("dst").alias("node")).distinct()
        new = near.join(seen.select("job_id", "node"), ["job_id", "node"], "left_anti").withColumn("level", F.lit(level))
        frontier = _written(new, "level")
        seen = seen.unionByName(frontier)
        if level % 16 == 0:  # many small levels: keep the plan short
            seen = _written(seen, "seen")
    return seen


VISITS = "job_id long, url string, level int, parent string, pos int, outcome string, words long, ext string, error string, error_status int, done boolean"
_VISIT_COLUMNS = [f.split()[0] for f in VISITS.split(", ")]
_ROUND = "job_id long, base string, url string, level int, parent string, pos int, path array<int>, outcome string, words long, ext string, links array<string>, error string, error_status int"
_ROUND_COLUMNS = [f.split()[0] for f in _ROUND.split(", ")]
_SEEN = "job_id long, url string"
#: Folders of known URLs that a round reads before they are written as one; more would be listed by a job of their own.
_FOLDERS = 16


def _walk(jobs: list[tuple[int, str]], table: dict[str, dict]) -> tuple[list[tuple], list[tuple]]:
    """The same closure over a small table, one job after another: (visits, (job_id, base, error))."""
    visits, ends = [], []
    for job_id, base in jobs:
        home, seen = urls.parse(base), {base}
        level, now, error = 0, [(base, None, 0)], None
        while now and error is None:
            got = [(url, parent, pos, table.get(url, {"outcome": "no-file"})) for url, parent, pos in now]
            error = next((o["error"] for _, _, _, o in got if o.get("error")), None)
            later = []
            for url, parent, pos, o in got:
                visits.append((job_id, url, level, parent, pos, o.get("outcome"), o.get("words"), o.get("ext"), o.get("error"), o.get("error_status"), error is None))
                for k, child in enumerate((o.get("links") or []) if error is None else []):
                    if child not in seen and child.startswith(base) and urls.in_scope(urls.parse(child), home):
                        seen.add(child)
                        later.append((child, url, k))
            now, level = later, level + 1
        ends.append((job_id, base, error))
    return visits, ends


def crawl(jobs: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visits, states) of jobs (job_id, base), over outcomes as ``classify`` makes them, one a URL.

    visits: job_id, url, level, parent, pos, outcome, words, ext, error, error_status, done. A URL without an
    outcome is absent: processed, no file. A URL outside its job's scope, which only a base that isn't
    canonical can be, is an error. If a level of a job holds an error, levels before it are published, that
    level stays as the frontier, and the first failing URL in breadth-first order names the failure.
    states: job_id, base, state (done or failed), failure.

    A round writes one level of all jobs, with outcomes and links, and counts its rows while it writes them; those
    counts are all that goes to the driver. Breadth-first order is the order of ``path``, the places of the links
    that led to a URL: within a level paths have one length, so no task has to number a level. Rounds differ in
    nothing but the folders they read, so their generated code is compiled once.
    """
    spark = jobs.sparkSession
    outcomes = _written(outcomes.dropDuplicates(["url"]), "outcomes")
    known = jobs.select("job_id", "base")
    new = known.select("job_id", "base", F.col("base").alias("url"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("path"))
    rounds, seen = [], []  # folders: of each level; of all URLs so far, in fewer of them
    while True:
        hit = new.join(outcomes, "url", "left")
        if not rounds:
            hit = hit.withColumn("error", F.when(~urls.in_scope_column(F.col("url"), F.col("base")), "PageOutsideScope").otherwise(F.col("error")))
        hit = hit.withColumns({"level": F.size("path"), "outcome": F.when(F.col("error").isNull(), F.coalesce("outcome", F.lit("no-file")))})
        place, size = scratch_path(spark, "round"), Observation()
        hit = hit.select(*_ROUND_COLUMNS).observe(size, F.count(F.lit(1)).alias("rows"), F.count("error").alias("errors"))
        hit.write.parquet(place)
        rounds.append(place)
        if not size.get["rows"]:
            break
        seen.append(place)
        if len(seen) > _FOLDERS:
            place = scratch_path(spark, "seen")
            spark.read.schema(_SEEN).parquet(*seen).write.parquet(place)
            seen = [place]
        hit = spark.read.schema(_ROUND).parquet(rounds[-1])
        if size.get["errors"]:
            hit = hit.join(hit.where("error is not null").select("job_id").distinct(), "job_id", "left_anti")
        links = hit.select("job_id", "base", F.col("url").alias("parent"), "path", F.posexplode("links").alias("pos", "url"))
        inside = links.where(urls.in_scope_column(F.col("url"), F.col("base")))
        first = inside.groupBy("job_id", "url").agg(F.first("base").alias("base"), F.min(F.struct("path", "pos", "parent")).alias("f"))
        new = first.join(spark.read.schema(_SEEN).parquet(*seen), ["job_id", "url"], "left_anti")
        new = new.select("job_id", "base", "url", F.col("f.parent").alias("parent"), F.col("f.pos").alias("pos"), F.concat("f.path", F.array("f.pos")).alias("path"))
    visits = spark.read.schema(_ROUND).parquet(*rounds)
    ends = visits.where("error is not null").groupBy("job_id").agg(F.min_by("error", F.struct("level", "path")).alias("why"), F.min("level").alias("stop"))
    ends = _written(ends, "ends")
    visits = visits.join(ends, "job_id", "left").withColumn("done", F.col("stop").isNull() | (F.col("level") < F.col("stop"))).select(*_VISIT_COLUMNS)
    return visits, _states(known.join(ends.withColumnRenamed("why", "error"), "job_id", "left").select("job_id", "base", "error"))


def crawl_on_driver(jobs: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What :func:`crawl` gives, walked on the driver: for tables that fit there, and to test the other against."""
    spark = jobs.sparkSession
    table = {r["url"]: r.asDict() for r in outcomes.dropDuplicates(["url"]).collect()}
    visits, ends = _walk([(r["job_id"], r["base"]) for r in jobs.select("job_id", "base").collect()], table)
    return spark.createDataFrame(visits, VISITS), _states(spark.createDataFrame(ends, "job_id long, base string, error string"))


def _states(ended: DataFrame) -> DataFrame:
    return ended.select("job_id", "base", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), failure_column("error").alias("failure"))
