"""Jobs: submission, listing, progress, abort, and who may read final statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import I64_MAX
from ..functions.urls import with_canonical

TERMINAL = ("done", "failed", "aborted")


class InvalidInput(ValueError):
    """Names the 1-based positions of invalid URLs, never the URLs."""


def validate(inputs: DataFrame) -> DataFrame:
    """Inputs (namespace, pos, url) with ``base``; all or nothing."""
    checked = with_canonical(inputs, "url", "base", "url_error")
    first = checked.where("url_error is not null").orderBy("pos").select("pos", "url_error").first()
    if first:
        raise InvalidInput(f"input {first['pos']}: {first['url_error']}")
    return checked.drop("url_error")


def submit(existing: DataFrame, inputs: DataFrame) -> DataFrame:
    """namespace, pos, base, job_id, created by input (namespace, pos, base); existing: namespace, base, job_id.

    A base has one job for ever. New ids follow the largest of their namespace in the order of first inputs.
    """
    first = inputs.groupBy("namespace", "base").agg(F.min("pos").alias("first"))
    known = existing.select("namespace", "base", F.col("job_id").alias("old"))
    most = existing.groupBy("namespace").agg(F.max("job_id").alias("most"))
    new = first.join(known, ["namespace", "base"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("namespace").orderBy("first")))
    ids = new.join(most, "namespace", "left").select("namespace", "base", "first", (F.coalesce("most", F.lit(0)).cast("decimal(20,0)") + F.col("k")).alias("made"))
    ids = ids.select("namespace", "base", "first", F.when(F.col("made") <= F.lit(str(I64_MAX)).cast("decimal(20,0)"), F.col("made").cast("long")).alias("made"))
    joined = inputs.join(known, ["namespace", "base"], "left").join(ids, ["namespace", "base"], "left")
    return joined.select("namespace", "pos", "base", F.coalesce("old", "made").alias("job_id"), (F.col("old").isNull() & (F.col("pos") == F.col("first"))).alias("created"))


def submit_text(submitted: DataFrame) -> DataFrame:
    line = F.format_string("job %d  input %d  %s", "job_id", "pos", F.when(F.col("created"), "created").otherwise("existing"))
    return submitted.select("pos", line.alias("line"))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'running'").orderBy("job_id")


def repeated_ids(jobs: DataFrame) -> DataFrame:
    """Ids that occur more than once: a damaged table."""
    return jobs.groupBy("namespace", "job_id").count().where("count > 1")


def rotated(jobs: DataFrame, cursor: int) -> DataFrame:
    """Jobs after ``cursor`` first, then from the start; ``turn`` numbers them from 1."""
    later = F.when(F.col("job_id") > cursor, 0).otherwise(1)
    return jobs.withColumn("turn", F.row_number().over(Window.orderBy(later, "job_id")).cast("long"))


def abort(jobs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``jobs`` after an abort of ``ids`` (job_id), or of all: ``changed`` tells which were running."""
    chosen = F.lit(True)
    if ids is not None:
        jobs = jobs.join(ids.select("job_id", F.lit(True).alias("chosen")).distinct(), "job_id", "left")
        chosen = F.coalesce("chosen", F.lit(False))
    changed = chosen & (F.col("state") == "running")
    out = jobs.withColumn("changed", changed).withColumn("state", F.when(changed, "aborted").otherwise(F.col("state")))
    return out.drop("chosen") if ids is not None else out


def progress(jobs: DataFrame, visits: DataFrame) -> DataFrame:
    """One coherent row a job: discovered, processed, frontier, in_flight, files; visits: job_id, url, done, in_flight, outcome."""
    flying = F.col("in_flight") if "in_flight" in visits.columns else F.lit(False)
    n = visits.groupBy("job_id").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("done")).alias("processed"), F.count_if(~F.col("done") & ~flying).alias("frontier"),
        F.count_if(flying).alias("in_flight"), F.count_if(F.col("done") & (F.col("outcome") == "file")).alias("files"),
    )
    kept = jobs.join(n, "job_id", "left")
    return kept.select("job_id", "base", "state", "failure", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("discovered", "processed", "frontier", "in_flight", "files")])


def preflight(jobs: DataFrame, visits: DataFrame) -> DataFrame:
    """(job_id, rule) for every rule that a job's stored rows break; nothing may be read from or written to such a job.

    jobs: namespace, job_id, base, state, failure; visits: job_id, url, done, in_flight (optional), outcome, words.
    """
    flying = F.col("in_flight") if "in_flight" in visits.columns else F.lit(False)
    twice = visits.groupBy("job_id", "url").count().groupBy("job_id").agg(F.max("count").alias("times"))
    mine = progress(jobs, visits.withColumn("in_flight", flying)).join(twice, "job_id", "left")
    ids = jobs.groupBy("job_id").agg(F.count("*").alias("rows"))
    legal = "state IN ('running', 'done', 'aborted') AND failure = '' OR state = 'failed' AND failure IN ('fetch', 'statistics', 'protocol')"
    rules = {
        "id repeated": "rows > 1", "base": "coalesce(base, '') = ''", "state": f"NOT coalesce({legal}, false)", "URL repeated": "times > 1", "nothing discovered": "discovered = 0",
        "partition": "discovered <> processed + frontier + in_flight", "done with work": "state = 'done' AND frontier + in_flight > 0", "running without work": "state = 'running' AND frontier + in_flight = 0",
    }
    named = F.array_compact(F.array(*[F.when(F.expr(holds), F.lit(rule)) for rule, holds in rules.items()]))
    return mine.join(ids, "job_id").select("job_id", F.explode(named).alias("rule")).distinct()


def progress_text(snapshot: DataFrame) -> DataFrame:
    state = F.when(F.col("state") == "failed", F.concat(F.lit("failed ("), F.col("failure"), F.lit(")"))).otherwise(F.col("state"))
    line = F.format_string("job %d  crawled %d  frontier %d  in flight %d  files %d  discovered %d  %s", "job_id", "processed", "frontier", "in_flight", "files", "discovered", state)
    return snapshot.select("job_id", line.alias("line"))


def changes(log: DataFrame) -> DataFrame:
    """Rows of a progress log (job_id, seq, fields) that differ from the row before: what a follower prints."""
    fields = F.struct(*[c for c in log.columns if c not in ("job_id", "seq")])
    before = F.lag(fields).over(Window.partitionBy("job_id").orderBy("seq"))
    return log.withColumn("new", before.isNull() | ~fields.eqNullSafe(before)).where("new").drop("new")


def readable(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, answer: ok for done jobs, else the reason why final statistics can't be read."""
    state: Column = F.col("state")
    answer = F.when(state.isNull(), "UnknownJob").when(state == "done", "ok").when(state == "failed", "JobFailed").when(state == "aborted", "JobAborted").otherwise("NotFinished")
    return asked.join(jobs.select("job_id", "state"), "job_id", "left").select("job_id", answer.alias("answer"))


def worker_names(last: int, n: DataFrame) -> DataFrame:
    """``node-N`` for each row of ``n`` (pos), after ``last``."""
    return n.select("pos", F.concat(F.lit("node-"), (F.lit(last) + F.row_number().over(Window.orderBy("pos"))).cast("string")).alias("worker"))
