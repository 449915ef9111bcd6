"""Commands over a store: submit, node, jobs, status, stats, abort, check. Exit codes 0, 1 (errors), 2 (usage)."""

from __future__ import annotations

import signal
import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import closure, jobs, outcomes, stats
from .sources import live
from .sources.store import Store

JOBS = "namespace string, job_id long, base string, state string, failure string"
Print = Callable[[str], None]


class Commands:
    """The job commands of one namespace. ``snapshot`` gives the responses that ``run`` crawls."""

    def __init__(self, spark: SparkSession, store: Store, namespace: str = "default", out: Print = print):
        self.spark, self.store, self.namespace, self.out = spark, store, namespace, out

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.store.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _jobs(self) -> DataFrame:
        return self._table("jobs", JOBS)

    def _own(self) -> DataFrame:
        return self._jobs().where(F.col("namespace") == self.namespace)

    def submit(self, urls: list[str]) -> int:
        given = self.spark.createDataFrame([(self.namespace, k + 1, u) for k, u in enumerate(urls)], "namespace string, pos int, url string")
        inputs = jobs.validate(given)
        made = jobs.submit(self._jobs().select("namespace", "base", "job_id"), inputs).persist()
        fresh = made.where("created").select("namespace", "job_id", "base", F.lit("running").alias("state"), F.lit("").alias("failure"))
        if not fresh.isEmpty():
            self.store.commit(jobs=self._jobs().unionByName(fresh))
        for row in jobs.submit_text(made).orderBy("pos").toLocalIterator():
            self.out(row["line"])
        return 0

    def run(self, snapshot: DataFrame) -> int:
        """Crawl all running jobs to their ends."""
        mine = self._own().where("state = 'running'").select("job_id", "base")
        visits, states = closure.crawl(mine, outcomes.classify(snapshot))
        ended = stats.settled(visits, states).select("job_id", F.col("state").alias("new"), F.col("failure").alias("why"))
        now = self._jobs().join(ended, "job_id", "left").select("namespace", "job_id", "base", F.coalesce("new", "state").alias("state"), F.coalesce("why", "failure").alias("failure"))
        kept = self.store.read("visits")
        visits = visits.select("job_id", "url", "level", "parent", "pos", "outcome", "words", "ext", "error", "done")
        self.store.commit(jobs=now, visits=visits if kept is None else kept.unionByName(visits))
        return 0

    def node(self, timeout: float = 30.0, pause: float = 0.1, polls: int | None = None) -> int:
        """Crawl live what is submitted, until interrupted (or for ``polls`` looks). An interrupt ends the wait, never
        a crawl: what has begun is finished and written first. Each level's responses are written before they are
        read, and a task fetches up to live.PERMITS URLs at once, which bounds what it owns."""
        stopped: list[int] = []
        before = signal.signal(signal.SIGINT, lambda *_: stopped.append(1)) if threading.current_thread() is threading.main_thread() else None
        try:
            while not stopped and polls != 0:
                polls = polls if polls is None else polls - 1
                mine = self._own().where("state = 'running'").select("job_id", "base")
                if not mine.isEmpty():
                    self.run(live.crawled(self.spark, mine, timeout))
                elif polls != 0:
                    time.sleep(pause)
        finally:
            if before is not None:
                signal.signal(signal.SIGINT, before)
        return 0

    def _visits(self) -> DataFrame:
        """Stored visits of this namespace's jobs; a submitted job that wasn't run yet has its base to visit."""
        visits = self.store.read("visits")
        seeds = self._own().select("job_id", F.col("base").alias("url"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("outcome"))
        if visits is not None:
            mine = visits.join(self._own().select("job_id"), "job_id", "left_semi").select("job_id", "url", "done", "outcome")
            seeds = mine.unionByName(seeds.join(visits.select("job_id").distinct(), "job_id", "left_anti"))
        return seeds

    def _progress(self) -> DataFrame:
        return jobs.progress(self._own(), self._visits())

    def _broken(self, job_id: int | None = None) -> int | None:
        """The smallest id (or ``job_id``, if it is one) of a job whose stored rows break a rule."""
        found = jobs.preflight(self._own(), self._visits())
        found = found if job_id is None else found.where(F.col("job_id") == job_id)
        return found.agg(F.min("job_id").alias("first")).first()["first"]

    def _whole(self, job_id: int) -> None:
        if self._broken(job_id) is not None:
            raise LookupError(f"InvalidStorage: job {job_id}")

    def jobs(self) -> int:
        broken = self._broken()
        rows = jobs.progress_text(self._progress()).where("true" if broken is None else f"job_id < {broken}").orderBy("job_id").toLocalIterator()
        shown = 0
        for shown, row in enumerate(rows, 1):  # noqa: B007
            self.out(row["line"])
        if broken is not None:
            raise LookupError(f"InvalidStorage: job {broken}")
        if not shown:
            self.out("No jobs in this database/namespace.")
        return 0

    def status(self, job_id: int) -> int:
        self._whole(job_id)
        row = self._progress().where(F.col("job_id") == job_id)
        found = jobs.progress_text(row).first()
        if found is None:
            raise LookupError("UnknownJob")
        self.out(found["line"])
        return 1 if row.first()["state"] in ("failed", "aborted") else 0

    def follow(self, job_id: int, pause: float = 0.5) -> int:
        """Print the job's line whenever it changes, until it has ended. Interrupted: 130."""
        last = None
        try:
            while True:
                row = self._progress().where(F.col("job_id") == job_id)
                found = jobs.progress_text(row).join(row.select("job_id", "state"), "job_id").first()
                if found is None:
                    raise LookupError("UnknownJob")
                if found["line"] != last:
                    last = found["line"]
                    self.out(last)
                if found["state"] in jobs.TERMINAL:
                    return 0 if found["state"] == "done" else 1
                time.sleep(pause)
        except KeyboardInterrupt:
            return 130

    def stats(self, job_id: int) -> int:
        answer = jobs.readable(self.spark.createDataFrame([(job_id,)], "job_id long"), self._own()).first()["answer"]
        if answer != "ok":
            raise LookupError(answer)
        self._whole(job_id)
        mine = self._own().where(F.col("job_id") == job_id)
        for row in stats.stats_text(stats.job_stats(self.store.read("visits"), mine)).collect():  # one job
            self.out(row["line"])
        return 0

    def abort(self, job_id: int | None = None) -> int:
        chosen = self._own().where("state = 'running'") if job_id is None else self._own().where(F.col("job_id") == job_id)
        ids = chosen.select("job_id")
        if job_id is not None and ids.isEmpty():
            raise LookupError("UnknownJob")
        after = jobs.abort(self._jobs(), ids).persist()
        done = {r["job_id"]: r["changed"] for r in after.join(ids, "job_id", "left_semi").select("job_id", "changed").orderBy("job_id").toLocalIterator()}
        self.store.commit(jobs=after.drop("changed").select("namespace", "job_id", "base", "state", "failure"))
        for k, changed in done.items():
            self.out(f"job {k}  " + ("aborted" if changed else "unchanged (already terminal)"))
        return 0

    def check(self) -> int:
        self.out("Spark connectivity: OK" if self.store.health() else "Spark connectivity: failed")
        return 0


def main(argv: list[str], commands: Commands) -> int:
    try:
        match argv:
            case ["submit", first, *more]:
                return commands.submit([first, *more])
            case ["jobs"]:
                return commands.jobs()
            case ["status", number]:
                return commands.status(_job(number))
            case ["status", "-f", number] | ["status", number, "-f"]:
                return commands.follow(_job(number))
            case ["stats", number]:
                return commands.stats(_job(number))
            case ["abort", "--all"]:
                return commands.abort()
            case ["abort", number]:
                return commands.abort(_job(number))
            case ["check"]:
                return commands.check()
            case ["node"]:
                return commands.node()
    except (ValueError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print("usage: node | submit URL... | jobs | status [-f] JOB | stats JOB | abort JOB|--all | check", file=sys.stderr)
    return 2


def _job(text: str) -> int:
    if not text.isascii() or not text.isdigit() or text[0] == "0" or int(text) > 9_223_372_036_854_775_807:
        raise ValueError("InvalidJobId")
    return int(text)
