"""The state machine of a job, folded over its protocol events in order.

Events: job_id, seq, kind (submit, claim, complete, fail, abort), base, url, worker, outcome, words, ext,
children, and optionally namespace. ``Machine`` is one job; the same machine serves batch folds and streams.

A job's URLs are one list in the order of their discovery: the first ``taken`` of them were claimed, the rest
is the queue, and ``owners`` names the worker of each that was claimed and not yet published. What else a
snapshot shows are differences of these, so they can't contradict each other. ANSWERS says, for each kind of
event, which reply the first condition that holds gives; only EFFECTS of a reply change the job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import U64_MAX

REPLIES = "job_id long, seq long, reply string, state string, failure string, discovered long, processed long, frontier long, in_flight long, files long, words string"
KINDS = ("fetch", "statistics", "protocol")


class Machine:
    """State of one job; every method gives the reply of the operation."""

    def __init__(self) -> None:
        self.namespace: str | None = None
        self.base: str | None = None
        self.state, self.failure = "unknown", ""
        self.urls: list[str] = []
        self.seen: set[str] = set()
        self.taken = 0
        self.owners: dict[str, str] = {}
        self.exts: Counter[str] = Counter()
        self.words = 0

    @property
    def processed(self) -> int:
        return self.taken - len(self.owners)

    @property
    def files(self) -> int:
        return self.exts.total()

    def discover(self, url: str) -> None:
        if url not in self.seen:
            self.seen.add(url)
            self.urls.append(url)

    def apply(self, event: dict) -> str:
        kind = event["kind"]
        reply = next((r for r, holds in ANSWERS.get(kind, ()) if holds(self, event)), "invalid")
        if change := EFFECTS.get((kind, reply)):
            change(self, event)
        return {"stopped": self.state, "overflow": "failed", "claimed": f"claimed {self.urls[self.taken - 1] if self.taken else ''}"}.get(reply, reply)

    # one event each, as calls
    def submit(self, base: str) -> str:
        return self.apply({"kind": "submit", "base": base})

    def claim(self, worker: str) -> tuple[str, str | None]:
        reply, _, url = self.apply({"kind": "claim", "worker": worker}).partition(" ")
        return reply, url or None

    def complete(self, base: str | None, url: str, worker: str, outcome: str, words: int, ext: str, children: list[str]) -> str:
        return self.apply({"kind": "complete", "base": base, "url": url, "worker": worker, "outcome": outcome, "words": words, "ext": ext, "children": children})

    def fail(self, url: str, worker: str, kind: str) -> str:
        return self.apply({"kind": "fail", "url": url, "worker": worker, "outcome": kind})

    def abort(self) -> str:
        return self.apply({"kind": "abort"})

    def row(self, job_id: int, seq: int, reply: str) -> tuple:
        return (job_id, seq, reply, self.state, self.failure, len(self.urls), self.processed, len(self.urls) - self.taken, len(self.owners), self.files, str(self.words))


def _words(event: dict) -> int:
    return int(event.get("words") or 0)


def _children(event: dict) -> list[str]:
    found = event.get("children")
    return [] if found is None else list(found)


def _other(field: str) -> Callable[[Machine, dict], bool]:
    """Whether the event names another base or namespace than the job's."""
    return lambda job, event: event.get(field) is not None and getattr(job, field) is not None and event[field] != getattr(job, field)


def _countable(job: Machine, event: dict) -> bool:
    return event["outcome"] == "no-file" or event["outcome"] == "file" and bool(event.get("ext")) and 0 <= _words(event) <= U64_MAX


_none = lambda job, event: job.base is None
_owner = lambda job, event: job.owners.get(event["url"])
#: Who may speak for a URL, in the order in which a publication or a failure is answered.
_SPEAKER = (
    ("unknown", _none),
    ("ownership", _other("namespace")),
    ("invalid", _other("base")),
    ("already", lambda job, event: _owner(job, event) is None and event["url"] in job.seen),
    ("ownership", lambda job, event: _owner(job, event) is None or _owner(job, event) != event["worker"]),
    ("stopped", lambda job, event: job.state in ("aborted", "failed")),
    ("invalid", lambda job, event: job.state != "running"),
)
#: Reply and condition by kind of event; the first that holds answers.
ANSWERS: dict[str, tuple] = {
    "submit": (("existing", lambda job, event: job.base is not None), ("created", lambda job, event: True)),
    "claim": (
        ("idle", lambda job, event: job.state != "running" or job.taken == len(job.urls)),
        ("claimed", lambda job, event: True),
    ),
    "abort": (("unknown", _none), ("unchanged", lambda job, event: job.state != "running"), ("aborted", lambda job, event: True)),
    "fail": (*_SPEAKER, ("failed", lambda job, event: True)),
    "complete": (
        *_SPEAKER,
        ("failed", lambda job, event: event["outcome"] in KINDS),
        ("invalid", lambda job, event: not _countable(job, event)),
        ("overflow", lambda job, event: event["outcome"] == "file" and job.words + _words(event) > U64_MAX),
        ("invalid", lambda job, event: any(not c.startswith(job.base) for c in _children(event))),
        ("published", lambda job, event: True),
    ),
}


def _created(job: Machine, event: dict) -> None:
    job.base, job.namespace, job.state = event["base"], event.get("namespace"), "running"
    job.discover(job.base)


def _claimed(job: Machine, event: dict) -> None:
    job.owners[job.urls[job.taken]] = event["worker"]
    job.taken += 1


def _published(job: Machine, event: dict) -> None:
    if event["outcome"] == "file":
        job.exts[event["ext"]] += 1
        job.words += _words(event)
    for child in _children(event):
        job.discover(child)
    del job.owners[event["url"]]
    if job.processed == len(job.urls):
        job.state = "done"


def _ended(state: str, failure: Callable[[dict], str]) -> Callable[[Machine, dict], None]:
    def change(job: Machine, event: dict) -> None:
        job.state, job.failure = state, failure(event)

    return change


_named = _ended("failed", lambda event: event["outcome"] if event["outcome"] in KINDS else "protocol")
#: What a reply to a kind of event changes.
EFFECTS: dict[tuple[str, str], Callable[[Machine, dict], None]] = {
    ("submit", "created"): _created,
    ("claim", "claimed"): _claimed,
    ("complete", "published"): _published,
    ("complete", "failed"): _named,
    ("complete", "overflow"): _ended("failed", lambda event: "statistics"),
    ("fail", "failed"): _named,
    ("abort", "aborted"): _ended("aborted", lambda event: ""),
}


_NAMES = [f.split()[0] for f in REPLIES.split(", ")]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    job, machine = None, Machine()
    for batch in batches:
        out = []
        for event in batch.to_dict("records"):
            if event["job_id"] != job:
                job, machine = event["job_id"], Machine()
            out.append(machine.row(job, event["seq"], machine.apply(event)))
        yield pd.DataFrame(out, columns=_NAMES)


def fold(events: DataFrame) -> DataFrame:
    """The reply to every event and the job's state after it. A task streams jobs one after another; what it
    holds is one job's URLs."""
    ordered = events.withColumn("words", F.col("words").cast("string")).repartition("job_id").sortWithinPartitions("job_id", "seq")
    return ordered.mapInPandas(_fold, REPLIES)


#: Rules that a stored job keeps, as SQL conditions that hold when one is broken: what a job is, what it has
#: counted, and what it has left to do. ``total`` is the sum of its counts by extension.
RULES = {
    "base": "coalesce(base, '') = ''",
    "schema": "schema <> 1",
    "state": "NOT (state IN ('running', 'done', 'aborted') AND failure = '' OR state = 'failed' AND failure IN ('fetch', 'statistics', 'protocol'))",
    "active": "active <> (state = 'running')",
    "processed": f"NOT processed BETWEEN 0 AND {U64_MAX}",
    "words": f"words > {U64_MAX}",
    "files exceed processed": "files > processed",
    "words without files": "files = 0 AND words > 0",
    "extension empty": "exists(map_keys(exts), e -> e = '')",
    "count not positive": "exists(map_values(exts), n -> n < 1)",
    "counts do not add up": "total <> files",
    "nothing discovered": "discovered = 0",
    "too many to count": f"greatest(discovered, frontier, in_flight) > {(1 << 53) - 1}",
    "partition": "discovered <> processed + frontier + in_flight",
    "done with work": "state = 'done' AND frontier + in_flight > 0",
    "running without work": "state = 'running' AND frontier + in_flight = 0",
}


def broken_rules(jobs: DataFrame) -> DataFrame:
    """jobs with ``broken``: names of the RULES that a stored job breaks.

    Columns: schema, base, state, failure, active, processed, files, words, exts (map), discovered, frontier, in_flight.
    """
    total = F.aggregate(F.map_values("exts"), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    named = F.array(*[F.when(F.expr(holds), F.lit(rule)) for rule, holds in RULES.items()])
    return jobs.withColumn("total", total).withColumn("broken", F.array_compact(named)).drop("total")
