"""Streams: intake that never forgets a base, and the job machine as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs as job_ops
from ..operators.protocol import _NAMES, REPLIES, Machine
from ..sources.store import Store


def distinct_bases(submissions: DataFrame) -> DataFrame:
    """First submission of every (namespace, base). No watermark: a base stays known for ever."""
    return submissions.dropDuplicates(["namespace", "base"])


def submit_stream(submissions: DataFrame, store: Store, checkpoint: str, done: Callable[[int], None] | None = None) -> StreamingQuery:
    """Submit micro-batches of (namespace, pos, base) into the store's ``submissions``. Replayed batches change
    nothing, since a known base keeps its job."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        old = store.read("submissions")
        old = spark.createDataFrame([], "namespace string, base string, job_id long") if old is None else old
        fresh = job_ops.submit(old, df).where("created").select("namespace", "base", "job_id")
        if not fresh.isEmpty():
            store.commit(submissions=old.unionByName(fresh))
        if done:
            done(number)

    return submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    machine = pickle.loads(state.get[0]) if state.exists else Machine()  # noqa: S301 - own state only
    events = pd.concat(list(batches)).sort_values("seq")
    out = [machine.row(key[0], e["seq"], machine.apply(e)) for e in events.to_dict("records")]
    state.update((pickle.dumps(machine),))
    yield pd.DataFrame(out, columns=_NAMES)


def machine_stream(events: DataFrame) -> DataFrame:
    """Replies to a stream of protocol events. Events of a job in one batch go in order of seq; late
    publications after an end get the end as their reply and change nothing."""
    return events.groupBy("job_id").applyInPandasWithState(_step, REPLIES, "machine binary", "append", "NoTimeout")
