"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integer weights on terms (their components). Each task sorts its rows into blocks of rows that
lie near each other and writes them as forward indexes (ids and weights), a unit of several blocks a row, and
apart from them a summary of each block: the largest and smallest weight of each term, its middle and its
radius. Queries come in blocks as well and start from the k-th score among the rows of their own task.

Query blocks first meet summaries alone. A block's bound for a query is the sum over terms of the larger of
weight x maximum and weight x minimum, or the product with the middle plus radius x length, if that is less.
Only units with a block whose bound reaches a query's k-th score are fetched for it. There, each query takes
blocks in the order of their bounds until the next bound falls below its k-th score, which rises on the way.
Only rows that reach the k-th score leave a unit, and a last window picks the k best.

Defined cases: vectors that are null or hold null or non-finite components, and null ids, take no part; a
shorter vector's missing components count as 0; a query's candidates are all rows whose id isn't its own;
repeated query rows each get their results, repeated candidates each take a rank; ties go to the smaller id;
weights and scores beyond a long become the largest or the smallest one (scores are exact up to there, and
tie beyond); an empty table or no query gives no rows; more columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions

BLOCK_ROWS = 128
#: Rows that are fetched together, and rows that are sorted together.
UNIT_ROWS = 1024
SUPER_ROWS = 8192
QUERY_ROWS = 512
_EXACT = 2.0**53
_LONG = 2.0**63
_NO = np.iinfo(np.int64).min


def finite_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))


def batch_rows(batch: pa.RecordBatch, k: int = 1) -> list[np.ndarray]:
    """The list column ``k`` as arrays."""
    col = batch.column(k)
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return np.split(flat, (ends - ends[0])[1:-1])


def padded(rows: list[np.ndarray], width: int | None = None) -> np.ndarray:
    width = max([width or 0, *(len(r) for r in rows)])
    if all(len(r) == width for r in rows):
        return np.array(rows).reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype=rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def near_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows that keeps near rows together: halves along the main direction, down to ``leaf`` rows."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        y = x[rows] - x[rows].mean(axis=0)
        d = np.ones(y.shape[1]) / max(1, y.shape[1]) ** 0.5
        for _ in range(4):
            d = y.T @ (y @ d)
            norm = np.linalg.norm(d)
            if not norm:
                break
            d /= norm
        half = -(-len(rows) // (2 * leaf)) * leaf
        ranked = rows[np.argsort(y @ d, kind="stable")]
        todo += [ranked[half:], ranked[:half]]
    return np.concatenate(out) if out else np.arange(0)


def dot(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of q and d, held within a long."""
    w = min(q.shape[1], d.shape[1])
    q, d = q[:, :w], d[:, :w]
    big_q, big_d = np.abs(q.astype(np.float64)).max(axis=1, initial=0), np.abs(d.astype(np.float64)).max(axis=1, initial=0)
    most = big_q.max(initial=0) * big_d * max(1, w)
    if most.max(initial=0) < _EXACT:
        return np.rint(q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    if most.max(initial=0) < _LONG:
        return q @ d.T
    out = np.empty((len(q), len(d)), dtype=np.int64)
    wide = most >= _LONG  # these few rows are multiplied without a bound
    out[:, ~wide] = q @ d[~wide].T
    exact = q.astype(object) @ d[wide].astype(object).T
    out[:, wide] = np.clip(exact, _NO + 1, np.iinfo(np.int64).max).astype(np.int64)
    return out


def summary(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(largest weights, smallest weights, middles, radii) of the blocks."""
    starts = np.arange(0, len(w), BLOCK_ROWS)
    sizes = np.diff(np.append(starts, len(w)))
    real = w.astype(np.float64)
    middle = np.add.reduceat(real, starts, axis=0) / sizes[:, None]
    apart = np.linalg.norm(real - np.repeat(middle, sizes, axis=0), axis=1)
    return np.maximum.reduceat(w, starts, axis=0), np.minimum.reduceat(w, starts, axis=0), middle, np.maximum.reduceat(apart, starts)


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray, middle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No score of a query (rows) in a block (columns) is above this; what doubles may lose is added."""
    width = min(q.shape[1], top.shape[1])
    q, top, low, middle = (x[:, :width].astype(np.float64) for x in (q, top, low, middle))
    most = np.maximum(np.abs(top), np.abs(low))
    lost = 1e-9 * (np.abs(q) @ most.T) + 1
    terms = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    ball = q @ middle.T + np.linalg.norm(q, axis=1)[:, None] * radius * (1 + 1e-9)
    return np.minimum(terms, ball) + lost


_INDEX = "kind string, super long, no long, ids binary, weights binary, width int, floors binary, tops binary, lows binary, middles binary, radii binary"
_INDEX_NAMES = [f.split()[0] for f in _INDEX.split(", ")]
_INDEX_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5]


def _indexed(every: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units, summaries and query blocks of SUPER_ROWS rows at a time; queries hold their k-th score among these."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0

    def emit(ids: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal made
        order = near_order(w.astype(np.float64), BLOCK_ROWS)
        ids, w = ids[order], w[order]
        own, width = (part << 32) | made, w.shape[1]
        top, low, middle, radius = summary(w)
        rows = [("summary", own, own, None, None, width, None, top.tobytes(), low.tobytes(), middle.tobytes(), radius.tobytes())]
        for n, at in enumerate(range(0, len(ids), UNIT_ROWS)):
            rows.append(("unit", own, n, ids[at : at + UNIT_ROWS].tobytes(), w[at : at + UNIT_ROWS].tobytes(), width, *[None] * 5))
        asks = np.flatnonzero(ids % every == 0)
        for at in range(0, len(asks), QUERY_ROWS):
            mine = asks[at : at + QUERY_ROWS]
            s = dot(w[mine], w)
            s[ids[mine][:, None] == ids[None, :]] = _NO
            floors = np.partition(s, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(mine), _NO)
            rows.append(("queries", own, (part << 32) | made, ids[mine].tobytes(), w[mine].tobytes(), width, floors.tobytes(), *[None] * 4))
            made += 1
        made += not len(asks)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_KINDS, strict=True)], _INDEX_NAMES)

    ids, rows = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids += batch.column(0).to_pylist()
        rows += batch_rows(batch)
        while len(ids) >= SUPER_ROWS:
            yield from emit(np.array(ids[:SUPER_ROWS], dtype=np.int64), padded(rows[:SUPER_ROWS]))
            ids, rows = ids[SUPER_ROWS:], rows[SUPER_ROWS:]
    if ids:
        yield from emit(np.array(ids, dtype=np.int64), padded(rows))


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.int64)


_KEPT = "no long, slot int, super long, unit int, wanted binary, kept int, pairs int"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each unit that some query of a block can't leave out, with the queries that want it, as bits."""
    per = UNIT_ROWS // BLOCK_ROWS
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    for batch in batches:
        for i in range(batch.num_rows):
            no, slot, q, q_width, floors, own, width, top, low, middle, radius = (c[i].as_py() for c in batch.columns)
            shaped = lambda b, t=np.int64, w=width: np.frombuffer(b, dtype=t).reshape(-1, w)
            most = bounds(_ints(q).reshape(-1, q_width), shaped(top), shaped(low), shaped(middle, np.float64), np.frombuffer(radius))
            reach = most >= _ints(floors)[:, None]
            starts = np.arange(0, reach.shape[1], per)
            wanted = np.logical_or.reduceat(reach, starts, axis=1)
            kept = np.add.reduceat(reach.sum(axis=0), starts)
            blocks = np.diff(np.append(starts, reach.shape[1])) * len(reach)
            rows = [(no, slot, own, u, np.packbits(wanted[:, u]).tobytes(), int(kept[u]), int(blocks[u])) for u in range(len(starts))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _KEPT.split(", ")])


def search_pair(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((query's place, query id, id, score) rows that reach the k-th score, number of scored blocks)."""
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    most = bounds(q, *summary(w))
    order = np.argsort(-most, axis=1, kind="stable")
    floors = floors.copy()
    best = np.full((len(q), k), _NO)  # k best scores so far, to raise the floors
    out, scored = [], 0
    for turn in range(len(starts)):
        block = order[:, turn]
        active = np.flatnonzero(most[np.arange(len(q)), block] >= floors)
        if not len(active):
            break
        for b in np.unique(block[active]):
            mine = active[block[active] == b]
            at = slice(starts[b], starts[b] + BLOCK_ROWS)
            s = dot(q[mine], w[at])
            own = q_ids[mine][:, None] == ids[at][None, :]
            s[own] = _NO
            scored += len(mine)
            r, c = np.nonzero((s >= floors[mine][:, None]) & ~own)
            out.append(np.column_stack([mine[r], q_ids[mine[r]], ids[at][c], s[r, c]]))
            seen = np.concatenate([best[mine], s], axis=1)
            best[mine] = np.partition(seen, -k, axis=1)[:, -k:]
            floors[mine] = np.maximum(floors[mine], best[mine].min(axis=1))
    if not out:
        return np.zeros((0, 4), dtype=np.int64), scored
    rows = np.concatenate(out)
    rows = rows[rows[:, 3] >= floors[rows[:, 0]]]
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 0]))]
    first = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - first < k], scored  # of rows that tie, the smallest ids suffice


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            no, q_ids, q, q_width, floors, ids, w, width, wanted = (c[i].as_py() for c in batch.columns)
            q_ids = _ints(q_ids)
            mine = np.flatnonzero(np.unpackbits(np.frombuffer(wanted, dtype=np.uint8), count=len(q_ids)))
            rows, _ = search_pair(q_ids[mine], _ints(q).reshape(-1, q_width)[mine], _ints(floors)[mine], _ints(ids), _ints(w).reshape(-1, width), k)
            key = np.full(len(rows), no)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, mine[rows[:, 0]], rows[:, 1], rows[:, 2], rows[:, 3])], ["no", "place", "query_id", "vec_id", "score"])


def _index(vectors: DataFrame, every: int, k: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    weights = F.transform("v", lambda x: F.floor(F.lit(scale) * x))
    rows = finite_vectors(vectors, vec_id, embedding).select("id", weights.alias("w"))
    slot: Column = F.pmod(F.xxhash64("super"), F.lit(max(1, shuffle_partitions(vectors.sparkSession)))).cast("int")
    return materialize(rows.mapInArrow(partial(_indexed, every, k), _INDEX).withColumn("slot", slot), "blocks")


def _units_kept(index: DataFrame) -> DataFrame:
    """Every query block meets the summaries of every slot; blocks themselves aren't read."""
    asks = index.where("kind = 'queries'").select("no", F.col("weights").alias("q"), F.col("width").alias("q_width"), "floors")
    asks = asks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(1, shuffle_partitions(index.sparkSession)) - 1))))
    summaries = index.where("kind = 'summary'").select("slot", "super", "width", "tops", "lows", "middles", "radii")
    met = asks.join(summaries, "slot").select("no", "slot", "q", "q_width", "floors", "super", "width", "tops", "lows", "middles", "radii")
    return met.mapInArrow(_kept, _KEPT)


def scored_share(vectors: DataFrame, every: int, k: int, scale: int = 256, *, vec_id: str = "vec_id", embedding: str = "embedding") -> float:
    """The share of all pairs of a query and a block that the summaries leave to be scored."""
    got = _units_kept(_index(vectors, every, k, scale, vec_id, embedding)).agg(F.sum("kept").alias("kept"), F.sum("pairs").alias("pairs")).first()
    return got["kept"] / got["pairs"] if got["pairs"] else 0.0


def top_k(vectors: DataFrame, every: int, k: int, scale: int = 256, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row whose id is divisible by ``every``."""
    index = _index(vectors, every, k, scale, vec_id, embedding)
    kept = materialize(_units_kept(index).where("kept > 0").select("no", "slot", "super", "unit", "wanted"), "kept-units")
    # a query block goes to the slots that hold a unit it wants, with the list of those
    key = F.struct("super", "unit")
    wants = kept.groupBy("no", "slot").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "wanted"))).alias("wants"))
    asks = index.where("kind = 'queries'").select("no", F.col("ids").alias("q_ids"), F.col("weights").alias("q"), F.col("width").alias("q_width"), "floors").join(wants, "no")
    units = index.where("kind = 'unit'").select("slot", F.struct("super", F.col("no").cast("int").alias("unit")).alias("key"), "ids", "weights", "width")
    pairs = asks.alias("a").join(units.alias("u"), (F.col("a.slot") == F.col("u.slot")) & F.map_contains_key("a.wants", F.col("u.key")))
    pairs = pairs.select("no", "q_ids", "q", "q_width", "floors", "ids", "weights", "width", F.element_at("wants", F.col("key")).alias("wanted"))
    found = pairs.mapInArrow(partial(_search, k), "no long, place long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("no", "place").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
