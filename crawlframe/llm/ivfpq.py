"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample. Every row is then indexed: its list is the nearest
centroid, its code the nearest codeword of each part of the residual. Rows are dealt out by list and written in
units of UNIT_ROWS rows at most, so that a list with a third of all rows is many units.

A query probes lists in the order of their centroids' cosine with it, until they hold a share of all rows. The
share is measured: on rows that the centroids weren't fitted on (on all rows, if there are no more), it is
what a RECALL of the nearest neighbours takes. Three passes follow. Blocks of queries meet the codes of the
units that they probe, where a table of products with all codewords gives approximate scores (asymmetric
distances); the best ``rerank`` of a query over all units are picked by its block; those alone are scored on
the original vectors, in double precision.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null ids, take no part;
a shorter vector's missing components count as 0; a query's candidates are all rows whose id isn't its own;
repeated query rows each get their results, repeated candidates each take a rank; ties go to the smaller id;
an empty table or no query gives no rows; more columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions
from .topk import batch_rows, finite_vectors, padded

#: Rows that centroids and codebooks are fitted on, at most: the lowest by a hash of their id. As many again measure the recall.
SAMPLE_ROWS = 16_384
#: Sample rows to a centroid, by default.
LIST_ROWS = 4
#: What probing alone is to find of the nearest neighbours.
RECALL = 0.94
UNIT_ROWS = 8192
QUERY_ROWS = 512
#: Rows whose distances to all centroids are held at once.
_BLOCK = 1024


@dataclass(frozen=True)
class Model:
    """centroids (lists, width); codebooks (parts, codewords, width of a part)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, width of a part), padded with zeros."""
        parts, _, w = self.codebooks.shape
        out = np.zeros((len(x), parts * w))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), parts, w)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of each row."""
        lists = nearest(x, self.centroids)
        rest = self.split(x - self.centroids[lists])
        code = np.stack([nearest(rest[:, m], self.codebooks[m]) for m in range(len(self.codebooks))], axis=1)
        return lists, code.astype(np.uint8)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c**2).sum(axis=1)[None, :]
    parts = [np.argmin(size - 2 * (x[k : k + _BLOCK] @ c.T), axis=1) for k in range(0, len(x), _BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random distinct rows; a centroid without rows stays where it is."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


def fit(sample: np.ndarray, n_lists: int, parts: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    centroids = kmeans(sample, n_lists, 8, rng)
    w = -(-sample.shape[1] // parts)
    model = Model(centroids, np.zeros((parts, 1, w)))
    rest = model.split(sample - centroids[nearest(sample, centroids)])
    books = [kmeans(rest[:, m], 256, 5, rng) for m in range(parts)]
    size = max(len(b) for b in books)
    return Model(centroids, np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), axis=0)]) for b in books]))


def toward(model: Model, q: np.ndarray, lists: np.ndarray | None = None) -> np.ndarray:
    """Cosine of queries (rows) with centroids, times the query's length; a zero centroid comes last."""
    c = model.centroids if lists is None else model.centroids[lists]
    size = np.linalg.norm(c, axis=1)
    return np.where(size > 0, (q @ c.T) / np.where(size > 0, size, 1), -np.inf)


def share_for(model: Model, rows: np.ndarray, k: int, recall: float, queries: int = 512) -> float:
    """The share of ``rows`` that a query must probe to meet ``recall`` of its k nearest, measured on some that differ."""
    k = min(k, len(rows) - 1)
    if k < 1:
        return 1.0
    asked = np.sort(np.unique(rows, axis=0, return_index=True)[1])[:queries]
    q = rows[asked]
    own = nearest(rows, model.centroids)
    sizes = np.bincount(own, minlength=len(model.centroids))
    s = q @ rows.T
    s[np.arange(len(q)), asked] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(-toward(model, q), axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(np.take_along_axis(before, place, axis=1), own[near], axis=1) + 1
    return float(np.quantile(needed, recall, method="higher")) / len(rows)


_INDEX = "id long, v array<double>, list int, code binary"
_UNIT = "unit long, lists array<int>, counts binary, ids binary, code binary, copies binary, width int, v binary"


def _fitted(x: list[np.ndarray], width: int) -> np.ndarray:
    """Rows at the model's width; what lies beyond it in a longer row only the exact score sees."""
    return padded([r[:width] for r in x], width)


def _indexed(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lists, code = model.assign(_fitted(batch_rows(batch), model.width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "v", "list", "code"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows become units, in the order of their lists."""
    from pyspark import TaskContext

    held: list[tuple[int, int, np.ndarray, bytes]] = []
    part, made = TaskContext.get().partitionId(), 0
    names = [f.split()[0] for f in _UNIT.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.int32(), pa.binary()]

    def emit() -> pa.RecordBatch:
        held.sort(key=lambda r: r[:2])
        lists, counts = np.unique([r[0] for r in held], return_counts=True)
        v = padded([r[2] for r in held])
        seen: dict[bytes, int] = {}
        copies = []  # how many equal vectors of smaller ids stand before
        for x in v:
            copies.append(seen.get(key := x.tobytes(), 0))
            seen[key] = copies[-1] + 1
        row = ((part << 32) | made, lists.astype(np.int32), counts.astype(np.int64).tobytes(), np.array([r[1] for r in held], dtype=np.int64).tobytes(), b"".join(r[3] for r in held), np.array(copies).tobytes(), v.shape[1], v.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        held += zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch_rows(batch), batch.column(3).to_pylist(), strict=True)
        while len(held) >= UNIT_ROWS:
            later = held[UNIT_ROWS:]
            del held[UNIT_ROWS:]
            yield emit()
            made += 1
            held[:] = later
    if held:
        yield emit()


_ASK = "no long, q_ids binary, q binary, q_width int, cuts binary, lists array<int>"


def _asked(model: Model, share: float, sizes: np.ndarray, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in blocks, each with the cosine down to which it probes, and all lists that its block probes."""
    from pyspark import TaskContext

    part, made, total = TaskContext.get().partitionId(), 0, sizes.sum()
    names = [f.split()[0] for f in _ASK.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    ids: list[int] = []
    rows: list[np.ndarray] = []

    def emit(ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        q, fitted = padded(rows), _fitted(rows, model.width)
        near = toward(model, fitted)
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        last = ((before < max(share * total, least)).sum(axis=1) - 1).clip(0)
        edge = np.take_along_axis(near, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]
        cuts = edge - 1e-9 * np.linalg.norm(fitted, axis=1)  # what a product may differ by between passes
        probed = np.flatnonzero((near >= cuts[:, None]).any(axis=0))
        row = ((part << 32) | made, np.array(ids, dtype=np.int64).tobytes(), q.tobytes(), q.shape[1], cuts.tobytes(), probed.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    for batch in batches:
        if batch.num_rows:
            ids += batch.column(0).to_pylist()
            rows += batch_rows(batch)
        while len(ids) >= QUERY_ROWS:
            yield emit(ids[:QUERY_ROWS], rows[:QUERY_ROWS])
            ids, rows, made = ids[QUERY_ROWS:], rows[QUERY_ROWS:], made + 1
    if ids:
        yield emit(ids, rows)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, the same double whichever rows are scored together."""
    w = min(len(q), v.shape[1])
    return (v[:, :w] * q[:w]).sum(axis=1)


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores; of those that tie at the end, the smallest ids."""
    if len(score) <= n:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - n)[len(score) - n]
    above, tied = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
    return np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")[: n - len(above)]]])


def _best_apart(score: np.ndarray, ids: np.ndarray, n: int, alike: int) -> np.ndarray:
    """Places of the n largest scores, of those that tie only the ``alike`` smallest ids."""
    order = np.lexsort((ids, -score))
    s = score[order]
    order = order[np.arange(len(s)) - np.searchsorted(-s, -s) < alike]
    return order[:n]


def _coarse(x: np.ndarray) -> np.ndarray:
    """Scores without their last bits, so that equal vectors tie whichever rows they are scored with."""
    return (x.astype(np.float32).view(np.int32) & ~0xFF).view(np.float32)


def scan_unit(model: Model, rerank: int, alike: int, q_ids: np.ndarray, q: np.ndarray, cuts: np.ndarray, lists: np.ndarray, counts: np.ndarray, ids: np.ndarray, code: np.ndarray, copies: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in the unit, approximate scores) of each query's best rows on the lists that it probes.

    Of equal vectors the ``alike`` smallest ids suffice; a large group of copies would crowd out others.
    """
    probed = toward(model, q, lists) >= cuts[:, None]
    product = q @ model.centroids[lists].T
    tables = np.einsum("qmw,mkw->qmk", model.split(q), model.codebooks)
    flat = code.astype(np.int64) + np.arange(code.shape[1]) * model.codebooks.shape[1]
    out, few = [], copies < alike
    for i in range(len(q)):
        at = np.flatnonzero(np.repeat(probed[i], counts) & few)
        at = at[ids[at] != q_ids[i]]
        rough = _coarse(np.repeat(product[i], counts)[at] + tables[i].ravel()[flat[at]].sum(axis=1))
        best = _best(rough, ids[at], rerank)
        out.append((at[best], rough[best]))
    return out


_FOUND = "no long, unit long, ns binary, places binary, ids binary, scores binary"
_ints = partial(np.frombuffer, dtype=np.int64)


def _scanned(model: Model, rerank: int, alike: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            no, q_ids, q, q_width, cuts, unit, lists, counts, ids, code, copies = (x[i].as_py() for x in batch.columns)
            ids, q = _ints(ids), _fitted(list(np.frombuffer(q).reshape(-1, q_width)), model.width)
            found = scan_unit(model, rerank, alike, _ints(q_ids), q, np.frombuffer(cuts), np.array(lists), _ints(counts), ids, np.frombuffer(code, dtype=np.uint8).reshape(len(ids), -1), _ints(copies))
            places = np.concatenate([x[0] for x in found])
            if len(places):
                row = (np.array([len(x[0]) for x in found]).tobytes(), places.tobytes(), ids[places].tobytes(), np.concatenate([x[1] for x in found]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([unit]), *[pa.array([x], pa.binary()) for x in row]], names)


_PICKED = "no long, unit long, asks binary, q_ids binary, q binary, q_width int, ns binary, places binary"


def _picked(rerank: int, alike: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of what the units found, each query's best. A block's queries come first, then its units one by one."""
    names = [f.split()[0] for f in _PICKED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    at, q_ids, q, best = None, np.zeros(0), np.zeros((0, 0)), []

    def emit() -> Iterator[pa.RecordBatch]:
        every = np.concatenate([np.full(len(b[0]), i) for i, b in enumerate(best)]) if best else np.zeros(0, dtype=np.int64)
        if not len(every):
            return
        units, places = np.concatenate([b[2] for b in best]), np.concatenate([b[3] for b in best])
        order = np.lexsort((every, units))
        every, units, places = every[order], units[order], places[order]
        for lo, hi in zip(first := np.flatnonzero(np.diff(units, prepend=units[0] - 1)), [*first[1:], len(units)], strict=True):
            asks, ns = np.unique(every[lo:hi], return_counts=True)
            row = (at, int(units[lo]), asks.tobytes(), q_ids[asks].tobytes(), q[asks].tobytes(), q.shape[1], ns.tobytes(), places[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            no, unit, given, ns, places, ids, scores = (x[i].as_py() for x in batch.columns)
            if no != at:
                yield from emit()
                at, q_ids = no, _ints(given["q_ids"])
                q = np.frombuffer(given["q"]).reshape(-1, given["q_width"])
                none = np.zeros(0, dtype=np.int64)
                best = [(np.zeros(0, dtype=np.float32), none, none, none)] * len(q_ids)
                continue
            places, ids, scores = _ints(places), _ints(ids), np.frombuffer(scores, dtype=np.float32)
            ends = np.cumsum(_ints(ns))
            for j, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if hi > lo:
                    old = best[j]
                    new = [np.concatenate(x) for x in zip(old, (scores[lo:hi], ids[lo:hi], np.full(hi - lo, unit), places[lo:hi]), strict=True)]
                    kept = _best_apart(new[0], new[1], rerank, alike)
                    best[j] = tuple(x[kept] for x in new)
    yield from emit()


def _scored(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            no, asks, q_ids, q, q_width, ns, places, ids, v, width = (x[i].as_py() for x in batch.columns)
            asks, q_ids, ns, places, ids = map(_ints, (asks, q_ids, ns, places, ids))
            q, v = np.frombuffer(q).reshape(-1, q_width), np.frombuffer(v).reshape(-1, width)
            out, ends = [], np.cumsum(ns)
            for j, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                s = exact_scores(q[j], v[places[lo:hi]])
                best = np.lexsort((ids[places[lo:hi]], -s))[:k]
                out.append((np.full(len(best), asks[j]), np.full(len(best), q_ids[j]), ids[places[lo:hi]][best], s[best]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), no)), *map(pa.array, cols)], ["no", "place", "query_id", "vec_id", "score"])


def neighbours(
    vectors: DataFrame,
    every: int,
    k: int,
    lists: int | None = None,
    probe_share: float | None = None,
    parts: int = 32,
    rerank: int = 200,
    sample_rows: int = SAMPLE_ROWS,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is divisible by ``every``.

    ``lists``: number of centroids (by default one for LIST_ROWS rows of the sample); ``probe_share``: share of
    all rows on the lists that a query probes (by default what RECALL takes; more, where those hold fewer than
    ``k`` others); ``rerank``: rows of each query scored exactly, over all units.
    """
    spark = vectors.sparkSession
    rows = finite_vectors(vectors, vec_id, embedding).where(F.exists("v", lambda x: x != 0))
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(2 * sample_rows).select("v").collect()  # sample_rows bounds it
    schema = "query_id long, rank int, vec_id long, score double"
    if not taken:
        return spark.createDataFrame([], schema)
    sample = padded([np.array(r["v"]) for r in taken])
    model = fit(sample[:sample_rows], lists or max(1, len(sample[:sample_rows]) // LIST_ROWS), parts)
    index = materialize(rows.select("id", "v").mapInArrow(partial(_indexed, model), _INDEX), "inverted-file")
    sizes = np.zeros(len(model.centroids), dtype=np.int64)
    for r in index.groupBy("list").count().collect():  # a row a centroid at most
        sizes[r["list"]] = r["count"]
    total = int(sizes.sum())
    if probe_share is None:  # of a query's k nearest, about this many are among the rows that measure
        apart = sample[sample_rows:] if len(sample) == 2 * sample_rows else sample
        probe_share = share_for(model, apart, max(1, -(-k * len(apart) // total)), RECALL)
    n = max(1, -(-total // UNIT_ROWS))
    slots = max(1, shuffle_partitions(spark))
    dealt = index.repartitionByRange(n, "list", "id").sortWithinPartitions("list", "id").coalesce(n)
    slot = F.pmod(F.xxhash64("unit"), F.lit(slots)).cast("int")
    units = materialize(dealt.select("id", "v", "list", "code").mapInArrow(_units, _UNIT).withColumn("slot", slot), "units")
    queries = rows.where(F.col("id") % every == 0).select("id", "v")
    known = queries.groupBy("id").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    # whatever the share, a query's lists hold k rows besides its own, if there are so many
    least = k + (known["most"] or 0)
    blocks = queries.coalesce(max(1, -(-(known["n"] or 0) // (4 * QUERY_ROWS))))
    asks = materialize(blocks.mapInArrow(partial(_asked, model, probe_share, sizes, least), _ASK), "queries")
    # each block of queries meets the codes of the units of every slot; vectors stay where they are
    sent = asks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(slots, "slot")
    codes = units.select("slot", "unit", F.col("lists").alias("held"), "counts", "ids", "code", "copies").repartition(slots, "slot")
    met = sent.join(codes, "slot").where(F.arrays_overlap("lists", "held"))
    met = met.select("no", "q_ids", "q", "q_width", "cuts", "unit", F.col("held").alias("lists"), "counts", "ids", "code", "copies")
    found = met.mapInArrow(partial(_scanned, model, rerank, least), _FOUND).withColumn("given", F.lit(None).cast("struct<q_ids:binary,q:binary,q_width:int>"))
    first = asks.select("no", F.struct("q_ids", "q", "q_width").alias("given"))
    merged = first.unionByName(found, allowMissingColumns=True).repartition("no").sortWithinPartitions("no", F.col("unit").asc_nulls_first())
    picked = merged.select("no", "unit", "given", "ns", "places", "ids", "scores").mapInArrow(partial(_picked, rerank, least), _PICKED)
    exact = picked.join(units.select("unit", "ids", "v", "width"), "unit").select("no", "asks", "q_ids", "q", "q_width", "ns", "places", "ids", "v", "width")
    scored = exact.mapInArrow(partial(_scored, k), "no long, place long, query_id long, vec_id long, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("no", "place").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
