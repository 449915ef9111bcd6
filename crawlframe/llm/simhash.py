"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the shingles' hashes. For a distance of
``max_bits`` it is cut into ``max_bits // 2 + 1`` segments, so that of two linked fingerprints one segment
differs by one bit at most. Each segment is indexed once per bit with that bit taken out (a one-wildcard
variant); two fingerprints whose segment differs by one bit at most meet in an equality join on a variant.
The join's own condition verifies the distance and lets a pair through only at the first segment and bit
where it can meet, so each link comes out once. Copies are one fingerprint before the join.

Links become groups by repeated star steps (each node to the smallest node it knows), written to the shared
folder after every round; nothing of it goes to the driver but a count and a checksum.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any
other; texts under the shingle's words are one shingle; null ids get a fingerprint and a group but never name
one (a group of null ids only has a null component); repeated rows are all returned; an empty table gives no
rows; more columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

SEED = 42
#: Shingles hashed at once; bounds memory on very long texts.
_BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint as an unsigned integer. A-Z are lower-cased; words end at space and \\x09-\\x0D."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + _BLOCK], ends[k : k + _BLOCK], strict=True)], dtype="<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, words), "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments."""
    n = max_bits // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(width: int) -> int:
    return (1 << width) - 1 if width < 64 else -1


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) with a < b: every pair of the distinct fingerprints in ``fp`` at ``max_bits`` or fewer differing bits."""
    segments = _segments(max_bits)
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)

    def part(x: Column, k: int) -> Column:
        shift, width = segments[k]
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(_mask(width)).cast("long"))

    def variants(k: int) -> Column:
        def variant(j: Column) -> Column:
            return F.struct(F.lit(k).alias("seg"), j.alias("bit"), part(F.col("fp"), k).bitwiseAND(F.bitwise_not(bit(j))).alias("rest"))

        return F.transform(F.sequence(F.lit(0), F.lit(segments[k][1] - 1)), variant)

    indexed = distinct.select("fp", F.explode(F.concat(*map(variants, range(len(segments))))).alias("v")).select("fp", "v.seg", "v.bit", "v.rest")
    left, right = indexed.alias("l"), indexed.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    first = F.lit(False)
    for k in range(len(segments)):
        own = part(x, k)
        here = (F.col("l.seg") == k) & (((own == 0) & (F.col("l.bit") == 0)) | (own == bit(F.col("l.bit"))))
        for j in range(k):
            here = here & (F.bit_count(part(x, j)) > 1)
        first = first | here
    meet = (F.col("l.seg") == F.col("r.seg")) & (F.col("l.bit") == F.col("r.bit")) & (F.col("l.rest") == F.col("r.rest"))
    close = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(x) <= max_bits) & first
    # Spark takes the exploded rows for as few as the fingerprints, and would send all of them to the driver to be broadcast
    return left.hint("merge").join(right.hint("merge"), meet & close).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes that ``edges`` (a, b) name.

    Rounds of large and small stars; each shortens the longest path by a factor, so rounds grow with its logarithm.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or now["n"] == 0:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # now each edge leads from a small node a to b; each b sends all its smaller nodes to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct("m", F.col("b").alias("x")), F.struct("m", F.col("a").alias("x")))).alias("e"))
        edges = materialize(small.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a <> b").distinct(), "links")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable, its own included) of every row."""
    prints = materialize(fingerprints(docs, words, doc_id=doc_id, text=text), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(links(reps.select("fp"), max_bits))
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "groups")
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 3, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that with the smallest id, of equal ids that with the smallest hash of its text.
    Rows without an id are held against each other only: one of each group stays."""
    row = "__near_duplicate_row"
    rows = materialize(docs.select(F.monotonically_increasing_id().alias(row), *docs.columns), "rows")
    found = near_duplicates(rows, words, max_bits, doc_id=row, text=text).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    order = rows.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("hash"))
    first = F.min(F.struct("id", "hash", "row")).alias("first")
    stay = found.join(order, "row").groupBy("group", F.col("id").isNull()).agg(first).select(F.col("first.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)
