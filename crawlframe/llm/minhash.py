"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, whole sets verify.

Operator 5 comes first, with this module's shingles: its fingerprints, links and components put texts into groups,
and each set of such a group is held against one of the group. What lies farther apart than its few bits, as most pairs
at a similarity of 0.8 do, is left to MinHash.

A text is the set of its shingles' 64-bit hashes; copies are one set before any join. A set's minima under
BANDS * BAND_ROWS hash functions are cut into bands, and sets that agree in a band are candidates: a pair at
similarity s is missed with probability (1 - s**BAND_ROWS)**BANDS, 6e-5 at 0.8. Every candidate pair that can
still join two groups is verified on the whole sets, so no pair under the similarity links.

Large groups need not make all their pairs: first each set of a bucket is held against one of the bucket,
twice over, then, in buckets whose sets are in several groups yet, the pairs of different groups. Pairs
within a group are left out, since they can't change groups. Of the others, those are left out whose sets
can't share enough, by counts that hold exactly: a shingle is rare if RARE or fewer of the sets in question
hold it. Two sets that share a rare shingle meet at that shingle; two that share none have no more in common
than either's shingles that aren't rare. Near copies of one text differ from it, and from each other, by
rare shingles, so a large group's neighbours just under the similarity are told apart without meeting.

Defined cases: A-Z are lower-cased, words end at ASCII white space; texts under the shingle's words are one
shingle; null and empty texts, and texts of white space, are copies of each other; an empty table gives no
rows. Equal sets are told by a 64-bit hash of the set.
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
from .encoding import release
from .simhash import SEED, components, fingerprint, links

BANDS, BAND_ROWS = 32, 6
#: The most sets that a rare shingle occurs in; pairs by rare shingles grow with it, the others shrink.
RARE = 8
#: Shingles whose minima are taken at once; bounds memory on very long texts.
_BLOCK = 1 << 9
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[-n:].tolist(), strict=True)), dtype=np.uint64, count=n))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), _BLOCK):
        np.minimum(least, (_FACTORS[:, None] * found[None, k : k + _BLOCK] + _SHIFTS[:, None]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))], dtype=np.uint64)


_SKETCH = "row long, fp long, n int, bands array<long>, print long"


def _sketched(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            sub = batch.slice(k, 200)
            fp, n, least, prints = [], [], [], []
            for t in sub.column(1):
                text = t.as_buffer().to_pybytes()
                found = shingles(text, words)
                prints.append(fingerprint(text, words))
                fp.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                n.append(len(found))
                least.append(bands(found))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()), pa.array(np.concatenate(least).view(np.int64)))
            yield pa.RecordBatch.from_arrays([sub.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), lists, pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["row", "fp", "n", "bands", "print"])


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            sub = batch.slice(k, 200)
            found = [shingles(t.as_buffer().to_pybytes(), words).view(np.int64) for t in sub.column(1)]
            yield pa.RecordBatch.from_arrays([sub.column(0), pa.array(found, pa.list_(pa.int64()))], ["fp", "found"])


def similar(x: Column, y: Column, similarity: float) -> Column:
    """Whether two arrays of distinct values have a Jaccard similarity of ``similarity`` or more."""
    both = F.size(F.array_intersect(x, y))
    return both >= F.lit(similarity) * (F.size(x) + F.size(y) - both)


def fingerprint_stars(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, a_n, b, b_n): a set of each of operator 5's groups, with each other set of the group; prints: fp, n, print.

    The fingerprint of a group's root has a row in ``prints``, so its smallest set can stand for the group.
    """
    heads = materialize(prints.groupBy("print").agg(F.min("fp").alias("a"), F.min_by("n", "fp").alias("a_n")), "distinct-prints")
    roots = components(links(heads.select(F.col("print").alias("fp")), max_bits)).withColumnRenamed("node", "print")
    rooted = prints.join(roots, "print", "left").select(F.col("fp").alias("b"), F.col("n").alias("b_n"), F.coalesce("root", "print").alias("root"))
    return rooted.join(heads.withColumnRenamed("print", "root"), "root").where("a <> b").select("a", "a_n", "b", "b_n")


def _possible(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different groups that share a band or a rare shingle and may reach the similarity.

    placed: (band, fp, n, root) of buckets whose sets are in several groups. A set with m shingles that it can
    share reaches the similarity s with another only if m (1 + s) >= s (n + its n), hence only if m >= s n.
    """
    members = materialize(placed.groupBy("fp").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_set("band")).alias("bands")), "members")
    held = sets.join(members.select("fp"), "fp").select("fp", F.explode("found").alias("shingle"))
    known = held.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    rare = materialize(held.join(known, "shingle"), "rare-shingles")
    own = rare.groupBy("fp").agg(F.count("*").alias("rare"), F.count_if(F.col("df") == 1).alias("alone"))
    left = lambda c: (F.col("n") - F.coalesce(c, F.lit(0))).alias(f"not_{c}")
    members = members.join(own, "fp", "left").select("fp", "n", "root", "bands", left("rare"), left("alone"))
    members = materialize(members.where(F.col("not_alone") >= F.col("n") * F.lit(similarity) - 1e-6), "possible-members")

    def apart(m: str) -> Column:
        """Whether sets of different groups can reach the similarity with ``m`` shingles to share."""
        shared, both = F.least(f"l.{m}", f"r.{m}"), F.col("l.n") + F.col("r.n")
        return (F.col("l.fp") < F.col("r.fp")) & (F.col("l.root") != F.col("r.root")) & (shared * F.lit(1 + similarity) >= both * F.lit(similarity) - 1e-6)

    banded = members.where(F.col("not_rare") >= F.col("n") * F.lit(similarity) - 1e-6).select("fp", "n", "root", "not_rare", "bands", F.explode("bands").alias("band"))
    first = F.array_min(F.array_intersect("l.bands", "r.bands"))  # a pair comes out at one band only
    by_band = banded.alias("l").join(banded.alias("r"), (F.col("l.band") == F.col("r.band")) & apart("not_rare") & (first == F.col("l.band")))
    shared = rare.where("df > 1").select("fp", "shingle").join(members.select("fp", "n", "root", "not_alone"), "fp")
    by_shingle = shared.alias("l").join(shared.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & apart("not_alone"))
    pair = (F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    return by_band.select(*pair).unionByName(by_shingle.select(*pair)).distinct()


def groups(rows: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, group) of ``rows`` (row long, text): rows whose sets are linked by steps of ``similarity`` or more."""
    texts = rows.select("row", text_of("text").cast("binary").alias("text"))
    sketches = materialize(texts.mapInArrow(partial(_sketched, words), _SKETCH), "sketches")
    distinct = sketches.groupBy("fp").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("print").alias("print"))
    # sets of sizes too far apart can't reach the similarity
    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(similarity)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    prints = materialize(distinct.where("n > 0").select("row", "fp", "n", "print"), "prints")
    stars = materialize(fingerprint_stars(prints).where(near("a_n", "b_n")).select("a", "b"), "stars")
    starred = stars.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(prints, "fp").select("row", "fp")
    entries = distinct.where("n > 0").select("row", "fp", "n", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("fp").alias("head"), F.min_by("n", "fp").alias("head_n"), F.count("*").alias("sets")).where("sets > 1")
    entries = materialize(entries.join(shared, "band").select("band", "row", "fp", "n", "head", "head_n"), "buckets")
    members = entries.select("row", "fp").unionByName(starred).distinct()
    sets = texts.join(members, "row").select("fp", "text").mapInArrow(partial(_sets, words), "fp long, found array<long>")
    sets = materialize(sets, "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        one, other = sets.toDF("a", "x"), sets.toDF("b", "y")
        return pairs.join(other, "b").join(one, "a").where(similar(F.col("x"), F.col("y"), similarity)).select("a", "b")

    def split(linked: DataFrame) -> DataFrame:
        """The entries, with the root of each set, of buckets whose sets are in several groups."""
        roots = components(linked).withColumnRenamed("node", "fp")
        placed = entries.join(roots, "fp", "left").select("band", "fp", "n", F.coalesce("root", "fp").alias("root"))
        several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("fp", F.xxhash64("fp", "band")).alias("head")).where("low <> high")
        return materialize(placed.join(several.select("band", "head"), "band"), "split-buckets")

    by_band = entries.where("fp <> head").where(near("n", "head_n")).select(*pair("head", "fp"))
    tried = materialize(by_band.unionByName(stars.select(*pair("a", "b"))).distinct(), "heads")
    linked = materialize(verified(tried), "head-links")
    # once more with another head a bucket, for those that the first left apart
    again = split(linked)
    heads = again.where("fp = head").select("band", F.col("n").alias("head_n"), F.col("root").alias("head_root"))
    more = again.join(heads, "band").where("root <> head_root").where(near("n", "head_n")).select(*pair("head", "fp")).distinct()
    more = materialize(more.join(tried, ["a", "b"], "left_anti"), "more-heads")
    linked = materialize(linked.unionByName(verified(more)), "links")
    rest = materialize(_possible(split(linked), sets, similarity).join(tried.unionByName(more), ["a", "b"], "left_anti"), "rest")
    linked = linked.unionByName(materialize(verified(rest), "rest-links"))
    roots = components(linked).withColumnRenamed("node", "fp")
    return sketches.select("row", "fp").join(roots, "fp", "left").select("row", F.coalesce("root", "fp").alias("group"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that with the smallest id, null ids last; of equal ids that with the smallest hash of its text."""
    names = docs.columns
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("__near_duplicate_row"), *(F.col(c) for c in names)), "rows")
    row = F.col("__near_duplicate_row").alias("row")
    found = groups(rows.select(row, F.col(text).alias("text")), words, similarity)
    order = rows.select(row, F.col(doc_id).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("hash"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "row")).alias("first")
    stay = found.join(order, "row").groupBy("group").agg(first).select(F.col("first.row").alias("__near_duplicate_row"))
    return rows.join(stay, "__near_duplicate_row", "left_semi").select(*names)
