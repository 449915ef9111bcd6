"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Every document gets a repetition count from a Poisson distribution whose mean is the repetition rate that
brings its source to its target share. The count is the inverse of the distribution function at a number
hashed from the seed and the document's id, so it is the same in every run and on every executor. Each
document is exploded by its count, and all copies are dealt out anew in the order of a second hash.

A rate above PART_RATE is a sum of equal parts under it, each inverted at a hashed number of its own: sums of
Poisson counts are Poisson, so the table of the distribution function stays short at any rate, and time grows
with the copies made. Copies come out in blocks; where a source's rate is above BLOCK, its (few) documents'
blocks are dealt to all tasks before they are exploded, so that one document may make most of the result.

Size is ``octet_length(text) + 1`` a document, so a source of empty texts has a size as well.

Defined cases: a null text has size 1; a null source, and every source without a weight of its own, belong
to one common class; documents with equal ids get equal counts, and null ids are hashed by their text; a rate
above MAX_RATE is an error that names the rate; an empty table gives no rows; other columns are carried along.
Columns named ``copy`` or ``shuffle_key`` in the input give way to those of the result, if it is numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_of

#: The most sources that may have a weight of their own; this bounds the table of rates, which is broadcast.
MAX_WEIGHTS = 10_000
#: The largest mean that is inverted at once, and the terms of its distribution function: what is left is under 2^-52.
PART_RATE = 64
TERMS = PART_RATE + 12 * 8 + 40
#: The largest rate: a document's parts are one array of MAX_RATE / PART_RATE numbers.
MAX_RATE = 1 << 26
#: Copies of a document that are exploded at once.
BLOCK = 1 << 12
_HASH_DIGITS = 13
_UNIT = 16.0**_HASH_DIGITS


def _hash(seed: int, *parts: Column) -> Column:
    """52 bits of md5 as a long; DuckDB can compute the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text), 1, _HASH_DIGITS), 16, 10).cast("long")


def _class(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.isin(*weights), source) if weights else F.lit(None).cast("string")


def rates(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float, *, text: str = "text", source: str = "source") -> DataFrame:
    """(class, rate, parts, cdf): at most ``len(weights) + 1`` rows.

    rate = epochs x size of everything x share of the class / size of the class; shares are over the classes
    that occur. cdf holds TERMS values at most of the distribution function of rate / parts.
    """
    if len(weights) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    if min([*weights.values(), rest]) < 0 or epochs <= 0:
        raise ValueError("weights must not be negative, epochs must be positive")
    share = F.lit(float(rest))
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        share = F.coalesce(given[F.col("class")], share)
    sized = (
        docs.select(_class(F.col(source), weights).alias("class"), (F.octet_length(text_of(text)) + F.lit(1)).cast("long").alias("size"))
        .groupBy("class")
        .agg(F.sum("size").alias("size"))
        .withColumn("share", share)
    )
    all_of = sized.agg(F.sum("size").alias("total"), F.sum("share").alias("shares"))  # one row
    rate = F.when(F.col("shares") > 0, F.lit(float(epochs)) * F.col("total") * F.col("share") / F.col("shares") / F.col("size")).otherwise(F.lit(0.0))
    known = sized.join(F.broadcast(all_of)).select("class", rate.alias("rate"))
    too_high = F.raise_error(F.concat(F.lit(f"a repetition rate above {MAX_RATE}: "), F.col("rate").cast("string"))).cast("double")
    known = known.withColumn("rate", F.when(F.col("rate") > MAX_RATE, too_high).otherwise(F.col("rate")))
    known = known.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    term = lambda a, k: a["log"] + F.log(mean) - F.log(k.cast("double"))  # noqa: E731  log of each term: k ln(mean) - mean - ln k!
    step = lambda a, k: F.struct(term(a, k).alias("log"), (a["sum"] + F.exp(term(a, k))).alias("sum"), F.concat(a["cdf"], F.array(a["sum"] + F.exp(term(a, k)))).alias("cdf"))
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cdf"))
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    cdf = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["cdf"])
    return known.select("class", "rate", "parts", F.when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(2.0))).alias("cdf"))


def _inverse(u: Column) -> Column:
    """How many values of ``cdf`` are at most ``u``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(TERMS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get("cdf", a + s - 1) <= u, a + s).otherwise(a))


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    rest: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    numbered: bool = True,
) -> DataFrame:
    """All copies of all documents in a global random order: the input's columns, ``copy`` (from 1) and ``shuffle_key``.

    Unless ``numbered``, the result has the input's columns alone, also those of these two names.

    ``weights``: target share by source; ``rest``: the share of all other sources together; ``epochs``: the
    size of the result, as a multiple of the input's.
    """
    kept = [c for c in docs.columns if not numbered or c not in ("copy", "shuffle_key")]
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), text_of(text)))
    table = materialize(rates(docs, weights, rest, epochs, text=text, source=source), "rates")
    uniform = lambda *parts: (_hash(seed, F.col("key"), *parts) + F.lit(0.5)) / F.lit(_UNIT)
    n = shuffle_partitions(docs.sparkSession)
    # the input's row stays in one column, so that its names meet none of these
    rows = docs.select(F.struct(*kept).alias("row"), _class(F.col(source), weights).alias("of"), key.alias("key"))
    later = F.aggregate(F.sequence(F.lit(2), F.col("parts")), F.lit(0), lambda a, j: a + _inverse(uniform(j.cast("string"))))
    count = _inverse(uniform()) + F.when(F.col("parts") > 1, later).otherwise(0)

    def blocks(of: Column) -> DataFrame:
        counted = rows.join(F.broadcast(table.where(of)), F.col("of").eqNullSafe(F.col("class"))).withColumn("n", count).where("n > 0")
        return counted.select("row", "key", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))).alias("block"))

    few = blocks(F.col("rate") <= BLOCK)
    if not table.where(F.col("rate") > BLOCK).isEmpty():  # by definition of the rate, one part in BLOCK of the result's size
        few = few.unionByName(blocks(F.col("rate") > BLOCK).repartition(n, "key", "block"))
    ends = F.least("n", (F.col("block") + 1) * BLOCK)
    copies = few.select("row", "key", F.explode(F.sequence(F.col("block") * BLOCK + 1, ends)).alias("copy"))
    placed = copies.select("row", "copy", _hash(seed + 1, F.col("key"), F.col("copy").cast("string")).alias("shuffle_key"))
    part = F.floor(F.col("shuffle_key") / F.lit(_UNIT) * n).cast("int")
    dealt = placed.repartitionById(n, part).sortWithinPartitions("shuffle_key", F.col("row")[doc_id], "copy")
    return dealt.select("row.*", "copy", "shuffle_key") if numbered else dealt.select("row.*")
