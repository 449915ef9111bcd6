"""Packing pieces of documents into sequences: shortest pack first over the histogram of lengths.

Texts are encoded, cut at every ``max_len`` ids, and written once with each piece's rank among the pieces of
its length and task. Only the histogram of lengths, ``max_len`` rows at most, goes to the driver, where
lengths are placed longest first, each into the open patterns with the most room left. A pattern stands for
many sequences alike, so the result is a list of rank intervals per length; pieces find theirs by length
and rank, which no task needs to hold together.

Defined cases: a null text is an empty text, of one id (the end id); equal rows are packed one by one and
may stand in any order among themselves; null ids are carried; an empty table gives no rows; more columns of
the input are left out.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import materialize, text_of
from .encoding import encoder

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, local_rank long"
#: Interval rows up to this many are broadcast (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SLOTS = 200_000


def _cut(path: str, end_id: int, max_len: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, last, part = encoder(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
    seen = np.zeros(max_len + 1, dtype=np.int64)
    names = [f.split()[0] for f in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            sub, rows = batch.slice(k, 500), []
            for doc, ids in zip(sub.column(0).to_pylist(), enc.encode(sub.column(1).to_pylist()), strict=True):
                data = ids + last
                n = len(data) // 4
                for at in range(0, n, max_len):
                    piece = data[4 * at : 4 * (at + max_len)]
                    length = len(piece) // 4
                    rows.append((doc, at, length, zlib.crc32(piece), n, part, int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, max_len: int = 2048, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document, with its rank among the pieces of its length that its task wrote."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(partial(_cut, tokenizer, end_id, max_len), _PIECES)


def plan_packs(histogram: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals (length, first rank, rank after the last, first sequence, offset), from counts by length.

    Longest lengths first. A length goes to the open pattern with the shortest pack; if fewer pieces are left
    than the pattern has sequences, the pattern is split in two. What finds no room opens new sequences.
    """
    room: list[int] = []  # heap of rooms with open patterns, the largest first
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    closed: list[tuple[int, tuple[int, ...]]] = []

    def add(count: int, pack: tuple[int, ...], left: int) -> None:
        if not left:
            closed.append((count, pack))
            return
        if not open_.get(left):
            open_[left] = []
            heapq.heappush(room, -left)
        open_[left].append((count, pack))

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        n = histogram[length]
        # all of them at once into the shortest packs, several to a pack while it stays the shortest
        while n:
            while room and not open_[-room[0]]:
                heapq.heappop(room)
            if not room or -room[0] < length:
                add(n, (length,), max_len - length)
                break
            left = -room[0]
            count, pack = open_[left].pop()
            used = min(count, n)
            if used < count:
                open_[left].append((count - used, pack))
            elif not open_[left]:
                heapq.heappop(room)
            add(used, (*pack, length), left - length)
            n -= used
    for packs in open_.values():
        closed += packs
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, pack in closed:
        offset = 0
        for length in pack:
            first = next_rank.get(length, 0)
            out.append((length, first, first + count, sequence, offset))
            next_rank[length] = first + count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, max_len: int = 2048, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_length by piece.

    padded_length is what a sequence is padded to: ``max_len``, but a sequence whose ids already number a
    power of two stays as it is.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer, end_id, max_len, doc_id=doc_id, text=text), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    slots = plan_packs(histogram, max_len)
    filled: dict[int, int] = {}
    for length, _, _, first, offset in slots:
        filled[first] = max(filled.get(first, 0), offset + length)
    fields = [("slot_length", IntegerType()), ("lo", LongType()), ("hi", LongType()), ("first", LongType()), ("offset", LongType()), ("sequence_tokens", LongType())]
    plan = spark.createDataFrame([(*s, filled[s[3]]) for s in slots], StructType([StructField(*f) for f in fields]))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    plan = F.broadcast(plan) if len(slots) <= BROADCAST_SLOTS else plan
    placed = ranked.join(plan, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    total = F.col("sequence_tokens")
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", "sequence_tokens",
        F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(F.lit(max_len).cast("long")).alias("padded_length"),
    )
