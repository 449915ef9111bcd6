"""Token ids as length-delimited binary records, with a separate offset index.

A record is::

    u64  length of the payload          all numbers little-endian
    u32  masked crc32 of those 8 bytes
         payload: u8 1 if there is an id, else 0; i64 document id; u8 bytes of an id, 2 or 4; ids
    u32  masked crc32 of the payload
    u8   10, the end of the record

masked(c) = rotate right by 15 bits, plus 0xA282EAD8, as checksums of data that hold checksums are masked.
Files go through Spark's own text writer: each row is one framed record and its line end the last byte, so
files are committed once per task on whatever store holds the shared folder. Files are in the order of
(id, text hash, text); their number follows the size of the texts, so that one file fits a task. Each task
writes its part of the index in the same commit: a file of the same name below ``kind=index``, with a line for
each record (id, offset, length and number of ids, by tabs), which shuffled reads seek by.

Defined cases: a null text is an empty text; null ids come first; rows with equal ids are all kept, in the
order of text hash and text, equal rows in one file, whose size must stay under 2 GB; an empty table gives an
empty folder and an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch_path, shuffle_partitions, text_of
from .encoding import encoder

#: Bytes of text behind one file.
FILE_BYTES = 32 << 20
_MASK = 0xA282EAD8  # fixed value of the masking rule
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<BqB")
_CRC = struct.Struct("<I")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its last byte. Ids take 2 bytes where all of them fit."""
    width = 4 if len(ids) and ids.max() > 0xFFFF else 2
    payload = _PAYLOAD.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, _CRC.pack(masked(zlib.crc32(length))), payload, _CRC.pack(masked(zlib.crc32(payload)))))


class CorruptRecord(ValueError):
    """A length or checksum of a record doesn't hold."""


def record_at(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, position after the record) of the record that starts at ``at``."""
    if at + _HEAD.size > len(data):
        raise CorruptRecord(f"cut off at byte {at}")
    length, crc = _HEAD.unpack_from(data, at)
    if masked(zlib.crc32(data[at : at + 8])) != crc:
        raise CorruptRecord(f"length at byte {at}")
    start, end = at + _HEAD.size, at + _HEAD.size + length
    if end + 5 > len(data) or masked(zlib.crc32(data[start:end])) != _CRC.unpack_from(data, end)[0] or data[end + 4] != 10:
        raise CorruptRecord(f"payload at byte {start}")
    has, doc_id, width = _PAYLOAD.unpack_from(data, start)
    ids = np.frombuffer(data[start + _PAYLOAD.size : end], dtype=f"<u{width}").astype("<u4")
    return doc_id if has else None, ids, end + 5


def _frames(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's records in order, and then the lines of its index."""
    enc, last = encoder(path), _CRC.pack(end_id)  # an id is 4 bytes as well
    lines, at = [], 0

    def rows(kind: str, values: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(values)), pa.array(values, pa.binary())], ["kind", "frame"])

    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            framed = []
            for d, x in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                framed.append(frame(d, np.frombuffer(x + last, dtype="<u4")))
                size = len(framed[-1]) + 1  # with the line end
                lines.append(b"%b\t%d\t%d\t%d" % (b"" if d is None else b"%d" % d, at, size, len(x) // 4 + 1))
                at += size
            yield rows("records", framed)
    for k in range(0, len(lines), 10_000):
        yield rows("index", lines[k : k + 10_000])


def _estimated_bytes(docs: DataFrame) -> int:
    """Twice what the planner takes for the size, since files are compressed; counted where it can't tell."""
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess < 1 << 50:
        return 2 * guess
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Both files of a task stay open, so that its rows are written as they come instead of being sorted."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write records in ascending id order, and their index, below ``path``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    size = _estimated_bytes(docs)
    n = max(shuffle_partitions(docs.sparkSession), -(-size // FILE_BYTES))
    ordered = (
        docs.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("h"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
        .select("doc_id", "text")
    )
    framed = ordered.mapInArrow(partial(_frames, tokenizer, end_id), "kind string, frame binary").select("kind", F.col("frame").cast("string").alias("value"))
    with _in_order(docs.sparkSession):  # one file of a kind a task, as it is: places are offsets into it
        framed.write.partitionBy("kind").option("lineSep", "\n").option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def _folder(spark: SparkSession, path: str, kind: str) -> str | None:
    """The files of a kind; None if there are none, since no task had rows."""
    jvm, place = spark.sparkContext._jvm, f"{path.rstrip('/')}/kind={kind}"
    at = jvm.org.apache.hadoop.fs.Path(place)
    return place if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "part", "doc_id", "offset", "length", "local_start", "n_tokens", "ids_crc32"]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]
    for batch in batches:
        for k in range(batch.num_rows):
            path, data = batch.column(0)[k].as_py(), memoryview(batch.column(1)[k].as_buffer())
            file = path.rsplit("/", 1)[-1]
            part, at, before, rows = int(file.split("-")[1]), 0, 0, []
            while at < len(data):
                found, ids, after = record_at(data, at)
                rows.append((file, part, found, at, after - at, before, len(ids), zlib.crc32(ids)))
                before += len(ids)
                at = after
                if len(rows) == 10_000 or at == len(data):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []


_SCAN = "file string, part int, doc_id long, offset long, length long, local_start long, n_tokens long, ids_crc32 long"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back, check every length and checksum, and return a row for each record with its place."""
    place = _folder(spark, path, "records")
    if place is None:
        return spark.createDataFrame([], _SCAN)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(place)
    return files.select("path", "content").mapInArrow(_scan, _SCAN)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, doc_id, offset, length, n_tokens) as the index says; no record is read."""
    place = _folder(spark, path, "index")
    if place is None:
        return spark.createDataFrame([], "file string, part int, doc_id long, offset long, length long, n_tokens long")
    lines = spark.read.schema("doc_id long, offset long, length long, n_tokens long").csv(place, sep="\t")
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return lines.select(file.alias("file"), F.split(file, "-")[1].cast("int").alias("part"), "doc_id", "offset", "length", "n_tokens")


def with_starts(places: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all records before, over all files. One row a file meets in one task."""
    files = places.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("part", "file")) - F.col("n")).alias("base"))
    return places.join(before, "file").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def _seek(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    opened: dict[str, pa.NativeFile] = {}
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns), strict=True):
                if file not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[file] = fs.open_input_file(f"{root}/{file}")
                data = opened[file].read_at(length, offset)
                found, ids, after = record_at(memoryview(data), 0)
                if after != length:
                    raise CorruptRecord(f"{file} at byte {offset}: not the length that the index gives")
                rows.append((found, ids.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(doc_id, ids binary) of all records, in a random order given by ``seed`` alone.

    Only the index is shuffled; each task then seeks its records in the order of their ranks, through the file
    system library of Arrow (local, HDFS and object stores), and holds one at a time.
    """
    place = _folder(spark, path, "records")
    if place is None:
        return spark.createDataFrame([], "doc_id long, ids binary")
    index = read_index(spark, path).withColumn("rank", F.xxhash64(F.lit(seed), F.col("part"), F.col("offset")))
    dealt = index.repartition(shuffle_partitions(spark), "rank").sortWithinPartitions("rank").select("file", "offset", "length")
    uri = place.replace("file:///", "/").replace("file:/", "/")
    return dealt.mapInArrow(partial(_seek, f"file://{uri}" if uri.startswith("/") else uri), "doc_id long, ids binary")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the records and their index, read all records back, and return their places with ``start``.

    ``path``: where they stay; without one they are removed when the driver ends.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "records")
    write_records(docs, path, tokenizer, end_id)
    return with_starts(materialize(read_records(spark, path), "places"))
