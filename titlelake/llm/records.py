r"""Token ids in length-delimited binary records, with a separate offset index.

A record is a frame: payload length (unsigned 64-bit), masked CRC-32 of those
eight bytes, payload, masked CRC-32 of the payload, and one line feed that
ends it; all numbers are little-endian.  A checksum is masked by rotating it
right by 15 bits and adding a constant, so that a checksum over bytes that
hold checksums stays sound.  (CRC-32 as zlib computes it: it runs at C speed
in every worker, where the Castagnoli variant would need another library.)
The payload is an identifier, a width in bytes, and the ids at that width.

The frames are written by Spark's own text writer, whose line separator is
the frame's last byte: its committer publishes whole files only, to any
store that Spark reaches, and a lost executor repeats its task.  Files hold
ranges of ascending ``doc_id`` and are numbered in that order.  The index is a
Parquet table of every record's file, byte offset and size, with the ids
before it in its file: a shuffled read fetches any record by itself.

Cases: a null or empty text is a record of the end id alone; null
identifiers sort first; rows of one identifier are ordered by a hash of their
text and rows equal in both are equal records; a text of any length is one
record; an empty table writes no file and reads back no row; a damaged or cut
file raises an error that names it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlelake.llm.common import bytes_of, column, doc_rows, pieces, shared_path, small_batches, split_points, text_key, texts_of
from titlelake.llm.tokens import forget, tokens

# Fixed values of the file format.
MASK_ADD = 0xA282EAD8
HEAD, TAIL, LEAD = struct.Struct("<QI"), struct.Struct("<IB"), struct.Struct("<qBB")
LINE_FEED = 10


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A record but for its line feed, which the writer adds.  ``ids``: little-endian unsigned 32-bit, stored at ``width`` bytes each."""
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
    payload = LEAD.pack(doc_id or 0, doc_id is None, width) + body
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def frames(data: bytes, name: str = "") -> Iterator[tuple[int, int, int | None, bytes]]:
    """``offset, size, doc_id, ids`` of each record, both checksums verified."""
    view, at = memoryview(data), 0
    while at < len(view):
        try:
            size, check = HEAD.unpack_from(view, at)
            if check != masked(bytes(view[at : at + 8])):
                raise ValueError("length")
            body = at + HEAD.size
            whole = HEAD.size + size + TAIL.size
            if at + whole > len(view):
                raise ValueError("end")
            number, none, width = LEAD.unpack_from(view, body)
            doc_id = None if none else number
            payload = bytes(view[body : body + size])
            if TAIL.unpack_from(view, body + size) != (masked(payload), LINE_FEED):
                raise ValueError("payload")
            ids = payload[LEAD.size :]
            yield at, whole, doc_id, ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
        except (ValueError, struct.error) as e:
            raise ValueError(f"damaged record at byte {at} of {name}: {e}") from e
        at += whole


def write_records(docs: DataFrame, tokenizer: str, path: str, end: int = 0, file_bytes: int = 16 << 20) -> None:
    """Encode each text, append ``end`` and write the records under ``path``
    in ascending ``doc_id`` order, for about ``file_bytes`` of text a file."""
    small_batches(docs.sparkSession)
    parts = max(1, -(-bytes_of(docs) // file_bytes))
    own = doc_rows(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    points = np.array(split_points(own, "doc_id", parts), dtype=np.int64)
    first = np.iinfo(np.int64).min  # where null identifiers go

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last = tokens(tokenizer), int(end).to_bytes(4, "little")
        width = 2 if codec.size <= 1 << 16 else 4
        for batch in batches:
            for part in pieces(batch):
                ids = codec.encode(texts_of(part))
                doc_ids = column(part, "doc_id")
                place = np.searchsorted(points, doc_ids.fill_null(first).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([
                    pa.array(place, pa.int32()), doc_ids, column(part, "tk"), pa.array([frame(d, x + last, width) for d, x in zip(doc_ids.to_pylist(), ids)], pa.binary()),
                ], ["part", "doc_id", "tk", "frame"])

    framed = own.withColumn("tk", text_key()).mapInArrow(encode, "part int, doc_id bigint, tk bigint, frame binary")
    ordered = framed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "tk")
    ordered.select("part", F.col("frame").cast("string").alias("value")).write.partitionBy("part").option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def build_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Read every file once, verify both checksums of each record, and write and return
    ``part, path, offset, size, doc_id, n_tokens, before, ids_crc32``: where a record is, its
    number of ids, the ids before it in its file, and the CRC-32 of its ids as
    little-endian unsigned 32-bit integers."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the encoder's words; this worker reads now
        for batch in batches:
            for path, data in zip(column(batch, "path").to_pylist(), column(batch, "content")):
                found = [(at, size, doc_id, len(ids) // 4, zlib.crc32(ids)) for at, size, doc_id, ids in frames(data.as_buffer(), path)]
                cols = list(zip(*found)) or [()] * 5
                n = np.array(cols[3], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part_of(path)] * len(found), pa.int32()), pa.array([path] * len(found), pa.string()), pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(n), pa.array(np.cumsum(n) - n), pa.array(cols[4], pa.int64()),
                ], ["part", "path", "offset", "size", "doc_id", "n_tokens", "before", "ids_crc32"])

    _files(spark, path).mapInArrow(entries, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


INDEX = "part int, path string, offset bigint, size bigint, doc_id bigint, n_tokens bigint, before bigint, ids_crc32 bigint"


def part_of(path: str) -> int:
    """The range's number, from the folder that holds the file."""
    return int(path.rsplit("/part=", 1)[1].split("/", 1)[0])


def read_records(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """``part, offset, doc_id, ids`` of every record, both checksums verified;
    ``wanted`` (rows of the index, in any order) gives those records only."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(column(batch, "path").to_pylist(), column(batch, "content")):
                at, size, ids, held = [], [], [], []
                for offset, _, doc_id, own in frames(data.as_buffer(), path):
                    at.append(offset)
                    ids.append(doc_id)
                    held.append(own)
                part = part_of(path)
                for lo, hi in spans([len(x) for x in held], 4 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array([part] * (hi - lo), pa.int32()), pa.array(at[lo:hi], pa.int64()), pa.array(ids[lo:hi], pa.int64()), pa.array(held[lo:hi], pa.binary())], ["part", "offset", "doc_id", "ids"])

    schema = "part int, offset bigint, doc_id bigint, ids binary"
    if wanted is None:
        return _files(spark, path).mapInArrow(parse, schema)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data, at in zip(column(batch, "path").to_pylist(), column(batch, "content"), column(batch, "at").to_pylist()):
                view, got = memoryview(data.as_buffer()), []
                for x in at:
                    got += [(x["offset"], *y[2:]) for y in frames(view[x["offset"] : x["offset"] + x["size"]], path)]
                yield pa.RecordBatch.from_arrays([pa.array([part_of(path)] * len(got), pa.int32()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.binary())], ["part", "offset", "doc_id", "ids"])

    lists = wanted.groupBy("path").agg(F.collect_list(F.struct("offset", "size")).alias("at"))  # a file's records at most
    return _files(spark, path).join(lists, "path").mapInArrow(pick, schema)


def spans(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of about ``budget`` bytes, one entry at least."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > budget:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def starts(index: DataFrame) -> DataFrame:
    """``part, base``: ids in the files before each file (a running sum over one row for each file)."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def encode_and_read_back(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "records")
    write_records(docs, tokenizer, f"{path}/data")
    index = build_index(spark, f"{path}/data", f"{path}/index")
    return index.join(starts(index), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
