"""Packing by power-of-two decomposition.

A document of n ids is cut into whole sequences of ``size`` ids and then into
the powers of two of what is left, the largest first.  Each piece is a sequence
of its own: its length is a power of two, so it needs no padding, no sequence
crosses documents, and a training run draws its batches from one length's
bucket at a time: every piece names its bucket and has a number within it, and
``write_buckets`` writes a folder for each.  One map pass, no shuffle.

Cases: a null or empty text is one piece that holds the end id alone; a text
of any length is cut whole; repeated rows are packed each for itself; null
identifiers stay null; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import column, doc_rows, pieces, small_batches, texts_of
from titlelake.llm.tokens import tokens


def cuts(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n ids, the largest first."""
    out = [size] * (n // size)
    return out + [1 << k for k in range(size.bit_length() - 1, -1, -1) if n % size >> k & 1]


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 0) -> DataFrame:
    """``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset, bucket, bucket_sequence`` for each piece.

    ``sequence_id`` is the task's number and a running number within it: no two
    pieces share it, and a repeated task gives the same ones.  ``bucket`` is the power of the
    length, ``bucket_sequence`` the task's number and a running number within the bucket."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last = tokens(path), int(end).to_bytes(4, "little")
        number = (TaskContext.get().partitionId()) << 40
        within = [number] * size.bit_length()
        for batch in batches:
            for part in pieces(batch):
                row, start, length, ids, total, bucket, nth = [], [], [], [], [], [], []
                for i, own in enumerate(codec.encode(texts_of(part))):
                    own += last
                    at, n = 0, len(own) // 4
                    for k in cuts(n, size):
                        row.append(i)
                        start.append(at)
                        length.append(k)
                        ids.append(own[4 * at : 4 * (at + k)])
                        total.append(n)
                        power = k.bit_length() - 1
                        bucket.append(power)
                        nth.append(within[power])
                        within[power] += 1
                        at += k
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(total, pa.int64()), pa.array(range(number, number + len(row)), pa.int64()), pa.array([0] * len(row), pa.int64()),
                    pa.array(bucket, pa.int32()), pa.array(nth, pa.int64()),
                ], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket", "bucket_sequence"])
                number += len(row)

    return doc_rows(docs).mapInArrow(cut, f"doc_id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, bucket_sequence bigint")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a batch reads sequences of one length only."""
    packed.write.partitionBy("length").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "bucket_sequence")
