"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` smallest distinct shingle hashes.  The sketch of a union is the
``k`` smallest of both sketches, so parts merge in any order; two sketches
estimate resemblance and containment, one the number of distinct shingles.
Sets of at most ``k`` shingles are held whole, and estimates are then exact.

Cases: a null, empty or wordless text has the empty sketch, which is like
another empty one (1) and unlike all others (0); fewer words than a shingle
make one shingle; equal texts have equal fingerprints; repeated rows follow one
another; a table of one row is its own next document; an empty table gives an
empty result; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import bytes_of, column, doc_rows, pieces, range_of, small_batches, split_points, text_key
from titlelake.llm.shingles import shingle_set

WORDS, SIZE = 5, 128
#: Ranges of documents at most; their heads (one row each) are broadcast.
MOST_RANGES = 20_000


def sketch(text: str, words: int = WORDS, k: int = SIZE) -> np.ndarray:
    """The ``k`` smallest hashes, ascending (distinct hashes come sorted)."""
    return shingle_set(text, words)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Share of the union's sketch that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = SIZE) -> float:
    """Distinct shingles: the count itself below ``k``, else from the largest hash kept."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Share of a's shingles that b holds: the overlap from resemblance and the union's count, over a's count."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def fingerprints(docs: DataFrame, words: int = WORDS, k: int = SIZE) -> DataFrame:
    """``doc_id, fingerprint, n_distinct`` of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(t or "", words, k) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([to_text(s) for s in own]), pa.array([distinct(s, k) for s in own])], ["doc_id", "fingerprint", "n_distinct"])

    return doc_rows(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string, n_distinct double")


def merged(prints: DataFrame, *keys: str, k: int = SIZE, salts: int = 64) -> DataFrame:
    """One ``fingerprint`` for each group of the columns ``keys``.

    Each task merges what it reads of a group before the shuffle, and groups meet dealt over ``salts`` first,
    so a hot group is never more than ``salts`` sketches in one place."""
    kinds = ", ".join(f"{c} {prints.schema[c].dataType.simpleString()}" for c in keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, np.ndarray] = {}
            for *key, s in zip(*(column(batch, c).to_pylist() for c in (*keys, "fingerprint"))):
                own = from_text(s or "")
                held[tuple(key)] = merge(held[tuple(key)], own, k) if tuple(key) in held else own
            cols = list(zip(*held)) if held else [()] * len(keys)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, batch.schema.field(n).type) for c, n in zip(cols, keys)), pa.array([to_text(x) for x in held.values()], pa.string())], [*keys, "fingerprint"])

    def together(frame):
        import pandas as pd

        out = np.zeros(0, np.uint64)
        for s in frame["fingerprint"]:
            out = merge(out, from_text(s), k)
        return pd.DataFrame([[*(frame[c].iloc[0] for c in keys), to_text(out)]], columns=[*keys, "fingerprint"])

    schema = f"{kinds}, fingerprint string"
    part = prints.select(*keys, "fingerprint").mapInArrow(fold, schema).withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)))
    return part.groupBy(*keys, "salt").applyInPandas(together, schema).groupBy(*keys).applyInPandas(together, schema)


def with_next(docs: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """``part, doc_id, tk, text, ahead``: each range of identifiers descending, and after
    it (``ahead`` 1) the first document of what follows.

    The ranges are cut at explicit values, so a document's neighbour is the
    adjacent row of one task; only the head of each range travels twice."""
    own = doc_rows(docs)
    parts = max(1, min(MOST_RANGES, -(-bytes_of(own) // range_bytes)))
    own = own.withColumn("tk", text_key())
    points = split_points(own.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id", parts)
    own = own.withColumn("part", range_of("doc_id", points))
    heads = {r["part"]: (r["h"]["doc_id"], r["h"]["tk"]) for r in own.groupBy("part").agg(F.max(F.struct("doc_id", "tk")).alias("h")).collect()}  # a row for each range
    order = sorted(heads, reverse=True)
    above = dict(zip(order, order[-1:] + order[:-1]))  # the range whose last document is followed by this head
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = spark.createDataFrame([(*heads[p], above[p]) for p in order] or [], f"h_id {kind}, h_tk bigint, target int")
    marked = own.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tk") == F.col("h_tk")), "left")
    places = F.when(F.col("target").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("ahead")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(0).alias("ahead")), F.struct(F.col("target").alias("part"), F.lit(1).alias("ahead"))))
    return marked.select("doc_id", "tk", "text", F.explode(places).alias("p")).select("p.part", "p.ahead", "doc_id", "tk", "text").repartitionById(
        parts, F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").desc(), F.col("tk").desc())


def edited(text: str, after: str) -> str:
    """The last half of the code points gives way to as many of the next text's first ones (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_neighbours(docs: DataFrame, words: int = WORDS, k: int = SIZE) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document's."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, doc_id, text, sketch
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for part, ahead, doc_id, text in zip(*(column(piece, c).to_pylist() for c in ("part", "ahead", "doc_id", "text"))):
                    own = sketch(text, words, k)
                    if last is not None and last[0] == part:
                        new = edited(last[2], text)
                        other = sketch(new, words, k)
                        rows.append((last[1], len(last[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_text(last[3]), to_text(other),
                                     resemblance(last[3], other, k), resemblance(last[3], own, k)))
                    last = None if ahead else (part, doc_id, text, own)
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], piece.schema.field("doc_id").type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])],
                                                     ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
