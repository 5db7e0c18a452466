"""Helpers shared by the operators of this subpackage.

Documents are rows with a ``doc_id`` and a ``text``.  Operators read only the
columns they name, so extra columns never clash with their own.  A null text
counts as the empty text.  A document is a row; rows that repeat a ``doc_id``
are told apart by a hash of their text where results are joined back, and
rows equal in both get equal results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelake.session import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch; long texts make batches shorter, never dropped.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks receive, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/titlelake-{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no result reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear_stored(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``stored`` wrote in this session (after the first
    ``since``); call it when no result that reads them is needed any more."""
    while len(_written) > since:
        discard(spark, _written.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts lineage as ``checkpoint()`` does (a lost executor costs a re-read)
    and keeps column pruning for the readers.  Results are lazy and read these
    tables, so they stay until ``clear_stored``.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    return len(_written)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``stored``, and the tables written after the first ``since``, which only ``df`` reads, are deleted."""
    out = stored(df, name)
    own = _written.pop()
    clear_stored(df.sparkSession, since)
    _written.append(own)
    return out


def doc_rows(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and the named columns only."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_key(text: Column | str = "text") -> Column:
    """Tells rows of the same ``doc_id`` apart when results are joined back."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Null-safe equality of the named columns."""
    out = None
    for k in keys:
        one = left[k].eqNullSafe(right[k])
        out = one if out is None else out & one
    return out


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batch: pa.RecordBatch, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``budget`` bytes (one row at least)."""
    rows = batch.num_rows
    step = max(1, min(rows, rows * budget // max(1, batch.nbytes)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def split_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` values that cut ``key`` into ranges of about equal
    row counts.  Explicit values (not a sampled range shuffle): every reader
    of the same values agrees on a row's range, and nothing upstream runs twice."""
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, probs, max(10_000, 20 * parts)).alias("p")).first()["p"]
    return sorted(set(got or []))


def range_of(key: str, points: Iterable[int]) -> Column:
    """Number of the range that ``key`` falls in (null: range 0), ascending.

    Only the key goes through Python, as one ``searchsorted`` per batch."""
    at = np.array(sorted(points), dtype=np.int64)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        none = x.isna()
        vals = x.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy() if none.any() else x.to_numpy()
        return pd.Series(np.searchsorted(at, vals, side="left").astype("int32"))

    return place(F.col(key)) if len(at) else F.lit(0)


def bytes_of(docs: DataFrame) -> int:
    """Bytes of all texts: sizes partitions (a plain aggregate; one number reaches the driver)."""
    return int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
