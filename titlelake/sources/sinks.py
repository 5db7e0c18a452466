"""Writers (K1-K7). Output folders are written by Spark tasks; a replace
never reads and overwrites the same path in one plan."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: header CSV, UTF-8, quotes doubled."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: JSON lines; non-ASCII text written as is."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """K3: append a batch of results to a JSONL dataset."""
    write_jsonl(df, path, mode="append")


def write_id_list(df: DataFrame, path: str, id_col: str = "id", pos_col: str = "pos") -> None:
    """K4: ids in list order, one per line (a range-partitioned sort keeps
    the order across output parts)."""
    df.orderBy(pos_col).select(F.col(id_col).cast("string")).write.mode("overwrite").text(path)


def write_audit_pair(tagged: DataFrame, path: str, keep_col: str = "keep") -> None:
    """K5: kept and removed rows of one tagged plan, partitioned by the flag."""
    df = tagged.withColumn("reasons", F.array_join("reasons", ";")) if "reasons" in tagged.columns else tagged
    (df.write.mode("overwrite").partitionBy(keep_col).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def metrics_json(row: DataFrame, metrics: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """K6: the metrics of each row (all columns without names) as one JSON document string, beside the columns to
    ``keep``; numbers that are not finite are written bare (``NaN``), as Python's json module does."""
    text = F.to_json(F.struct(*(metrics or row.columns)), {"ignoreNullFields": "false"})
    return row.select(*keep, F.regexp_replace(text, r'":"(NaN|-?Infinity)"', '":$1').alias("json"))


def write_metrics_json(row: DataFrame, path: str) -> None:
    metrics_json(row).coalesce(1).write.mode("overwrite").text(path)


def replace_dataset(spark, df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K7: write the new version beside the old one, then swap folders.

    The data is written once; the target is only renamed away when the new
    version is complete, comes back if the second rename fails, and nothing
    is left beside it. ``df`` may read ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = path.rstrip("/")
    mark = uuid.uuid4().hex
    staged, old = f"{target}.__new_{mark}", f"{target}.__old_{mark}"
    fs = hadoop(target).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        df.write.format(fmt).save(staged)
        had = fs.exists(hadoop(target))
        if had and not fs.rename(hadoop(target), hadoop(old)):
            raise OSError(f"{target} could not be renamed")
        if not fs.rename(hadoop(staged), hadoop(target)):
            if had:
                fs.rename(hadoop(old), hadoop(target))
            raise OSError(f"{staged} could not be renamed")
        if had:
            fs.delete(hadoop(old), True)
    finally:
        fs.delete(hadoop(staged), True)
