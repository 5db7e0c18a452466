"""Key joins.

Id-set membership is expressed as ``left_semi`` / ``left_anti`` joins so
Spark can pick the strategy: AQE turns a join into a broadcast only when the
measured size of the id side is under the broadcast threshold, and otherwise
keeps a shuffle join (with skew splitting). Ids are compared after strip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.functions.text import safe_strip


def _ids(ids: DataFrame, col: str = "video_id") -> DataFrame:
    return (ids.select(safe_strip(col).alias("__id")).where(F.col("__id") != "").distinct())


def _key(df: DataFrame, col: str, stripped: bool):
    # A column that is already stripped joins as is, so a later aggregate on
    # it can reuse the join's hash partitioning instead of shuffling again.
    return df[col] if stripped else safe_strip(df[col])


def semi_by_id(df: DataFrame, ids: DataFrame, col: str = "video_id", id_col: str = "video_id",
               stripped: bool = False) -> DataFrame:
    """Rows whose stripped id is in ``ids`` (duplicates in ``df`` kept)."""
    return df.join(_ids(ids, id_col), _key(df, col, stripped) == F.col("__id"), "left_semi")


def anti_by_id(df: DataFrame, ids: DataFrame, col: str = "video_id", id_col: str = "video_id",
               stripped: bool = False) -> DataFrame:
    """Rows whose stripped id is not in ``ids``."""
    return df.join(_ids(ids, id_col), _key(df, col, stripped) == F.col("__id"), "left_anti")


def ordered_lookup(ids: DataFrame, data: DataFrame, id_col: str = "id", data_pos: str | None = None) -> DataFrame:
    """Rows of ``data`` for an ordered id list ``ids(pos, id)``: list
    order and list duplicates kept, missing ids skipped; when ``data`` has
    several rows per id the last (highest ``data_pos``) wins."""
    if data_pos is not None:
        from titlelake.operators.windows import keep_last
        data = keep_last(data, id_col, data_pos)
    return ids.join(data, id_col, "inner")
