"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_inputs(frames: list[DataFrame | None]) -> DataFrame:
    """Union-all by name of the inputs that exist (absent ones skipped);
    missing columns become null."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no input present")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def head(df: DataFrame, n: int, *order_cols: str) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order; ``n = 0`` keeps all
    rows (ordered). A top-n limit is the feature here, planned as a
    take-ordered (per-partition top-n, then a final merge of n rows each)."""
    ordered = df.orderBy(*order_cols)
    return ordered if n == 0 else ordered.limit(n)
