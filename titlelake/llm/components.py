"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (partial aggregates) and a join back on the
node, which adaptive execution splits where a node is hot.  No edge list, label or
component reaches the driver: one count and one checksum tell when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp`` for every node of an edge; ``comp`` is the smallest node reachable."""
    now = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = stored(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct(), "cc")
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
