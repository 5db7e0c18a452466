"""Exact quantiles that never gather a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer.  Here the order statistics are found by value buckets instead:

1. rows are pre-aggregated to ``(group, value) -> count``; the only exchange
   of rows is on (group, value), with partial counts before it, so a hot
   group or a value shared by many rows is spread or summed up first;
2. a bucket is a function of the value alone (1,024 steps for each doubling).
   Counts per bucket, running sums over a group's buckets, and the wanted
   ranks pick one bucket for each rank;
3. the picked bucket is cut into 65,536 equal steps between its own least
   and largest value, and the same picks one step;
4. the distinct values of that step are ranked, which gives the value.

Every level sums before it shuffles, and a window only ever sees the buckets
of a group, the steps of a bucket or the distinct values of a step.  Nothing
is sampled, and results depend neither on partitions nor on exchange reuse nor on size.

All levels read the counts of step 1.  Their join keys can never be null (a group is a
struct, the rest is coalesced), so Spark derives no filter that would
set one reader's plan apart from another's: the three readers are one exchange, and the
source is read and shuffled once.

Interpolation: ``x[lo] + ((n-1)p - lo) * (x[hi] - x[lo])`` -- the pandas,
DuckDB ``quantile_cont`` and Spark ``percentile`` definition. NULL and NaN
inputs are skipped, as pandas does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_DOUBLING = 1024
STEPS_PER_BUCKET = 65_535


def _as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def value_bucket(v: Column) -> Column:
    """Bucket of a double: never falls as the value grows."""
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * STEPS_PER_DOUBLING)).cast("long")


def _never_null(c: Column, kind: str = "long") -> Column:
    return F.coalesce(c, F.lit(0).cast(kind))


def _running(part: Sequence, order: str) -> Column:
    """Count of the rows before this entry, in the order of ``order``."""
    return F.sum("__c").over(Window.partitionBy(*part).orderBy(order)) - F.col("__c")


def quantiles(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple], count: str | None = None) -> DataFrame:
    """Exact quantiles per group.

    ``count`` names a further column: how many values the first spec has in the group
    (null where it has none), which costs no second look at the rows.

    ``specs`` maps output name -> (value column or expression, probability).
    Returns one row per group that has at least one non-null value, with
    ``keys`` plus one DOUBLE column per spec. With ``keys=[]`` the result has
    at most one row (none when there is no value at all). Null keys form a group.
    """
    keys, names = list(keys), list(specs)
    probs = [float(specs[n][1]) for n in names]
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability out of range: {p}")
    # specs over the same values share their counts
    slot: dict[str, int] = {}
    of = [slot.setdefault(str(_as_col(specs[n][0])._jc), len(slot)) for n in names]
    entries = F.array(*[F.struct(F.lit(slot[e]).alias("s"), _as_col(specs[names[of.index(slot[e])]][0]).cast("double").alias("v")) for e in slot])
    wanted = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(probs[i]).alias("p")) for i in range(len(names)) if of[i] == s]) for s in range(len(slot))])
    # Group keys travel as one struct, so null keys join like any other value.
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("g"))
    long = (df.select(group.alias("g"), F.explode(entries).alias("e"))
            .select(F.struct("g", "e.s").alias("__k"), F.col("e.v").alias("__v"))
            .where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    hist = (long.groupBy("__k", _never_null(F.col("__v") + 0.0, "double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
            .withColumn("__b", _never_null(value_bucket(F.col("__v")))))

    # 2: bucket of each wanted rank (w: two ranks, below and above, of each spec)
    buckets = hist.groupBy("__k", "__b").agg(F.sum("__c").alias("__c"), F.min("__v").alias("__lo"),
                                             F.max("__v").alias("__hi"))
    buckets = buckets.withColumns({"__before": _running(["__k"], "__b"), "__n": F.sum("__c").over(Window.partitionBy("__k"))})
    buckets = buckets.withColumn("__q", F.explode(F.element_at(wanted, F.col("__k.s") + 1)))
    buckets = buckets.withColumn("__pos", (F.col("__n") - 1) * F.col("__q.p"))
    ranks = F.explode(F.array(F.struct((F.col("__q.i") * 2).alias("w"), F.floor("__pos").alias("r")),
                              F.struct((F.col("__q.i") * 2 + 1).alias("w"), F.ceil("__pos").alias("r"))))
    buckets = buckets.withColumn("__want", ranks).select("*", "__want.w", "__want.r").drop("__want", "__q")
    here = (F.col("r") >= F.col("__before")) & (F.col("r") < F.col("__before") + F.col("__c"))
    picked = buckets.where(here).select("__k", "__b", "__lo", "__hi", "__pos", "__n", "w", (F.col("r") - F.col("__before")).alias("r"))

    # 3: step within the bucket
    width = F.col("__hi") - F.col("__lo")
    step = F.when((width > 0) & (width < float("inf")),
                  F.floor((F.col("__v") - F.col("__lo")) / width * STEPS_PER_BUCKET)).otherwise(F.lit(0)).cast("long")
    inside = hist.join(picked, ["__k", "__b"]).withColumn("__t", _never_null(step)).withColumn("w", _never_null(F.col("w"), "int"))
    steps = inside.groupBy("__k", "w", "__t").agg(F.sum("__c").alias("__c"), F.first("r").alias("r"))
    steps = steps.withColumn("__before", _running(["__k", "w"], "__t")).where(here)
    steps = steps.select("__k", "w", "__t", (F.col("r") - F.col("__before")).alias("__r"))

    # 4: the value among the distinct values of the step
    values = inside.join(steps, ["__k", "w", "__t"]).withColumn("__before", _running(["__k", "w"], "__v"))
    values = values.where((F.col("__r") >= F.col("__before")) & (F.col("__r") < F.col("__before") + F.col("__c")))
    values = values.select("__k.g", F.floor(F.col("w") / 2).alias("i"), F.col("w") % 2 == 1, "__v", "__pos", "__n").toDF("g", "i", "upper", "__v", "__pos", "__n")
    at = lambda i, upper: F.max(F.when((F.col("i") == i) & (F.col("upper") == upper), F.col("__v")))
    share = lambda i: F.max(F.when(F.col("i") == i, F.col("__pos") - F.floor("__pos")))
    wide = values.groupBy("g").agg(
        *[(at(i, False) + share(i) * (at(i, True) - at(i, False))).alias(f"__q{i}") for i in range(len(names))],
        F.max(F.when(F.col("i") == 0, F.col("__n"))).alias("__count"))
    more = [F.col("__count").alias(count)] if count else []
    return wide.select(*[F.col("g")[k].alias(k) for k in keys], *[F.col(f"__q{i}").alias(m) for i, m in enumerate(names)], *more)


def quantile(df: DataFrame, keys: Sequence[str], value, p: float, name: str = "q") -> DataFrame:
    return quantiles(df, keys, {name: (value, p)})
