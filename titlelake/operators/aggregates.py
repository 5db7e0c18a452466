"""Table profiles, counters and summary statistics.

All statistics are single-pass partial aggregates (count, sum, avg,
stddev, min/max, count_if) except quantiles, which use the bounded exact
operator in ``titlelake.operators.quantiles``. Wide one-row results are
turned long with ``unpivot`` (no driver-side loop over data).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.functions.text import title_len
from titlelake.operators.quantiles import quantiles

PROFILE_NUMERIC = ("view_count", "likes", "dislikes", "comment_count")


def shape(df: DataFrame) -> DataFrame:
    """A1: (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def dtypes(df: DataFrame) -> DataFrame:
    """A1: per column its type and its non-null count."""
    one = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"n{i}").alias("non_null"))
            for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_report(df: DataFrame) -> DataFrame:
    """A2: per column, null count and percentage of rows (2 decimals)."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__n"),
                    *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    long = counts.unpivot(["__n"], [f"m{i}" for i in range(len(cols))], "__key", "missing")
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.substring("__key", 2, 10).cast("int") + 1)
    return long.select(names.alias("column"), F.col("missing").cast("bigint").alias("missing"),
                       F.round(F.col("missing") / F.col("__n") * 100, 2).alias("missing_pct"))


def describe(df: DataFrame, cols: Sequence[str] = PROFILE_NUMERIC, digits: int = 2) -> DataFrame:
    """A3: count, mean, sample std, min, 25/50/75 % (linear), max per column,
    rounded; long form, one row per column."""
    cols = [c for c in cols if c in df.columns]
    num = df.select(*[F.col(c).try_cast("double").alias(c) for c in cols])
    basic = num.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
        F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"))])
    q = quantiles(num, [], {f"{c}__{n}": (c, p) for c in cols for n, p in (("p25", .25), ("p50", .5), ("p75", .75))})
    wide = attach_one_row(basic, q)
    rows = [F.struct(F.lit(c).alias("column"),
                     F.col(f"{c}__count").alias("count"),
                     *[F.round(F.col(f"{c}__{s}"), digits).alias(s) for s in ("mean", "std", "min", "p25", "p50", "p75", "max")])
            for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def attach_one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach the single row of ``right`` (a global aggregate: at most one
    row, so a size-bounded broadcast) to every row of ``left``."""
    return left.withColumn("__one", F.lit(1)).join(
        F.broadcast(right.withColumn("__one", F.lit(1))), "__one", "left").drop("__one")


def totals(df: DataFrame, cols: Sequence[str] = PROFILE_NUMERIC) -> DataFrame:
    """A4: column sums (one row)."""
    cols = [c for c in cols if c in df.columns]
    return df.agg(*[F.sum(F.col(c).try_cast("double")).alias(c) for c in cols])


def rate_stats(df: DataFrame) -> DataFrame:
    """A5: like/comment rate mean and median; zero or null views excluded."""
    v = F.when(F.col("view_count").try_cast("double") != 0, F.col("view_count").try_cast("double"))
    rates = df.select((F.col("likes").try_cast("double") / v).alias("lr"),
                      (F.col("comment_count").try_cast("double") / v).alias("cr"))
    means = rates.agg(F.avg("lr").alias("like_rate_mean"), F.avg("cr").alias("comment_rate_mean"))
    meds = quantiles(rates, [], {"like_rate_median": ("lr", .5), "comment_rate_median": ("cr", .5)})
    return attach_one_row(means, meds).select("like_rate_mean", "like_rate_median",
                                               "comment_rate_mean", "comment_rate_median")


def title_len_stats(df: DataFrame, title: str = "title") -> DataFrame:
    """Title length mean / median / min / max (null title -> length 0)."""
    lens = df.select(title_len(title).alias("n"))
    basic = lens.agg(F.avg("n").alias("title_len_mean"), F.min("n").alias("title_len_min"),
                     F.max("n").alias("title_len_max"))
    med = quantiles(lens, [], {"title_len_median": ("n", .5)})
    return attach_one_row(basic, med).select("title_len_mean", "title_len_median", "title_len_min", "title_len_max")


def date_ranges(df: DataFrame, cols: Sequence[str] = ("publishedAt", "trending_date")) -> DataFrame:
    """Min / max per date column (unparsable -> null, skipped)."""
    cols = [c for c in cols if c in df.columns]
    ts = {c: F.try_to_timestamp(F.col(c).cast("string")) for c in cols}
    return df.agg(*[e for c in cols for e in (F.min(ts[c]).alias(f"{c}_min"), F.max(ts[c]).alias(f"{c}_max"))])


def rows_per_year(df: DataFrame, col: str = "publishedAt") -> DataFrame:
    """Rows per publish year, sorted by year."""
    y = F.year(F.try_to_timestamp(F.col(col).cast("string")))
    return df.where(y.isNotNull()).groupBy(y.alias("year")).agg(F.count(F.lit(1)).alias("rows")).orderBy("year")


def value_counts(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """A10: top-k values by count (nulls skipped), ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)).limit(k))


def mean_std_columns(specs: Mapping[str, Column | str]) -> list[Column]:
    """The aggregates of ``mean_std``, for callers that take others in the same pass."""
    outs = []
    for name, e in specs.items():
        c = F.col(e) if isinstance(e, str) else e
        fin = F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
        n = F.count(fin)
        outs.append(F.when(n > 0, F.avg(fin)).otherwise(F.lit(float("nan"))).alias(f"{name}_mean"))
        outs.append(F.when(n > 1, F.stddev_pop(fin)).when(n == 1, F.lit(0.0))
                    .otherwise(F.lit(float("nan"))).alias(f"{name}_std"))
    return outs


def mean_std(df: DataFrame, specs: Mapping[str, Column | str]) -> DataFrame:
    """NaN-safe mean and population std per named expression over
    finite values; one value -> std 0, none -> NaN for both."""
    return df.agg(*mean_std_columns(specs))
