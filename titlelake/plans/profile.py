"""L1 ``profile``: the table profile as one long (section, key, value) frame
(A1-A7, A10). Each part is also callable on its own from
``titlelake.operators.aggregates``.

All scalar statistics (shape, types, missing counts and percentages, date
ranges as Unix seconds, describe, totals, engagement means, title-length
mean/min/max) come from ONE aggregate pass; all medians and quartiles share
one exact-quantile pipeline, which counts the values of each column once; the per-year
and top-k value counts are one keyed aggregate. So the table is read three times, whatever its columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.functions.text import title_len
from titlelake.operators import aggregates as agg
from titlelake.operators.quantiles import quantiles
from titlelake.operators.windows import top_k_per_group


def profile(df: DataFrame, top_k: int = 20) -> DataFrame:
    """Numeric profile sections of the trending table in long form."""
    cols = df.columns
    num = [c for c in agg.PROFILE_NUMERIC if c in cols]
    entries = [("shape", "rows", F.count(F.lit(1)).cast("double")),
               ("shape", "columns", F.lit(float(len(cols))))]
    entries += [("missing", c, F.count_if(F.col(c).isNull()).cast("double")) for c in cols]
    entries += [("missing_pct", c, F.round(F.count_if(F.col(c).isNull()) / F.count(F.lit(1)) * 100, 2)) for c in cols]
    entries += [("dtypes", f"{c}:{t}", F.lit(1.0)) for c, t in df.dtypes]
    for c in ("publishedAt", "trending_date"):
        if c in cols:
            at = F.try_to_timestamp(F.col(c).cast("string"))
            entries += [("date_range", f"{c}_{k}", F.unix_seconds(f(at)).cast("double")) for k, f in (("min", F.min), ("max", F.max))]
    for c in num:
        x = F.col(c).try_cast("double")
        entries += [("describe", f"{c}_{k}", e) for k, e in (
            ("count", F.count(x).cast("double")), ("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x)))]
    entries += [("totals", c, F.sum(F.col(c).try_cast("double"))) for c in num]
    medians = {}
    if "view_count" in cols:
        v = F.col("view_count").try_cast("double")
        v = F.when(v != 0, v)
        for src, name in (("likes", "like_rate"), ("comment_count", "comment_rate")):
            if src in cols:
                r = F.col(src).try_cast("double") / v
                entries.append(("engagement", f"{name}_mean", F.avg(r)))
                medians[f"{name}_median"] = ("engagement", r)
    if "title" in cols:
        n = title_len("title")
        entries += [("title_len", "title_len_mean", F.avg(n)),
                    ("title_len", "title_len_min", F.min(n).cast("double")),
                    ("title_len", "title_len_max", F.max(n).cast("double"))]
        medians["title_len_median"] = ("title_len", n)
    one = df.agg(*[e.alias(f"v{i}") for i, (_, _, e) in enumerate(entries)])
    names = [(s, k, f"v{i}") for i, (s, k, _) in enumerate(entries)]
    if medians:
        specs = {k: (e, 0.5) for k, (_, e) in medians.items()}
        for c in num:
            for k, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
                specs[f"{c}_{k}"] = (F.col(c).try_cast("double"), p)
                medians[f"{c}_{k}"] = ("describe", None)
        q = quantiles(df, [], specs)
        one = agg.attach_one_row(one, q)
        names += [(s, k, k) for k, (s, _) in medians.items()]
    parts = [one.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.col(c).cast("double").alias("value"))
        for s, k, c in names])).alias("r")).select("r.*")]
    counted = value_sections(df, top_k)
    return reduce(DataFrame.unionByName, parts if counted is None else [*parts, counted])


def value_sections(df: DataFrame, top_k: int) -> DataFrame | None:
    """Videos per year and the most frequent categories and channels, counted in one pass; None without any such column."""
    found = {}
    if "publishedAt" in df.columns:
        found["videos_per_year"] = F.year(F.try_to_timestamp(F.col("publishedAt").cast("string")))
    for col, section in (("categoryId", "category_counts"), ("channelTitle", "top_channels")):
        if col in df.columns:
            found[section] = F.col(col)
    if not found:
        return None
    entries = F.array(*[F.struct(F.lit(s).alias("section"), c.cast("string").alias("key"), order.alias("order"))
                        for s, c in found.items() for order in [_order(c, df, s)]])
    counts = (df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("key").isNotNull())
              .groupBy("section", "key", "order").agg(F.count(F.lit(1)).cast("double").alias("value")))
    # all years, and of the others the ``top_k`` most frequent: ties by value, numbers as numbers
    ranked = top_k_per_group(counts.where("section <> 'videos_per_year'"), ["section"], [F.col("value").desc(), F.col("order"), F.col("key")], top_k)
    return counts.where("section = 'videos_per_year'").unionByName(ranked).select("section", "key", "value")


def _order(c, df: DataFrame, section: str):
    numeric = section == "category_counts" and dict(df.dtypes)["categoryId"] != "string"
    return c.cast("double") if numeric else F.lit(None).cast("double")
