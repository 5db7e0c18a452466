"""Per-group ranking, keep-first/last and dedupe.

Top-1 selections are written as ``min_by``/``max_by`` aggregates: they are
partially aggregated before the shuffle, so a key that holds a third of all
rows sends one row per map task, not all of its rows. Top-k (k > 1) uses
``row_number() <= k``, which Spark plans with a partial ``WindowGroupLimit``
ahead of the exchange for the same reason. Every ordering ends in explicit
tie-break columns so results do not depend on input order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlelake.functions.text import normalize_title


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], drop_null_keys: bool = False,
             largest: bool = False) -> DataFrame:
    """Keep, per key, the row that sorts first under ``order`` (a list of
    ascending sort expressions; negate numbers for descending), or last
    when ``largest``.

    Implemented as ``min_by``/``max_by(struct(row), struct(order))``: partial
    and final aggregates (sort-based, since the buffer holds a row), so a hot key
    sends one row per map task.
    """
    src = df
    if drop_null_keys:
        for k in keys:
            src = src.where(F.col(k).isNotNull())
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    okey = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    pick = F.max_by if largest else F.min_by
    return (src.groupBy(*keys).agg(pick(row, okey).alias("__r"))
            .select(*[F.col("__r")[c].alias(c) for c in cols]))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str | None = None) -> DataFrame:
    """W1/W6 core: rows ranked 1..k per key by ``order`` (row_number)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank_col or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def rank_within_channel(df: DataFrame, channel: str, score: str, tie: Sequence[str]) -> DataFrame:
    """1-based rank by ``score`` desc within channel (all rows kept).

    No task sorts a whole channel: rows are ranked among those of equal score
    and equal start of the first tie column; running sums over the counts of
    these runs, first within a bucket of scores and then over a channel's
    buckets, give each run its first rank."""
    from titlelake.operators.quantiles import value_bucket

    s = F.col(score).cast("double")
    bucket = F.when(s.isNull(), F.lit(1 << 62)).otherwise(-value_bucket(s))
    start = F.substring(F.col(tie[0]).cast("string"), 1, 3) if tie and dict(df.dtypes)[tie[0]] == "string" else F.lit("")
    rows = df.withColumns({"__g": F.struct(channel), "__b": bucket, "__p": start})
    run = rows.groupBy("__g", "__b", F.col(score).alias("__s"), "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = lambda part, order: F.sum("__c").over(Window.partitionBy(*part).orderBy(*order)) - F.col("__c")
    buckets = run.groupBy("__g", "__b").agg(F.sum("__c").alias("__c"))
    buckets = buckets.select("__g", "__b", before(["__g"], ["__b"]).alias("__b0"))
    run = run.withColumn("__r0", before(["__g", "__b"], [F.col("__s").desc(), F.col("__p").asc()])).join(buckets, ["__g", "__b"])
    first = run.select(F.struct("__g", "__s", "__p").alias("__run"), (F.col("__b0") + F.col("__r0")).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__run").orderBy(*_cols(tie)))
    ranked = rows.withColumn("__run", F.struct("__g", F.col(score).alias("__s"), "__p")).join(first, "__run")
    return ranked.select(*df.columns, (F.col("__first") + within).cast("int").alias("rank_within_channel"))


def dedupe_titles(df: DataFrame, tie: Sequence[str], channel: str = "channelTitle", title: str = "title",
                  keep_empty_norm: bool = False) -> DataFrame:
    """Per (channel, normalised title) keep the row with the most views,
    then likes, then the first tie-break; without a channel column the
    dedupe is global. Rows with a null channel are dropped (as a pandas
    group-by does). ``keep_empty_norm`` exempts titles that normalise to ''."""
    norm = normalize_title(title)
    work = df.withColumn("__norm", norm)
    vc = F.coalesce(F.col("view_count").try_cast("double"), F.lit(0.0)) if "view_count" in df.columns else F.lit(0.0)
    lk = F.coalesce(F.col("likes").try_cast("double"), F.lit(0.0)) if "likes" in df.columns else F.lit(0.0)
    order = [-vc, -lk] + _cols(tie)
    keys = ([channel] if channel in df.columns else []) + ["__norm"]
    exempt = None
    if keep_empty_norm:
        exempt = work.where(F.col("__norm") == "")
        work = work.where(F.col("__norm") != "")
    if channel in df.columns:
        work = work.where(F.col(channel).isNotNull())
    kept = pick_one(work, keys, order)
    if exempt is not None:
        kept = kept.unionByName(exempt)
    return kept.drop("__norm")


def keep_first(df: DataFrame, key: str, pos: str, drop_blank: bool = True) -> DataFrame:
    """First row (lowest ``pos``) per key; blank keys dropped."""
    src = df.where(F.col(key).isNotNull() & (F.col(key) != "")) if drop_blank else df
    return pick_one(src, [key], [F.col(pos)])


def keep_last(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Last row (highest ``pos``) per key."""
    return pick_one(df, [key], [F.col(pos)], largest=True)


def best_by_score(df: DataFrame, key: str, score: Column, order_cols: Sequence[str]) -> DataFrame:
    """Per key, the best score (struct, larger wins); among equal scores
    the earliest ``order_cols`` (e.g. input rank, line) wins."""
    s = df.withColumn("__score", score)
    order = [-F.col("__score.has"), -F.col("__score.len")] + _cols(order_cols)
    return pick_one(s, [key], order).drop("__score")


def cap_per_group(df: DataFrame, group: str, n: int, views: str, tie: str) -> DataFrame:
    """Top-n rows per group by views desc, id asc; rows without a group pass."""
    free = F.col(group).isNull() | (F.col(group) == "")
    # a row without a group is a group of its own, so one plan ranks all rows
    own = df.withColumns({"__group": F.when(~free, F.col(group)), "__single": F.when(free, F.monotonically_increasing_id())})
    return top_k_per_group(own, ["__group", "__single"], [F.col(views).desc(), F.col(tie)], n).drop("__group", "__single")
