"""L3 curate and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.operators import filters as flt
from titlelake.operators.quantiles import quantile, quantiles
from titlelake.operators.windows import dedupe_titles, rank_within_channel
from titlelake.plans.curate import CurateConfig, curate, curate_funnel

NORM_SQL = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'))"
RATES_SQL = ("coalesce(case when view_count > 0 then cast(likes as double) / view_count end, 0.0) as like_rate, "
             "coalesce(case when view_count > 0 then cast(comment_count as double) / view_count end, 0.0) as comment_rate")

CURATE_CTES = fx.duckdb_ctes("trending") + f""",
t as (select *, coalesce(try_cast(view_count as double), 0) as vc from trending where channelTitle is not null),
med as (select channelTitle, case when quantile_cont(vc, 0.5) = 0 then 1 else quantile_cont(vc, 0.5) end as m
        from t group by channelTitle),
r as (select t.*, t.vc / med.m as view_rel from t join med using (channelTitle)),
f9 as (select * exclude (rn) from (select *, row_number() over (partition by channelTitle
        order by view_rel desc, video_id, trending_date) as rn from r where view_rel >= 2.0) x where rn <= 20),
e as (select *, {RATES_SQL} from f9),
thr as (select quantile_cont(like_rate, 0.5) as lt, quantile_cont(comment_rate, 0.5) as ct from e where vc >= 10000),
f10 as (select * from e where coalesce(like_rate >= (select lt from thr), true)
        and coalesce(comment_rate >= (select ct from thr), true)),
dd as (select * exclude (dn) from (select *, row_number() over (partition by channelTitle, {NORM_SQL}
        order by vc desc, coalesce(try_cast(likes as double), 0) desc, video_id, trending_date) as dn from f10) y
        where dn = 1)
"""

OUT_SQL = ("video_id, cast(trending_date as varchar) as trending_date, channelTitle, title, view_count, likes, "
           "comment_count, round(like_rate, 6) as like_rate, round(comment_rate, 6) as comment_rate")


def _out(df):
    return df.select("video_id", F.col("trending_date").cast("string").alias("trending_date"), "channelTitle",
                     "title", "view_count", "likes", "comment_count",
                     F.round("like_rate", 6).alias("like_rate"), F.round("comment_rate", 6).alias("comment_rate"))


@register("L3_curate", CURATE_CTES + f"select {OUT_SQL} from dd")
def q_l3(spark, sf):
    return _out(curate(fx.trending(spark, sf)))


@register("A8_channel_median", fx.duckdb_ctes("trending") + """
select channelTitle, round(case when m = 0 then 1 else m end, 6) as channel_median_views, n as rows
from (select channelTitle, quantile_cont(coalesce(try_cast(view_count as double), 0), 0.5) as m, count(*) as n
      from trending where channelTitle is not null group by channelTitle) s""")
def q_a8(spark, sf):
    t = fx.trending(spark, sf).where(F.col("channelTitle").isNotNull())
    vc = F.coalesce(F.col("view_count").try_cast("double"), F.lit(0.0))
    med = quantiles(t.withColumn("vc", vc), ["channelTitle"], {"m": ("vc", 0.5)}, count="rows")
    return med.select(
        "channelTitle", F.round(F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")), 6).alias("channel_median_views"),
        "rows")


@register("F9_virality", CURATE_CTES.split(",\ne as")[0] + "\nselect video_id, cast(trending_date as varchar) as "
          "trending_date, channelTitle, round(view_rel, 6) as view_rel from f9")
def q_f9(spark, sf):
    t = fx.trending(spark, sf)
    tagged = flt.tag_virality(t, ("video_id", "trending_date"))
    return tagged.where("keep_virality").select(
        "video_id", F.col("trending_date").cast("string").alias("trending_date"), "channelTitle",
        F.round("view_rel", 6).alias("view_rel"))


@register("W1_rank_within_channel", fx.duckdb_ctes("trending") + """,
t as (select *, coalesce(try_cast(view_count as double), 0) as vc from trending where channelTitle is not null),
med as (select channelTitle, case when quantile_cont(vc, 0.5) = 0 then 1 else quantile_cont(vc, 0.5) end as m
        from t group by channelTitle)
select video_id, cast(trending_date as varchar) as trending_date, channelTitle,
  row_number() over (partition by channelTitle order by t.vc / med.m desc, video_id, trending_date) as rank_within_channel
from t join med using (channelTitle)""")
def q_w1(spark, sf):
    t = fx.trending(spark, sf).where(F.col("channelTitle").isNotNull())
    vc = F.coalesce(F.col("view_count").try_cast("double"), F.lit(0.0))
    t = t.withColumn("vc", vc)
    med = quantile(t, ["channelTitle"], "vc", 0.5, "m")
    rel = t.join(med, "channelTitle").withColumn(
        "view_rel", F.col("vc") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")))
    r = rank_within_channel(rel, "channelTitle", "view_rel", ["video_id", "trending_date"])
    return r.select("video_id", F.col("trending_date").cast("string").alias("trending_date"), "channelTitle",
                    F.col("rank_within_channel").cast("bigint").alias("rank_within_channel"))


@register("A9_engagement_thresholds", fx.duckdb_ctes("trending") + f"""
select round(quantile_cont(like_rate, 0.5), 6) as like_thr, round(quantile_cont(comment_rate, 0.5), 6) as comment_thr
from (select {RATES_SQL} from trending where coalesce(try_cast(view_count as double), 0) >= 10000) e""")
def q_a9(spark, sf):
    thr = flt.engagement_thresholds(fx.trending(spark, sf))
    return thr.select(F.round("like_thr", 6).alias("like_thr"), F.round("comment_thr", 6).alias("comment_thr"))


@register("F10_engagement", fx.duckdb_ctes("trending") + f""",
e as (select *, {RATES_SQL} from trending),
thr as (select quantile_cont(like_rate, 0.5) as lt, quantile_cont(comment_rate, 0.5) as ct from e
        where coalesce(try_cast(view_count as double), 0) >= 10000)
select video_id, cast(trending_date as varchar) as trending_date, round(like_rate, 6) as like_rate,
  round(comment_rate, 6) as comment_rate
from e where coalesce(like_rate >= (select lt from thr), true) and coalesce(comment_rate >= (select ct from thr), true)""")
def q_f10(spark, sf):
    t = flt.tag_engagement(fx.trending(spark, sf))
    return t.where("keep_engagement").select(
        "video_id", F.col("trending_date").cast("string").alias("trending_date"),
        F.round("like_rate", 6).alias("like_rate"), F.round("comment_rate", 6).alias("comment_rate"))


@register("W2_dedupe_titles", fx.duckdb_ctes("trending") + f"""
select video_id, cast(trending_date as varchar) as trending_date, channelTitle, {NORM_SQL} as norm_title
from (select *, row_number() over (partition by channelTitle, {NORM_SQL}
      order by coalesce(try_cast(view_count as double), 0) desc, coalesce(try_cast(likes as double), 0) desc,
      video_id, trending_date) as dn from trending where channelTitle is not null) x where dn = 1""")
def q_w2(spark, sf):
    from titlelake.functions.text import normalize_title
    d = dedupe_titles(fx.trending(spark, sf), ("video_id", "trending_date"))
    return d.select("video_id", F.col("trending_date").cast("string").alias("trending_date"), "channelTitle",
                    normalize_title("title").alias("norm_title"))


@register("A13_curate_funnel", CURATE_CTES + """
select 0 as step, 'input' as stage, (select count(*) from trending) as rows
union all select 1, 'virality', (select count(*) from f9)
union all select 2, 'engagement', (select count(*) from f10)
union all select 3, 'dedupe', (select count(*) from dd)""")
def q_a13(spark, sf):
    f = curate_funnel(fx.trending(spark, sf), materialize=True)  # four consumers of the survivors
    return f.select(F.col("step").cast("int").alias("step"), "stage", "rows")


@register("O1_curated_order", CURATE_CTES + f"select {OUT_SQL} from dd order by channelTitle, view_rel desc")
def q_o1(spark, sf):
    """O1: curated rows ordered by channel asc, view_rel desc (a range-partitioned sort)."""
    t = fx.trending(spark, sf)
    kept = curate(t, CurateConfig())
    med = quantile(t.where(F.col("channelTitle").isNotNull())
                   .withColumn("vc", F.coalesce(F.col("view_count").try_cast("double"), F.lit(0.0))),
                   ["channelTitle"], "vc", 0.5, "m")
    rel = kept.join(med, "channelTitle").withColumn(
        "view_rel", F.coalesce(F.col("view_count").try_cast("double"), F.lit(0.0))
        / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")))
    return _out(rel.orderBy(F.col("channelTitle"), F.col("view_rel").desc(), "video_id", "trending_date"))


def _all_filters_sql() -> str:
    from titlelake.queries.q_functions import RATIO, STOP, contains_any_sql, tokens_sql
    groups = " or ".join(contains_any_sql("title", pats) for pats in flt.PATTERN_GROUPS.values())
    base = CURATE_CTES.split(",\ndd as (")[0]
    return base + f""",
f6 as (select * from f10 where coalesce(try_cast(categoryId as double) in (22, 23, 24, 26, 27, 28, 19), false)
       and not ({groups})),
f7 as (select * from f6 where length(coalesce(title, '')) between 5 and 120
       and (contains(coalesce(title, ''), '?') or {contains_any_sql('title', flt.HOOK_PHRASES)})
       and not {contains_any_sql('title', flt.GENERIC_PATTERNS)}),
dd as (select * exclude (dn) from (select *, row_number() over (partition by channelTitle, {NORM_SQL}
        order by vc desc, coalesce(try_cast(likes as double), 0) desc, video_id, trending_date) as dn from f7) y
        where dn = 1),
lg as (select * from dd where coalesce(title, '') <> '' and ({RATIO} >= 0.6 or list_has_any({tokens_sql('title')}, {STOP})))
select {OUT_SQL} from lg"""


@register("L3_curate_all_filters", _all_filters_sql())
def q_l3_all(spark, sf):
    """L3 with the optional stages switched on: category/pattern (F5/F6),
    text heuristic (F7) and the English-only language filter (F8)."""
    cfg = CurateConfig(category_pattern=True, text_heuristic=True, english_only=True)
    return _out(curate(fx.trending(spark, sf), cfg))
