"""L1 profile and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.operators import aggregates as agg
from titlelake.plans.profile import profile

TR = fx.duckdb_ctes("trending")
TR_COLS = ["doc_id", "video_id", "title", "publishedAt", "channelId", "channelTitle", "categoryId",
           "trending_date", "tags", "view_count", "likes", "comment_count", "description"]
TR_TYPES = ["bigint", "string", "string", "timestamp", "string", "string", "int", "date", "string", "bigint",
            "bigint", "bigint", "string"]
NUM = ["view_count", "likes", "comment_count"]


def _r(x, d=6):
    return F.round(x, d)


@register("A1_shape", TR + f"select count(*) as rows, {len(TR_COLS)} as columns from trending")
def q_a1(spark, sf):
    return agg.shape(fx.trending(spark, sf)).select("rows", F.col("columns").cast("int").alias("columns"))


@register("A1_dtypes", TR + " union all ".join(
    f"select '{c}' as column, '{t}' as dtype, count({c}) as non_null from trending" for c, t in zip(TR_COLS, TR_TYPES)))
def q_a1_dtypes(spark, sf):
    return agg.dtypes(fx.trending(spark, sf))


@register("A2_missing", TR + " union all ".join(
    f"select '{c}' as column, cast(count_if({c} is null) as bigint) as missing, "
    f"round(count_if({c} is null) * 100.0 / count(*), 2) as missing_pct from trending" for c in TR_COLS))
def q_a2(spark, sf):
    return agg.missing_report(fx.trending(spark, sf))


@register("A3_describe", TR + " union all ".join(
    f"select '{c}' as column, count({c}) as count, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std, "
    f"round(cast(min({c}) as double), 2) as min, round(quantile_cont({c}, 0.25), 2) as p25, round(quantile_cont({c}, 0.5), 2) as p50, "
    f"round(quantile_cont({c}, 0.75), 2) as p75, round(cast(max({c}) as double), 2) as max from trending" for c in NUM))
def q_a3(spark, sf):
    d = agg.describe(fx.trending(spark, sf))
    return d.select("column", "count", *[F.col(c).cast("double").alias(c)
                                         for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("A4_totals", TR + "select " + ", ".join(f"cast(sum({c}) as double) as {c}" for c in NUM) + " from trending")
def q_a4(spark, sf):
    return agg.totals(fx.trending(spark, sf))


@register("A5_rate_stats", TR + """
select round(avg(lr), 6) as like_rate_mean, round(quantile_cont(lr, 0.5), 6) as like_rate_median,
  round(avg(cr), 6) as comment_rate_mean, round(quantile_cont(cr, 0.5), 6) as comment_rate_median
from (select likes / nullif(cast(view_count as double), 0) as lr,
             comment_count / nullif(cast(view_count as double), 0) as cr from trending) s""")
def q_a5(spark, sf):
    r = agg.rate_stats(fx.trending(spark, sf))
    return r.select(*[_r(c).alias(c) for c in r.columns])


@register("A6_title_len", TR + """
select round(avg(n), 6) as title_len_mean, round(quantile_cont(n, 0.5), 6) as title_len_median,
  min(n) as title_len_min, max(n) as title_len_max
from (select length(coalesce(title, '')) as n from trending) s""")
def q_a6(spark, sf):
    r = agg.title_len_stats(fx.trending(spark, sf))
    return r.select(_r("title_len_mean").alias("title_len_mean"), _r("title_len_median").alias("title_len_median"),
                    F.col("title_len_min").cast("bigint").alias("title_len_min"),
                    F.col("title_len_max").cast("bigint").alias("title_len_max"))


@register("A7_date_ranges", TR + """
select cast(min(publishedAt) as varchar) as publishedAt_min, cast(max(publishedAt) as varchar) as publishedAt_max,
  cast(min(cast(trending_date as timestamp)) as varchar) as trending_date_min,
  cast(max(cast(trending_date as timestamp)) as varchar) as trending_date_max from trending""")
def q_a7(spark, sf):
    r = agg.date_ranges(fx.trending(spark, sf))
    return r.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in r.columns])


@register("A7_rows_per_year", TR + """
select year(publishedAt) as year, count(*) as rows from trending group by 1""")
def q_a7b(spark, sf):
    return agg.rows_per_year(fx.trending(spark, sf)).select(F.col("year").cast("bigint").alias("year"), "rows")


@register("A10_top_channels", TR + """
select channelTitle, count(*) as count from trending where channelTitle is not null
group by 1 order by count desc, channelTitle limit 20""")
def q_a10(spark, sf):
    return agg.value_counts(fx.trending(spark, sf), "channelTitle", 20)


@register("A10_category_counts", TR + """
select categoryId, count(*) as count from trending where categoryId is not null
group by 1 order by count desc, categoryId limit 20""")
def q_a10b(spark, sf):
    return agg.value_counts(fx.trending(spark, sf), "categoryId", 20)


def _profile_sql() -> str:
    parts = [f"select 'shape' as section, 'rows' as key, cast(count(*) as double) as value from trending",
             f"select 'shape', 'columns', {float(len(TR_COLS))}"]
    parts += [f"select 'missing', '{c}', cast(cast(count_if({c} is null) as bigint) as double) from trending" for c in TR_COLS]
    parts += [f"select 'missing_pct', '{c}', round(count_if({c} is null) * 100.0 / count(*), 2) from trending" for c in TR_COLS]
    parts += [f"select 'dtypes', '{c}:{t}', 1.0" for c, t in zip(TR_COLS, TR_TYPES)]
    parts += [f"select 'date_range', '{c}_{k}', cast(epoch({k}(cast({c} as timestamp))) as double) from trending"
              for c in ("publishedAt", "trending_date") for k in ("min", "max")]
    parts += [f"select 'describe', '{c}_{k}', cast({e} as double) from trending" for c in NUM for k, e in (
        ("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"),
        ("p25", f"quantile_cont({c}, 0.25)"), ("p50", f"quantile_cont({c}, 0.5)"), ("p75", f"quantile_cont({c}, 0.75)"))]
    parts += [f"select 'totals', '{c}', cast(sum({c}) as double) from trending" for c in NUM]
    parts += ["select 'engagement', 'like_rate_mean', avg(likes / nullif(cast(view_count as double), 0)) from trending",
              "select 'engagement', 'like_rate_median', quantile_cont(likes / nullif(cast(view_count as double), 0), 0.5) from trending",
              "select 'engagement', 'comment_rate_mean', avg(comment_count / nullif(cast(view_count as double), 0)) from trending",
              "select 'engagement', 'comment_rate_median', quantile_cont(comment_count / nullif(cast(view_count as double), 0), 0.5) from trending",
              "select 'title_len', 'title_len_mean', avg(length(coalesce(title, ''))) from trending",
              "select 'title_len', 'title_len_median', quantile_cont(length(coalesce(title, '')), 0.5) from trending",
              "select 'title_len', 'title_len_min', cast(min(length(coalesce(title, ''))) as double) from trending",
              "select 'title_len', 'title_len_max', cast(max(length(coalesce(title, ''))) as double) from trending",
              "select 'videos_per_year', cast(year(publishedAt) as varchar), cast(count(*) as double) from trending group by 2",
              "select * from (select 'category_counts', cast(categoryId as varchar), cast(count(*) as double) from trending "
              "where categoryId is not null group by categoryId order by 3 desc, categoryId limit 20)",
              "select * from (select 'top_channels', channelTitle, cast(count(*) as double) from trending "
              "where channelTitle is not null group by channelTitle order by 3 desc, channelTitle limit 20)"]
    return TR + "select section, key, round(value, 6) as value from (" + " union all ".join(parts) + ") p"


@register("L1_profile", _profile_sql())
def q_l1(spark, sf):
    p = profile(fx.trending(spark, sf))
    return p.select("section", "key", _r("value").alias("value"))
