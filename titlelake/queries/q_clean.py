"""L2 clean and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.operators import filters as flt
from titlelake.plans.clean import CleanConfig, clean, removal_funnel, removal_report, tag_clean


def _sql_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


PROMO_SQL = " or ".join(f"contains(lower(coalesce(title, '')), '{p.lower()}')" for p in flt.PROMO_LITERALS)
TAGGED_SQL = fx.duckdb_ctes("trending") + f""",
hv as (select channelTitle as hv_channel from trending where channelTitle is not null
       group by channelTitle having count(*) > 400),
tg as (select t.*, coalesce(t.channelTitle in ({_sql_list(flt.DENY_CHANNELS)}), false) as r_list,
         h.hv_channel is not null as r_high_volume,
         ({PROMO_SQL}) as r_promo_title,
         coalesce(trim(cast(categoryId as varchar)) = '25', false) as r_category_25,
         coalesce(trim(cast(categoryId as varchar)) = '10', false) as r_category_10
       from trending t left join hv h on t.channelTitle = h.hv_channel),
tk as (select *, not (r_list or r_high_volume or r_promo_title or r_category_25 or r_category_10) as keep from tg)
"""


def _key(df):
    return df.select("video_id", F.col("trending_date").cast("string").alias("trending_date"))


@register("L2_clean_kept", TAGGED_SQL + "select video_id, cast(trending_date as varchar) as trending_date, title "
          "from tk where keep")
def q_l2(spark, sf):
    kept, _ = clean(fx.trending(spark, sf))
    return kept.select("video_id", F.col("trending_date").cast("string").alias("trending_date"), "title")


@register("K5_clean_removed_audit", TAGGED_SQL + """
select video_id, cast(trending_date as varchar) as trending_date,
  array_to_string(list_filter([case when r_list then 'list' end, case when r_high_volume then 'high_volume' end,
    case when r_promo_title then 'promo_title' end, case when r_category_25 then 'category_25' end,
    case when r_category_10 then 'category_10' end], lambda x: x is not null), ',') as reasons
from tk where not keep""")
def q_k5(spark, sf):
    _, removed = clean(fx.trending(spark, sf))
    return removed.select("video_id", F.col("trending_date").cast("string").alias("trending_date"),
                          F.array_join("reasons", ",").alias("reasons"))


@register("A12_removal_funnel", TAGGED_SQL + """
select count(*) as before, cast(count_if(r_list) as bigint) as removed_list, cast(count_if(r_high_volume) as bigint) as removed_high_volume,
  cast(count_if(r_promo_title) as bigint) as removed_promo_title, cast(count_if(r_category_25) as bigint) as removed_category_25,
  cast(count_if(r_category_10) as bigint) as removed_category_10, cast(count_if(not keep) as bigint) as removed, cast(count_if(keep) as bigint) as after
from tk""")
def q_a12(spark, sf):
    return removal_funnel(tag_clean(fx.trending(spark, sf)))


@register("A11_removal_report", TAGGED_SQL + """
select channelTitle, count(*) as rows, case when max(cast(r_list as int)) = 1 then 'list' else '>400 videos' end as source
from tk where r_list or r_high_volume group by channelTitle""")
def q_a11(spark, sf):
    return removal_report(tag_clean(fx.trending(spark, sf)))


@register("F2_high_volume_channels", fx.duckdb_ctes("trending") + """
select channelTitle, count(*) as rows, count(*) > 400 as over_threshold from trending
where channelTitle is not null group by channelTitle""")
def q_f2(spark, sf):
    t = flt.tag_high_volume(fx.trending(spark, sf), max_videos=400)
    return (t.where(F.col("channelTitle").isNotNull()).groupBy("channelTitle")
            .agg(F.count(F.lit(1)).alias("rows"), F.max("high_volume").alias("over_threshold")))


@register("F3_F4_title_category_rules", fx.duckdb_ctes("videos") + f"""
select video_id, ({PROMO_SQL}) as promo_title,
  coalesce(trim(cast(categoryId as varchar)) in ('25', '10'), false) as denied_category,
  coalesce(channelTitle in ({_sql_list(flt.DENY_CHANNELS)}), false) as deny_listed
from videos""")
def q_f3f4(spark, sf):
    v = fx.videos(spark, sf)
    return v.select("video_id", flt.promo_title("title").alias("promo_title"),
                    flt.denied_category("categoryId").alias("denied_category"),
                    flt.deny_listed("channelTitle").alias("deny_listed"))


# F1 with a deny-list that hits the fixture's channels (the list is a parameter).
FIXTURE_DENY = ("src3", "src7", "src11")


@register("F1_deny_channels", fx.duckdb_ctes("trending") + f"""
select video_id, cast(trending_date as varchar) as trending_date from trending
where not coalesce(channelTitle in ({_sql_list(FIXTURE_DENY)}), false)""")
def q_f1(spark, sf):
    t = fx.trending(spark, sf)
    kept, _ = clean(t, CleanConfig(deny_channels=FIXTURE_DENY, max_videos=10**12, promo_literals=()))
    t2 = tag_clean(t, CleanConfig(deny_channels=FIXTURE_DENY, max_videos=10**12, promo_literals=()))
    return t2.where(~F.col("r_list")).select(
        "video_id", F.col("trending_date").cast("string").alias("trending_date"))


LIST_TAGGED_SQL = TAGGED_SQL.replace(_sql_list(flt.DENY_CHANNELS), _sql_list(FIXTURE_DENY))


@register("A11_removal_report_fixture_list", LIST_TAGGED_SQL + """
select channelTitle, count(*) as rows, case when max(cast(r_list as int)) = 1 then 'list' else '>400 videos' end as source
from tk where r_list or r_high_volume group by channelTitle""")
def q_a11b(spark, sf):
    """A11 with a deny-list naming fixture channels (the list is a parameter)."""
    cfg = CleanConfig(deny_channels=FIXTURE_DENY)
    return removal_report(tag_clean(fx.trending(spark, sf), cfg), cfg)


# The volume rule with a threshold that some of the fixture's channels pass and some do not.
MIXED = CleanConfig(deny_channels=FIXTURE_DENY, max_videos=99)
MIXED_SQL = LIST_TAGGED_SQL.replace("having count(*) > 400", "having count(*) > 99")


@register("L2_clean_kept_mixed", MIXED_SQL + "select video_id, cast(trending_date as varchar) as trending_date, title "
          "from tk where keep")
def q_l2_mixed(spark, sf):
    kept, _ = clean(fx.trending(spark, sf), MIXED)
    return kept.select("video_id", F.col("trending_date").cast("string").alias("trending_date"), "title")


@register("A12_removal_funnel_mixed", MIXED_SQL + """
select count(*) as before, cast(count_if(r_list) as bigint) as removed_list, cast(count_if(r_high_volume) as bigint) as removed_high_volume,
  cast(count_if(r_promo_title) as bigint) as removed_promo_title, cast(count_if(r_category_25) as bigint) as removed_category_25,
  cast(count_if(r_category_10) as bigint) as removed_category_10, cast(count_if(not keep) as bigint) as removed, cast(count_if(keep) as bigint) as after
from tk""")
def q_a12_mixed(spark, sf):
    return removal_funnel(tag_clean(fx.trending(spark, sf), MIXED))


@register("A11_removal_report_mixed", MIXED_SQL + """
select channelTitle, count(*) as rows, case when max(cast(r_list as int)) = 1 then 'list' else '>99 videos' end as source
from tk where r_list or r_high_volume group by channelTitle""")
def q_a11_mixed(spark, sf):
    return removal_report(tag_clean(fx.trending(spark, sf), MIXED), MIXED)


@register("F2_high_volume_mixed", fx.duckdb_ctes("trending") + """
select channelTitle, count(*) as rows, count(*) > 99 as over_threshold from trending
where channelTitle is not null group by channelTitle""")
def q_f2_mixed(spark, sf):
    t = flt.tag_high_volume(fx.trending(spark, sf), max_videos=99)
    return (t.where(F.col("channelTitle").isNotNull()).groupBy("channelTitle")
            .agg(F.count(F.lit(1)).alias("rows"), F.max("high_volume").alias("over_threshold")))
