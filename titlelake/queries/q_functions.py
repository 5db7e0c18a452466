"""Scalar function families (P1-P12, P20-P22, P24-P28) and row-local filters
(F5-F8) over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.functions import numeric as nm
from titlelake.functions import records as rc
from titlelake.functions import text as tx
from titlelake.operators import filters as flt

STRIP = f"'{tx.STRIP_RE}'"
LINES = f"'{tx.LINE_BREAK_CLASS}'"


def strip_sql(x: str) -> str:
    return f"coalesce(regexp_replace(cast({x} as varchar), {STRIP}, '', 'g'), '')"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '{tx.NON_WORD_RE}'), lambda w: w <> '')"


def contains_any_sql(x: str, pats, lower=True) -> str:
    s = f"lower(coalesce({x}, ''))" if lower else f"coalesce({x}, '')"
    return "(" + " or ".join(f"contains({s}, '{p.lower().replace(chr(39), chr(39) * 2)}')" for p in pats) + ")"


STOP = "[" + ", ".join(f"'{w}'" for w in tx.ENGLISH_STOPWORDS) + "]"
RATIO = "length(regexp_replace(coalesce(title, ''), '[^A-Za-z]', '', 'g')) / greatest(length(coalesce(title, '')), 1)"


@register("P_text_functions", fx.duckdb_ctes("videos") + f"""
select video_id, {strip_sql('title')} as stripped,
  trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) as norm_title,
  length(coalesce(title, '')) as title_len,
  round({RATIO}, 6) as ascii_ratio,
  cast(len({tokens_sql('title')}) as int) as n_tokens,
  list_has_any({tokens_sql('title')}, {STOP}) as has_stopword,
  (coalesce(title, '') <> '' and ({RATIO} >= 0.6 or list_has_any({tokens_sql('title')}, {STOP}))) as english_like
from videos""")
def q_ptext(spark, sf):
    v = fx.videos(spark, sf)
    return v.select("video_id", tx.safe_strip("title").alias("stripped"), tx.normalize_title("title").alias("norm_title"),
                    tx.title_len("title").cast("bigint").alias("title_len"), F.round(tx.ascii_letter_ratio("title"), 6).alias("ascii_ratio"),
                    F.size(tx.word_tokens("title")).alias("n_tokens"), tx.has_stopword("title").alias("has_stopword"),
                    tx.is_english_like("title").alias("english_like"))


@register("P_numeric_coercion", fx.duckdb_ctes("videos") + """
select video_id, try_cast(tags as double) as tags_num,
  coalesce(try_cast(cast(view_count as varchar) || '.5' as double), 0) as views_text_num,
  case when try_cast(cast(likes as varchar) || 'e2' as double) is null then 0
       else cast(trunc(try_cast(cast(likes as varchar) || 'e2' as double)) as bigint) end as likes_int,
  cast(try_cast(cast(publishedAt as varchar) as timestamp) as varchar) as published_ts,
  year(try_cast(cast(publishedAt as varchar) as timestamp)) as published_year
from videos""")
def q_pnum(spark, sf):
    v = fx.videos(spark, sf).select(
        "video_id", "tags", F.concat(F.col("view_count").cast("string"), F.lit(".5")).alias("vp"),
        F.concat(F.col("likes").cast("string"), F.lit("e2")).alias("lk"), F.col("publishedAt").cast("string").alias("pa"))
    ts = nm.to_ts("pa")
    return v.select("video_id", nm.to_number("tags").alias("tags_num"), nm.to_number("vp", 0).alias("views_text_num"),
                    nm.to_view_int("lk").alias("likes_int"),
                    F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("published_ts"), F.year(ts).cast("bigint").alias("published_year"))


@register("F5_F8_row_rules", fx.duckdb_ctes("videos") + f"""
select video_id,
  coalesce(cast(categoryId as double) in (22, 23, 24, 26, 27, 28, 19), false) as allowed_category,
  case {' '.join(f"when {contains_any_sql('title', pats)} then '{name}'" for name, pats in flt.PATTERN_GROUPS.items())}
       else null end as pattern_group,
  (length(coalesce(title, '')) between 5 and 120
   and (contains(coalesce(title, ''), '?') or {contains_any_sql('title', flt.HOOK_PHRASES)})
   and not {contains_any_sql('title', flt.GENERIC_PATTERNS)}) as text_heuristic,
  (coalesce(title, '') <> '' and ({RATIO} >= 0.6 or list_has_any({tokens_sql('title')}, {STOP}))) as english_like
from videos""")
def q_f5f8(spark, sf):
    v = fx.videos(spark, sf)
    return v.select("video_id", flt.allowed_category(v).alias("allowed_category"),
                    flt.pattern_group("title").alias("pattern_group"),
                    flt.text_heuristic_keep().alias("text_heuristic"),
                    flt.language_keep(enabled=True).alias("english_like"))


@register("F6_regex_mode_removes_all", fx.duckdb_ctes("videos") + """
select count(*) as rows, cast(count_if(regexp_matches(lower(coalesce(title, '')), 'live |')) as bigint) as removed
from videos""")
def q_f6regex(spark, sf):
    """Q1: with regex semantics the pattern 'live |' matches every title."""
    v = fx.videos(spark, sf)
    hit = flt.pattern_group("title", mode="regex").isNotNull()
    return v.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("removed"))


@register("P20_clean_prediction", fx.duckdb_ctes("generations") + f"""
select id, regexp_replace(regexp_replace({strip_sql(f"string_split_regex({strip_sql('raw_output')}, {LINES})[1]")},
  '^"+|"+\\z', '', 'g'), '^''+|''+\\z', '', 'g') as prediction
from generations""")
def q_p20(spark, sf):
    g = fx.generations(spark, sf)
    return g.select("id", tx.clean_prediction("raw_output").alias("prediction"))


CRITERIA = "Keep titles that spark curiosity; remove brand, news and sports uploads."


@register("P21_P22_review", fx.duckdb_ctes("review_responses") + f"""
select video_id,
  '\n' || '{CRITERIA}' || '\n\nVideo Title: "' || coalesce(title, '') || '"\nChannel: ' ||
  case when coalesce(channelTitle, '') <> '' then channelTitle else 'Unknown channel' end || '\nTags: ' ||
  case when {strip_sql('tags')} <> '' and coalesce(tags, '') <> '[None]' then tags else 'No tags' end ||
  '\n\nShould this video be KEPT or REMOVED?\n' as prompt,
  case when error is not null then true when contains(upper(coalesce(response, '')), 'REMOVE') then false else true end as keep,
  case when error is not null then 'ERROR: ' || error
       when contains(upper(coalesce(response, '')), 'REMOVE') or contains(upper(coalesce(response, '')), 'KEEP')
       then coalesce(response, '') else 'UNCLEAR: ' || coalesce(response, '') end as reason
from review_responses""")
def q_p21(spark, sf):
    r = fx.review_responses(spark, sf)
    v = rc.parse_verdict("response", "error")
    return r.select("video_id", rc.review_prompt("title", "channelTitle", "tags", CRITERIA).alias("prompt"),
                    v["keep"].alias("keep"), v["reason"].alias("reason"))


@register("P24_P26_fetch_classes", fx.duckdb_ctes("fetch_log") + f"""
select video_id,
  case when exc_type is null then 'ok' when exc_type in ('NoTranscriptFound', 'TranscriptsDisabled', 'VideoUnavailable')
       then 'missing' when contains(coalesce(exc_msg, ''), 'This video is age-restricted') then 'age_restricted'
       when contains(coalesce(exc_msg, ''), 'This video is private') then 'private'
       when contains(coalesce(exc_msg, ''), 'YouTube is blocking your requests') then 'blocked_by_youtube'
       else 'retryable' end as status,
  nullif({strip_sql("regexp_extract(coalesce(exc_msg, ''), 'transcript_fetch_error:([^:]*):', 1)")}, '') as retry_id
from fetch_log""")
def q_p24(spark, sf):
    f = fx.fetch_log(spark, sf)
    return f.select("video_id", rc.classify_fetch("exc_type", "exc_msg").alias("status"),
                    rc.retryable_id("exc_msg").alias("retry_id"))


@register("P27_P28_shard_hash", fx.duckdb_ctes("videos") + """
select video_id, cast(('0x' || substr(md5(video_id), 1, 8))::ubigint % 8 as bigint) as shard,
  sha1('42:' || video_id) as split_key, sha1('42:train:' || video_id) as train_key
from videos""")
def q_p27(spark, sf):
    v = fx.videos(spark, sf)
    return v.select("video_id", rc.shard_of("video_id", 8).alias("shard"), rc.hash_key(42, "video_id").alias("split_key"),
                    rc.hash_key(42, "video_id", "train").alias("train_key"))
