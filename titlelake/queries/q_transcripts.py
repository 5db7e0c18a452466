"""Transcript ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.functions.text import LINE_BREAK_CLASS
from titlelake.plans import transcripts as tp
from titlelake.queries.q_functions import strip_sql


def _table(spark, sf):
    return fx.videos(spark, sf).select(F.col("doc_id").alias("pos"), "video_id", "title", "description")


def _sink(spark, sf):
    return fx.transcripts_in(spark, sf).where("input_rank = 0")


SID = strip_sql("video_id")
BASE = fx.duckdb_ctes("videos", "transcripts_in", "fetch_log")
STATUS_SQL = """case when exc_type is null then 'ok' when exc_type in ('NoTranscriptFound', 'TranscriptsDisabled',
  'VideoUnavailable') then 'missing' when contains(coalesce(exc_msg, ''), 'This video is age-restricted') then 'age_restricted'
  when contains(coalesce(exc_msg, ''), 'This video is private') then 'private'
  when contains(coalesce(exc_msg, ''), 'YouTube is blocking your requests') then 'blocked_by_youtube' else 'retryable' end"""
_SPLIT = f"string_split_regex(coalesce(raw_text, ''), '{LINE_BREAK_CLASS}')"
_PARTS = f"list_filter(list_transform({_SPLIT}, lambda s: {strip_sql('s')}), lambda s: s <> '')"
SNIP = strip_sql(f"array_to_string({_PARTS}, ' ')")
OUTCOMES = BASE + f""",
o1 as (select {SID} as video_id, {strip_sql('title')} as title, {strip_sql('description')} as description,
         {STATUS_SQL} as status, raw_text,
         nullif({strip_sql("regexp_extract(coalesce(exc_msg, ''), 'transcript_fetch_error:([^:]*):', 1)")}, '') as retry_id
       from fetch_log),
o2 as (select * exclude (raw_text), case when status = 'ok' then {SNIP} else '' end as full_transcript from o1),
oc as (select *, case when full_transcript <> '' then 'youtube_transcript_api'
         when status in ('missing', 'age_restricted', 'private', 'blocked_by_youtube') then status else 'error' end
         as transcript_source, case when full_transcript <> '' then 'en' else '' end as transcript_language from o2)
"""


@register("L4_plan_fetch", BASE + f"""
select video_id, title, cast(('0x' || substr(md5(video_id), 1, 8))::ubigint % 4 as bigint) as shard from (
  select {SID} as video_id, title, row_number() over (partition by {SID} order by doc_id) as rn from videos
  where {SID} <> '') f
where rn = 1 and video_id not in (select {SID} from transcripts_in where input_rank = 0 and {SID} <> '')""")
def q_l4(spark, sf):
    from titlelake.functions.records import shard_of
    todo = tp.plan_fetch(_table(spark, sf), _sink(spark, sf))
    return todo.select("video_id", "title", shard_of("video_id", 4).alias("shard"))


@register("L4_plan_fetch_shard", BASE + f"""
select count(*) as rows from (select {SID} as video_id, row_number() over (partition by {SID} order by doc_id) as rn
  from videos where {SID} <> '') f
where rn = 1 and video_id not in (select {SID} from transcripts_in where input_rank = 0 and {SID} <> '')
  and ('0x' || substr(md5(video_id), 1, 8))::ubigint % 4 = 1""")
def q_l4s(spark, sf):
    return tp.plan_fetch(_table(spark, sf), _sink(spark, sf), num_shards=4, shard_index=1).agg(
        F.count(F.lit(1)).alias("rows"))


@register("L5_assemble", OUTCOMES + """
select video_id, title, full_transcript, transcript_source, transcript_language from oc where status <> 'retryable'""")
def q_l5(spark, sf):
    return tp.assemble(fx.fetch_log(spark, sf)).select("video_id", "title", "full_transcript", "transcript_source",
                                                       "transcript_language")


@register("F13_assemble_drop_missing", OUTCOMES + """
select video_id from oc where status <> 'retryable' and full_transcript <> ''""")
def q_f13(spark, sf):
    return tp.assemble(fx.fetch_log(spark, sf), drop_missing=True).select("video_id")


@register("U2_failed_ids", OUTCOMES + "select distinct retry_id as video_id from oc where retry_id is not null")
def q_u2(spark, sf):
    return tp.failed_ids(fx.fetch_log(spark, sf))


@register("A15_fetch_summary", OUTCOMES + f""",
u as (select {SID} as video_id from videos where {SID} <> '' group by 1),
d as (select distinct {SID} as video_id from transcripts_in where input_rank = 0 and {SID} <> '')
select (select count(*) from u) as unique_ids, (select count(*) from d) as already_done,
  (select count(*) from u where video_id not in (select video_id from d)) as scheduled,
  (select cast(count_if(status <> 'retryable' and full_transcript <> '') as bigint) from oc) as found,
  (select count(distinct retry_id) from oc) as retryable""")
def q_a15(spark, sf):
    return tp.fetch_summary(_table(spark, sf), _sink(spark, sf), fx.fetch_log(spark, sf))


MERGE = BASE + f""",
t as (select *, {SID} as vid, length({strip_sql('full_transcript')}) as len,
        case when {strip_sql('full_transcript')} <> '' then 1 else 0 end as has from transcripts_in),
a as (select distinct {SID} as aid from videos where {SID} <> ''),
best as (select *, row_number() over (partition by vid order by has desc, len desc, input_rank, pos) as rn from t
         where vid <> '' and vid in (select aid from a)),
disc as (select *, row_number() over (partition by vid order by has desc, len desc, input_rank, pos) as rn from t
         where vid <> '' and vid not in (select aid from a))
"""


def _merge(spark, sf):
    return tp.merge(fx.transcripts_in(spark, sf), fx.videos(spark, sf))


@register("L6_merge_kept", MERGE + "select vid as video_id, input_rank, pos, full_transcript from best where rn = 1")
def q_l6(spark, sf):
    kept, _ = _merge(spark, sf)
    return kept.select("video_id", "input_rank", "pos", "full_transcript")


@register("J1_merge_discarded", MERGE + "select vid as video_id, input_rank, pos from disc where rn = 1")
def q_j1(spark, sf):
    _, disc = _merge(spark, sf)
    return disc.select("video_id", "input_rank", "pos")


@register("A14_merge_counters", MERGE + f""",
v as (select *, max(struct_pack(h := has, l := len)) over (partition by vid order by input_rank, pos
        rows between unbounded preceding and 1 preceding) as prev from t where vid <> '' and vid in (select aid from a))
select (select count(*) from t) as rows_read, (select cast(count_if(vid = '') as bigint) from t) as missing_id,
  (select cast(count_if(vid <> '' and vid not in (select aid from a)) as bigint) from t) as not_allowed,
  (select count(distinct vid) from v) as unique_ids,
  (select cast(count_if(prev is not null and struct_pack(h := has, l := len) > prev) as bigint) from v) as replaced,
  (select cast(count_if({strip_sql('full_transcript')} <> '') as bigint) from best where rn = 1) as non_empty""")
def q_a14(spark, sf):
    c = tp.merge_counters(fx.transcripts_in(spark, sf), fx.videos(spark, sf))
    return c.select("rows_read", "missing_id", "not_allowed", "unique_ids", "replaced", "non_empty")


CAP = MERGE + f""",
kept as (select vid as video_id, pos from best where rn = 1),
tr as ({fx.duckdb_ctes('trending').split('trending as (', 1)[1].rsplit(')', 1)[0]}),
cv as (select video_id, channel, views from (select {SID} as video_id,
         coalesce(nullif({strip_sql('channelId')}, ''), {strip_sql('channelTitle')}) as channel,
         coalesce(cast(trunc(try_cast(cast(view_count as varchar) as double)) as bigint), 0) as views,
         row_number() over (partition by {SID} order by trending_date desc) as rn from tr where {SID} <> '') x where rn = 1),
e as (select k.video_id, k.pos, cv.channel, cv.views from kept k left join cv using (video_id)),
capped as (select video_id from (select *, row_number() over (partition by channel order by views desc, video_id) as r
             from e where coalesce(channel, '') <> '') y where r <= 20
           union all select video_id from e where coalesce(channel, '') = '')
"""


def _trending_pos(spark, sf):
    return fx.trending(spark, sf).withColumn("tpos", F.col("trending_date"))


@register("L7_cap_per_channel", CAP + "select video_id from capped")
def q_l7(spark, sf):
    kept, _ = _merge(spark, sf)
    return tp.cap(kept, _trending_pos(spark, sf), 20, pos="tpos").select("video_id")


@register("A17_cap_counters", CAP + """
select (select count(*) from kept) as rows_read, (select cast(count_if(coalesce(channel, '') = '') as bigint) from e) as uncapped,
  (select count(*) from kept) - (select count(*) from capped) as dropped, (select count(*) from capped) as written""")
def q_a17(spark, sf):
    kept, _ = _merge(spark, sf)
    return tp.cap_counters(kept, _trending_pos(spark, sf), 20, pos="tpos")


@register("J5_channel_views", CAP + "select video_id, channel, views from cv")
def q_j5(spark, sf):
    return tp.channel_views(_trending_pos(spark, sf), "tpos")


@register("J3_retry_lookup_found", OUTCOMES + f"""
select {SID} as video_id, doc_id from videos where {SID} in (select retry_id from oc where retry_id is not null)""")
def q_j3(spark, sf):
    found, _ = tp.retry_lookup(fx.videos(spark, sf), tp.failed_ids(fx.fetch_log(spark, sf)))
    return found.select("video_id", "doc_id")


@register("J3_retry_lookup_absent", OUTCOMES + """
select video_id from (select distinct retry_id as video_id from oc where retry_id is not null) f
where video_id not in (select video_id from oc where status <> 'retryable')""")
def q_j3b(spark, sf):
    """Failed ids absent from the transcripts the fetch run wrote (retryable
    failures are never written, so every failed id is looked up as absent)."""
    log = fx.fetch_log(spark, sf)
    _, absent = tp.retry_lookup(tp.assemble(log), tp.failed_ids(log))
    return absent.select("video_id")


@register("F14_retry_empty_plan", MERGE + f"""
select vid as video_id, {strip_sql('title')} as title, '' as description from best
where rn = 1 and {strip_sql('full_transcript')} = ''""")
def q_f14(spark, sf):
    kept, _ = _merge(spark, sf)
    return tp.retry_empty_plan(kept.withColumn("description", F.lit("")))


RETRY = OUTCOMES + MERGE.replace(BASE + ",", ",", 1) + f""",
cur as (select vid as video_id, full_transcript, transcript_source, pos, 0 as input_rank from best where rn = 1),
ret as (select video_id, full_transcript, transcript_source, doc_id as pos, 1 as input_rank
        from (select o.*, f.doc_id from oc o join (select {SID} as vid2, pos as doc_id from fetch_log) f
              on o.video_id = f.vid2) r where status <> 'retryable'
        and video_id in (select video_id from cur where {strip_sql('full_transcript')} = '')),
allr as (select *, length({strip_sql('full_transcript')}) as len,
         case when {strip_sql('full_transcript')} <> '' then 1 else 0 end as has from (select * from cur union all select * from ret) u),
mr as (select * from (select *, row_number() over (partition by video_id order by has desc, len desc, input_rank, pos) as rn
       from allr) z where rn = 1)
"""


def _retried(spark, sf):
    kept, _ = _merge(spark, sf)
    blank = tp.retry_empty_plan(kept.withColumn("description", F.lit(""))).select("video_id")
    log = fx.fetch_log(spark, sf)
    res = tp.fetch_outcomes(log).where(F.col("status") != "retryable")
    pos = log.select(F.col("video_id").alias("video_id"), "pos")
    retried = res.join(pos, "video_id").join(blank, "video_id", "left_semi")
    return tp.merge_retry(kept, retried)


@register("L8_retry_merge", RETRY + "select video_id, transcript_source, input_rank from mr")
def q_l8(spark, sf):
    return _retried(spark, sf).select("video_id", "transcript_source", "input_rank")


@register("F16_unretryable", RETRY + f"""
select video_id, transcript_source as status from mr where {strip_sql('full_transcript')} = ''""")
def q_f16(spark, sf):
    from titlelake.operators.filters import unretryable
    return unretryable(_retried(spark, sf))


@register("U1_union_shard_outputs", OUTCOMES + """
select video_id, transcript_source from oc
where status <> 'retryable' and ('0x' || substr(md5(video_id), 1, 8))::ubigint % 4 <> 2""")
def q_u1(spark, sf):
    """Four shard runs assemble their own ids; shard 2's output is absent
    and skipped by the union (U1)."""
    from titlelake.functions.records import shard_of
    from titlelake.operators.sets import union_inputs
    log = fx.fetch_log(spark, sf).withColumn("__sh", shard_of(F.col("video_id"), 4))
    outs = [tp.assemble(log.where(F.col("__sh") == i)) if i != 2 else None for i in range(4)]
    return union_inputs(outs).select("video_id", "transcript_source")
