"""Review hook (X1), streaming ingest (ST1) and source/sink round trips
(S1, S4, S11, K1, K2, K6) over the derived views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.operators.review import review
from titlelake.queries.q_functions import CRITERIA, strip_sql
from titlelake.queries.q_transcripts import OUTCOMES
from titlelake.session import ensure_checkpoint_dir


def stub_scorer(prompts):
    """Deterministic stand-in for a model call."""
    out = []
    for p in prompts:
        if "Official" in p:
            out.append("REMOVE - promotional upload")
        elif "?" in p:
            out.append("KEEP - curiosity gap")
        else:
            out.append("unsure")
    return out


PROMPT_SQL = f"""'\n' || '{CRITERIA}' || '\n\nVideo Title: "' || coalesce(title, '') || '"\nChannel: ' ||
  case when coalesce(channelTitle, '') <> '' then channelTitle else 'Unknown channel' end || '\nTags: ' ||
  case when {strip_sql('tags')} <> '' and coalesce(tags, '') <> '[None]' then tags else 'No tags' end ||
  '\n\nShould this video be KEPT or REMOVED?\n'"""


@register("X1_review", fx.duckdb_ctes("videos") + f""",
pr as (select video_id, {PROMPT_SQL} as prompt from videos),
rs as (select video_id, case when contains(prompt, 'Official') then 'REMOVE - promotional upload'
         when contains(prompt, '?') then 'KEEP - curiosity gap' else 'unsure' end as r from pr)
select video_id, not contains(upper(r), 'REMOVE') as keep,
  case when contains(upper(r), 'REMOVE') or contains(upper(r), 'KEEP') then r else 'UNCLEAR: ' || r end as reason from rs""")
def q_x1(spark, sf):
    v = fx.videos(spark, sf).select("video_id", "title", "channelTitle", "tags")
    return review(v, stub_scorer, CRITERIA).select("video_id", "keep", "reason")


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/titlelake-{name}-{uuid.uuid4().hex}"


@register("ST1_stream_ingest", OUTCOMES + """
select video_id, full_transcript, transcript_source from oc where status <> 'retryable'""")
def q_st1(spark, sf):
    """The fetch log lands as several files; an availableNow stream ingests
    them with resume-by-id and the sink is read back."""
    from titlelake.streaming.ingest import FETCH_LOG_SCHEMA, run_ingest
    root = _scratch(spark, "st1")
    log = fx.fetch_log(spark, sf).select(*FETCH_LOG_SCHEMA.fieldNames())
    log.repartition(4, "video_id").write.mode("overwrite").parquet(f"{root}/in")
    run_ingest(spark, f"{root}/in", f"{root}/sink", f"{root}/ckpt", max_files_per_trigger=1)
    return spark.read.parquet(f"{root}/sink").select("video_id", "full_transcript", "transcript_source")


@register("K2_S4_jsonl_round_trip", OUTCOMES + """
select video_id, title, full_transcript, transcript_source, transcript_language from oc where status <> 'retryable'""")
def q_k2(spark, sf):
    from titlelake.plans.transcripts import assemble
    from titlelake.schemas import TRANSCRIPT
    from titlelake.sources.readers import read_jsonl_tolerant
    from titlelake.sources.sinks import write_jsonl
    root = _scratch(spark, "jsonl")
    write_jsonl(assemble(fx.fetch_log(spark, sf)), root)
    return read_jsonl_tolerant(spark, root, TRANSCRIPT).select(
        "video_id", "title", "full_transcript", "transcript_source", "transcript_language")


@register("K1_S1_csv_round_trip", fx.duckdb_ctes("trending") + """
select video_id, cast(trending_date as varchar) as trending_date, title, description, view_count from trending""")
def q_k1(spark, sf):
    from pyspark.sql import types as T
    from titlelake.sources.readers import read_trending_csv
    from titlelake.sources.sinks import write_csv
    root = _scratch(spark, "csv")
    t = fx.trending(spark, sf).select("video_id", F.col("trending_date").cast("string").alias("trending_date"),
                                      "title", "description", "view_count")
    write_csv(t, root)
    schema = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("trending_date", T.StringType()),
                           T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
                           T.StructField("view_count", T.LongType())])
    return read_trending_csv(spark, root, schema)


@register("O4_head_for_review", fx.duckdb_ctes("videos") + """
select video_id, title from videos order by video_id limit 50""")
def q_o4(spark, sf):
    """The first 50 videos by id go to review (head(n); 0 would mean all)."""
    from titlelake.operators.sets import head
    return head(fx.videos(spark, sf).select("video_id", "title"), 50, "video_id")
