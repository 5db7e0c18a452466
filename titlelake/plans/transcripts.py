"""Transcript ingest: plan, assemble, merge, cap, retry.

Fetching is a network tool and is not built; fetch *outcomes* enter as a
table (one row per attempted id with exception type/message and raw
snippets). Everything else is joins, partial aggregates and top-k:

* ``plan_fetch``  (L4): keep-first by id (W3), resume anti-join (J2), md5 shard (P27)
* ``assemble``    (L5): classify (P24), join snippets (P23), source tag (P25), retry ids (P26, U2), counters (A15)
* ``merge``       (L6): union inputs (U1), best transcript per id (W5), allowed ids (J1), counters (A14)
* ``cap``         (L7): last table row per id (W4, J5), top-n per channel (W6), counters (A17)
* ``retry_*``     (L8): failed-id lookup (J3), blank rows (F14), merge back, unretryable report (F16)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlelake.functions import records as rc
from titlelake.functions.text import LINE_BREAK_CLASS, join_snippets, safe_strip
from titlelake.operators import joins as jn
from titlelake.operators.windows import best_by_score, cap_per_group, keep_first, keep_last

TRANSCRIPT_COLS = ("video_id", "title", "description", "full_transcript", "transcript_source", "transcript_language")


# ------------------------------------------------------------------- L4
def plan_fetch(table: DataFrame, sink: DataFrame | None, num_shards: int = 1, shard_index: int = 0,
               pos: str = "pos") -> DataFrame:
    """Rows still to fetch: first row per stripped id, minus ids already in
    the sink, restricted to one md5 shard when ``num_shards > 1``."""
    if num_shards < 1 or not 0 <= shard_index < num_shards:
        raise ValueError("need num_shards >= 1 and 0 <= shard_index < num_shards")
    t = table.withColumn("video_id", safe_strip("video_id"))
    if num_shards > 1:
        # The shard depends on the id alone: filter before the dedupe and the
        # anti-join so a shard run only shuffles its own ids.
        t = t.where(rc.shard_of("video_id", num_shards) == shard_index)
    todo = keep_first(t, "video_id", pos)
    if sink is not None:
        todo = jn.anti_by_id(todo, sink, stripped=True)
    return todo


# ------------------------------------------------------------------- L5
def fetch_outcomes(log: DataFrame, language: str = "en") -> DataFrame:
    """Per attempt: stripped fields, status, transcript text, source tag,
    language and the retry id of retryable failures."""
    status = rc.classify_fetch("exc_type", "exc_msg")
    snippets = F.split(F.coalesce(F.col("raw_text"), F.lit("")), LINE_BREAK_CLASS)
    text = F.when(status == "ok", join_snippets(snippets)).otherwise(F.lit(""))
    out = log.select(safe_strip("video_id").alias("video_id"), safe_strip("title").alias("title"),
                     safe_strip("description").alias("description"), status.alias("status"),
                     text.alias("full_transcript"), rc.retryable_id("exc_msg").alias("retry_id"))
    has = F.col("full_transcript") != ""
    return out.withColumns({
        "transcript_source": rc.transcript_source(F.col("full_transcript"), F.col("status")),
        "transcript_language": F.when(has, F.lit(language)).otherwise(F.lit("")),
    })


def assemble(log: DataFrame, drop_missing: bool = False, language: str = "en") -> DataFrame:
    """Transcript records written by a fetch run: every non-retryable
    outcome (retryable failures are reported, not written); F13 optional."""
    o = fetch_outcomes(log, language).where(F.col("status") != "retryable")
    if drop_missing:
        o = o.where(F.col("full_transcript") != "")
    return o.select(*TRANSCRIPT_COLS)


def failed_ids(log: DataFrame) -> DataFrame:
    """Distinct retryable ids, sorted."""
    o = fetch_outcomes(log)
    return o.where(F.col("retry_id").isNotNull()).select(F.col("retry_id").alias("video_id")).distinct().orderBy("video_id")


def fetch_summary(table: DataFrame, sink: DataFrame | None, log: DataFrame, pos: str = "pos") -> DataFrame:
    """Unique input ids, ids already done, ids scheduled, transcripts
    found, distinct retryable failures (ids alone are shuffled)."""
    ids = lambda df: df.select(safe_strip("video_id").alias("video_id")).where("video_id <> ''").distinct()
    n = F.count(F.lit(1))
    uniq, o = ids(table), fetch_outcomes(log)
    done = ids(sink) if sink is not None else uniq.limit(0)
    todo = uniq.join(done, "video_id", "left_anti")
    parts = [uniq.agg(n.alias("unique_ids")), done.agg(n.alias("already_done")), todo.agg(n.alias("scheduled")),
             o.agg(F.count_if((F.col("status") != "retryable") & (F.col("full_transcript") != "")).alias("found"),
                   F.count_distinct("retry_id").alias("retryable"))]
    out = parts[0]
    for p in parts[1:]:
        out = _one_row_join(out, p)
    return out


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    # Both sides are global aggregates with exactly one row.
    return a.withColumn("__k", F.lit(1)).join(F.broadcast(b.withColumn("__k", F.lit(1))), "__k").drop("__k")


# ------------------------------------------------------------------- L6
def merge(inputs: DataFrame, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded): per stripped id the best transcript (non-empty,
    then longer) wins; ties go to the earliest (input_rank, pos). With an
    ``allowed`` id table, rows of other ids form the discarded side (also
    best-per-id). Both sides sorted by id."""
    t = inputs.withColumn("video_id", safe_strip("video_id")).where(F.col("video_id") != "")
    score = rc.transcript_score("full_transcript")
    if allowed is not None:
        ok = jn.semi_by_id(t, allowed, stripped=True)
        bad = jn.anti_by_id(t, allowed, stripped=True)
    else:
        ok, bad = t, t.limit(0)
    kept = best_by_score(ok, "video_id", score, ["input_rank", "pos"]).orderBy("video_id")
    disc = best_by_score(bad, "video_id", score, ["input_rank", "pos"]).orderBy("video_id")
    return kept, disc


def merge_counters(inputs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Rows read, missing id, not allowed, unique written, non-empty,
    replaced (rows whose score beats every earlier row of the same id)."""
    t = inputs.withColumn("__id", safe_strip("video_id"))
    if allowed is not None:
        ids = allowed.select(safe_strip("video_id").alias("__aid")).where("__aid <> ''").distinct()
        t = t.join(ids, F.col("__id") == F.col("__aid"), "left").withColumn("__allowed", F.col("__aid").isNotNull())
    else:
        t = t.withColumn("__allowed", F.lit(True))
    # A row "replaces" when its score beats every earlier row of its id. Per
    # (id, score level) only the first occurrence can do that, and it does
    # iff every higher level first occurs later. So the window runs over the
    # distinct score levels of an id (bounded by the value domain), never
    # over all rows of a hot id.
    valid = t.where((F.col("__id") != "") & F.col("__allowed")).select(
        "__id", rc.transcript_score("full_transcript").alias("__s"), F.struct("input_rank", "pos").alias("__o"))
    levels = valid.groupBy("__id", "__s").agg(F.min("__o").alias("__f"))
    higher = (Window.partitionBy("__id").orderBy(F.col("__s").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.withColumn("__later", F.min("__f").over(higher))
    is_record = F.col("__later").isNull() | (F.col("__f") < F.col("__later"))
    counts = levels.agg(F.count_distinct("__id").alias("unique_ids"),
                        (F.count_if(is_record) - F.count_distinct("__id")).alias("replaced"),
                        # an id's best transcript is non-empty when any of its levels is
                        F.count_distinct(F.when(F.col("__s.has") == 1, F.col("__id"))).alias("non_empty"))
    base = t.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("__id") == "").alias("missing_id"),
                 F.count_if((F.col("__id") != "") & ~F.col("__allowed")).alias("not_allowed"))
    return _one_row_join(base, counts)


# ------------------------------------------------------------------- L7
def channel_views(videos: DataFrame, pos: str) -> DataFrame:
    """J5 lookup side: per stripped id, (channel, views) from the *last*
    table row; channel = channelId, else channelTitle; views int(float), bad -> 0."""
    from titlelake.functions.numeric import to_view_int
    v = videos.select(safe_strip("video_id").alias("video_id"), pos,
                      F.coalesce(F.when(safe_strip("channelId") != "", safe_strip("channelId")),
                                 safe_strip("channelTitle")).alias("channel"),
                      to_view_int(F.col("view_count").cast("string")).alias("views"))
    return keep_last(v.where(F.col("video_id") != ""), "video_id", pos).drop(pos)


def cap(transcripts: DataFrame, videos: DataFrame, max_per_channel: int = 20, pos: str = "pos") -> DataFrame:
    """Top ``max_per_channel`` transcripts per channel by views desc, id asc;
    rows whose id has no channel pass uncapped; blank ids are dropped."""
    t = transcripts.withColumn("video_id", safe_strip("video_id")).where(F.col("video_id") != "")
    cv = channel_views(videos, pos)
    enriched = t.join(cv, "video_id", "left")
    return cap_per_group(enriched, "channel", max_per_channel, "views", "video_id")


def cap_counters(transcripts: DataFrame, videos: DataFrame, max_per_channel: int = 20, pos: str = "pos") -> DataFrame:
    """Rows read, uncapped, dropped, written."""
    t = transcripts.withColumn("__id", safe_strip("video_id"))
    cv = channel_views(videos, pos)
    e = t.join(cv, F.col("__id") == cv["video_id"], "left").drop(cv["video_id"])
    # Rows per channel are enough: a channel writes at most ``max_per_channel`` of them.
    group = F.when(F.col("__id") == "", F.lit("blank")).when(F.coalesce(F.col("channel"), F.lit("")) == "", F.lit("free")).otherwise(F.lit("capped"))
    rows = e.groupBy(group.alias("g"), F.when(group == "capped", F.col("channel")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    written = F.when(F.col("g") == "capped", F.least("n", F.lit(max_per_channel))).when(F.col("g") == "free", F.col("n")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(total("n").alias("rows_read"), total(F.when(F.col("g") == "free", F.col("n"))).alias("uncapped"),
                    total(F.when(F.col("g") == "capped", F.col("n") - written)).alias("dropped"), total(written).alias("written"))


# ------------------------------------------------------------------- L8
def retry_lookup(table: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``table`` whose id failed -- duplicates kept, failed ids
    absent from ``table``)."""
    found = jn.semi_by_id(table, failed)
    absent = jn.anti_by_id(failed, table)
    return found, absent


def retry_empty_plan(transcripts: DataFrame) -> DataFrame:
    """blank-transcript rows projected for a retry (id, title, description)."""
    from titlelake.operators.filters import blank_transcripts
    return blank_transcripts(transcripts)


def merge_retry(current: DataFrame, retried: DataFrame) -> DataFrame:
    """Merge retry results into the current transcripts (retry is the later input)."""
    cols = ["video_id", "title", "full_transcript", "transcript_source", "pos"]
    a = current.select(*cols, F.lit(0).alias("input_rank"))
    b = retried.select(*cols, F.lit(1).alias("input_rank"))
    kept, _ = merge(a.unionByName(b))
    return kept
