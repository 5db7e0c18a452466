"""Record-level column functions: ids, source selection, chat formatting,
fetch classification, hashing (P13-P19, P21, P22, P24-P29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titlelake.functions.text import not_blank, safe_strip

# The two system-prompt wordings (training says 30-70
# characters, inference says 50-80), the user-prompt sentence and the
# review-prompt layout, stated as the reference writes them.
# The two prompts differ in the length they ask for.
SYSTEM_PROMPT = """You are an expert YouTube title generator. Your task is to create compelling, accurate titles that capture the essence of video content.

Guidelines for generating YouTube titles:
1. Be accurate and truthful - the title must reflect the actual content
2. Make it compelling and click-worthy while staying honest
3. Keep titles concise (ideally {ideal} characters, max 100 characters)
4. Use natural language that viewers would search for
5. Highlight the most interesting or valuable aspect
6. Create a curiosity gap without being misleading

Generate only the title itself, nothing else."""
SYSTEM_PROMPT_TRAIN = SYSTEM_PROMPT.format(ideal="30-70")
SYSTEM_PROMPT_INFER = SYSTEM_PROMPT.format(ideal="50-80")

USER_PROMPT_TAIL = "\n\nGenerate the YouTube title:"


# Fetch outcome classes and the messages that identify them.
MISSING_EXCEPTIONS = ("NoTranscriptFound", "TranscriptsDisabled", "VideoUnavailable")
AGE_RESTRICTED_MSG = "This video is age-restricted"
PRIVATE_MSG = "This video is private"
BLOCKED_MSG = "YouTube is blocking your requests"
API_SOURCE_TAG = "youtube_transcript_api"
TERMINAL_STATUSES = ("missing", "age_restricted", "private", "blocked_by_youtube")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _blank_to_null(x) -> Column:
    s = safe_strip(x)
    return F.when(s != "", s)


def infer_id(video_id, url, row_index) -> Column:
    """Stripped video_id, else stripped url, else ``row_<n>``."""
    return F.coalesce(_blank_to_null(video_id), _blank_to_null(url),
                      F.concat(F.lit("row_"), _c(row_index).cast("string")))


def select_source(full_transcript, transcript, description) -> Column:
    """struct(source, text).

    The first non-empty *raw* transcript value wins (so a whitespace-only
    full_transcript hides ``transcript``), then it is stripped; if that is
    blank the stripped description is used; else ('', '').
    """
    ft, tr, desc = _c(full_transcript), _c(transcript), _c(description)
    raw = F.when(ft.isNotNull() & (ft != ""), ft).otherwise(tr)
    # Spark repeats what is read twice, so no condition strips a whole text
    source = F.when(not_blank(raw), "transcript").when(not_blank(desc), "description").otherwise("")
    text = F.when(not_blank(raw), safe_strip(raw)).when(not_blank(desc), safe_strip(desc)).otherwise("")
    return F.struct(source.alias("source"), text.alias("source_text"))


def source_label(source) -> Column:
    return F.when(_c(source) == "transcript", "Transcript").otherwise("Description")


def sft_user_prompt(source, source_text) -> Column:
    """User turn with a Transcript / Description label."""
    label = source_label(source)
    head = F.concat(F.lit("Based on the following video "), F.lower(label),
                    F.lit(", generate an accurate and compelling YouTube title.\n\n"))
    return F.concat(head, label, F.lit(":\n"), F.coalesce(_c(source_text), F.lit("")), F.lit(USER_PROMPT_TAIL))


def _msg(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(source, source_text, title, system_prompt: str = SYSTEM_PROMPT_TRAIN,
                drop_blank_assistant: bool = False) -> Column:
    """[system, user, assistant] chat turns.

    With ``drop_blank_assistant`` (the inference form) the assistant turn
    carries the stripped reference and is omitted when that is blank.
    """
    user = sft_user_prompt(source, source_text)
    base = F.array(_msg("system", F.lit(system_prompt)), _msg("user", user))
    if not drop_blank_assistant:
        return F.concat(base, F.array(_msg("assistant", F.coalesce(_c(title), F.lit("")))))
    ref = safe_strip(title)
    return F.when(ref != "", F.concat(base, F.array(_msg("assistant", ref)))).otherwise(base)


def _turn_text(m) -> Column:
    return F.concat(F.upper(F.coalesce(m["role"], F.lit("user"))), F.lit(":\n"),
                    F.coalesce(m["content"], F.lit("")), F.lit("\n"))


def messages_to_text(messages) -> Column:
    """``ROLE:\\ncontent\\n`` per turn, joined by newline."""
    return F.array_join(F.transform(_c(messages), _turn_text), "\n")


def generation_prompt(messages) -> Column:
    """Drop assistant turns, render, then append ``ASSISTANT:\\n``."""
    kept = F.filter(_c(messages), lambda m: F.lower(F.coalesce(m["role"], F.lit(""))) != "assistant")
    parts = F.concat(F.transform(kept, _turn_text), F.array(F.lit("ASSISTANT:\n")))
    return F.array_join(parts, "\n")


def extract_reference(messages) -> Column:
    """Content of the last assistant turn, stripped; else ''."""
    asst = F.filter(_c(messages), lambda m: m["role"] == "assistant")
    return F.when(F.size(asst) > 0, safe_strip(F.element_at(asst, -1)["content"])).otherwise(F.lit(""))


def review_prompt(title, channel, tags, criteria: str) -> Column:
    """Review prompt; blank or ``[None]`` tags -> 'No tags', blank channel -> 'Unknown channel'."""
    tg = F.coalesce(_c(tags), F.lit(""))
    tags_str = F.when((safe_strip(tg) != "") & (tg != "[None]"), tg).otherwise(F.lit("No tags"))
    ch = F.coalesce(_c(channel), F.lit(""))
    channel_str = F.when(ch != "", ch).otherwise(F.lit("Unknown channel"))
    return F.concat(F.lit("\n" + criteria + '\n\nVideo Title: "'), F.coalesce(_c(title), F.lit("")),
                    F.lit('"\nChannel: '), channel_str, F.lit("\nTags: "), tags_str,
                    F.lit("\n\nShould this video be KEPT or REMOVED?\n"))


def parse_verdict(response, error=None) -> Column:
    """struct(keep, reason). REMOVE anywhere wins, then KEEP; else
    kept as UNCLEAR; a scorer error keeps the row with an ERROR reason."""
    r = F.coalesce(_c(response), F.lit(""))
    up = F.upper(r)
    keep = F.when(F.contains(up, F.lit("REMOVE")), F.lit(False)).otherwise(F.lit(True))
    reason = (F.when(F.contains(up, F.lit("REMOVE")) | F.contains(up, F.lit("KEEP")), r)
              .otherwise(F.concat(F.lit("UNCLEAR: "), r)))
    if error is not None:
        err = _c(error)
        keep = F.when(err.isNotNull(), F.lit(True)).otherwise(keep)
        reason = F.when(err.isNotNull(), F.concat(F.lit("ERROR: "), err)).otherwise(reason)
    return F.struct(keep.alias("keep"), reason.alias("reason"))


def classify_fetch(exc_type, exc_msg) -> Column:
    """Ok / missing / age_restricted / private / blocked_by_youtube / retryable."""
    t, m = _c(exc_type), F.coalesce(_c(exc_msg), F.lit(""))
    return (F.when(t.isNull(), "ok")
            .when(t.isin(*MISSING_EXCEPTIONS), "missing")
            .when(F.contains(m, F.lit(AGE_RESTRICTED_MSG)), "age_restricted")
            .when(F.contains(m, F.lit(PRIVATE_MSG)), "private")
            .when(F.contains(m, F.lit(BLOCKED_MSG)), "blocked_by_youtube")
            .otherwise("retryable"))


def transcript_source(text, status) -> Column:
    """P25: API tag when text is non-blank, else the terminal status, else 'error'."""
    has = safe_strip(text) != ""
    return (F.when(has, F.lit(API_SOURCE_TAG))
            .when(_c(status).isin(*TERMINAL_STATUSES), _c(status))
            .otherwise(F.lit("error")))


def retryable_id(msg) -> Column:
    """The id in ``transcript_fetch_error:<id>:<detail>``, else null."""
    vid = safe_strip(F.regexp_extract(F.coalesce(_c(msg), F.lit("")), r"transcript_fetch_error:([^:]*):", 1))
    return F.when(vid != "", vid)


def shard_of(video_id, num_shards: int) -> Column:
    """int(md5(id)[:8], 16) % n."""
    h = F.conv(F.substring(F.md5(_c(video_id)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(num_shards))


def hash_key(seed: int, video_id, tag: str | None = None) -> Column:
    """sha1 hex of ``seed[:tag]:id``; fixed width, so it sorts like the integer."""
    prefix = f"{seed}:{tag}:" if tag is not None else f"{seed}:"
    return F.sha1(F.concat(F.lit(prefix), _c(video_id)))


def transcript_score(full_transcript) -> Column:
    """struct(has_text, length of stripped text), compared lexicographically."""
    t = safe_strip(full_transcript)
    return F.struct(F.when(t != "", 1).otherwise(0).alias("has"), F.length(t).alias("len"))
