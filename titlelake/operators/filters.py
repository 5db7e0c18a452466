"""Row filters (F1-F16).

Every filter *tags* rows instead of splitting the input: it adds a boolean
column (``True`` = keep) so the kept and removed sides -- the reference's
audit pair -- come from one plan (``split`` below). Row-local rules are
plain Column predicates; rules that need a statistic of the whole table
(F2, F9, F10) compute it with a partial aggregate and attach it by join or
scalar subquery, never by a window over an unbounded partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlelake.functions.numeric import with_engagement
from titlelake.functions.text import contains_any, is_english_like, safe_strip, title_len
from titlelake.operators.quantiles import quantile, quantiles

# Channel deny-list (F1). The reference's list lost three
# commas ("BLACKPINK" "NPR", "CTV News" "News"); the intended names are
# listed separately here.
DENY_CHANNELS = (
    "NFL", "NBA", "NPR", "NBC Sports", "ESPN", "Saturday Night Live", "HYBE LABELS",
    "Marvel Entertainment", "JYP Entertainment", "DAZN Boxing", "Netflix", "Disney", "SpaceX",
    "CBS Sports Golazo", "Fortnite", "Genshin Impact", "ESPN FC", "Clash of Clans", "WWE",
    "FORMULA 1", "Warner Bros. Pictures", "America's Got Talent", "Nintendo", "PlayStation",
    "Apple", "NBA on TNT", "UFC - Ultimate Fighting Championship",
    "Universal Pictures / Sony Pictures", "Star Wars", "BLACKPINK", "NPR Music", "adult swim",
    "Architectural Digest", "CTV News", "News",
)
# Promotional title literals (F3), deny / allow categories.
PROMO_LITERALS = ("Official", "Lyric", " MV ", "Tiny Desk Concert")
DENY_CATEGORIES = ("25", "10")
ALLOW_CATEGORIES = (22, 23, 24, 26, 27, 28, 19)
# Pattern groups of the category/pattern filter.
PATTERN_GROUPS = {
    "sports": ("vs.", " vs ", "highlights", "full game", "recap", "game winner", "overtime"),
    "news": ("press conference", "live:", "live |", "webcast", "briefing", "hearing", "[full]"),
    "corporate": ("official trailer", "teaser trailer", "announcement trailer", "launch event",
                  "unpacked", "keynote", "introducing "),
    "commerce": ("deals", "prime day", "black friday", "coupon", "discount", "sale"),
}
# Curiosity hooks and generic-label patterns of the text heuristic.
HOOK_PHRASES = (
    "i spent", "i tried", "i survived", "i ruined", "i built", "i made", "the truth about",
    "no one tells you", "no one is talking about", "you won't believe", "what happens when",
    "gone wrong", "nobody asked", "i did",
)
GENERIC_PATTERNS = ("official trailer", "season", "episode", "ep.", "highlights", "ft.", "feat.")
# SFT quality bounds (F11), inclusive.
TITLE_LEN = (10, 100)
TRANSCRIPT_LEN = (200, 50_000)
DESCRIPTION_LEN = (40, 20_000)


def split(df: DataFrame, keep_col: str) -> tuple[DataFrame, DataFrame]:
    """Kept and removed sides of a tagged frame (one plan, two filters)."""
    return df.where(F.col(keep_col)), df.where(~F.col(keep_col))


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ----------------------------------------------------------- row-local rules
def deny_listed(channel, channels: Iterable[str] = DENY_CHANNELS) -> Column:
    """F1 predicate: channel exactly in the deny-list (null never matches)."""
    c = F.col(channel) if isinstance(channel, str) else channel
    return _b(c.isin(*list(channels)))


def promo_title(title, literals: Iterable[str] = PROMO_LITERALS) -> Column:
    """F3 predicate: title contains a promotional literal, case-insensitive."""
    return contains_any(title, literals, mode="literal")


def denied_category(category, denied: Iterable[str] = DENY_CATEGORIES) -> Column:
    """F4 predicate: stripped text of the category id is in the deny set."""
    c = F.col(category) if isinstance(category, str) else category
    return _b(F.trim(c.cast("string")).isin(*list(denied)))


def allowed_category(df: DataFrame, category: str = "categoryId",
                     allowed: Iterable[int] = ALLOW_CATEGORIES) -> Column:
    """F5 predicate: category in the allow set; missing column -> pass, null -> drop."""
    if category not in df.columns:
        return F.lit(True)
    return _b(F.col(category).try_cast("double").isin(*[float(a) for a in allowed]))


def pattern_group(title, mode: str = "literal") -> Column:
    """F6 reason: first matching pattern group name, else null."""
    t = F.lower(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    out = F.lit(None).cast("string")
    for name in reversed(list(PATTERN_GROUPS)):
        out = F.when(contains_any(t, PATTERN_GROUPS[name], mode=mode), F.lit(name)).otherwise(out)
    return out


def category_pattern_keep(df: DataFrame, title: str = "title", category: str = "categoryId",
                          mode: str = "literal") -> Column:
    """F6 keep flag: allowed category and no pattern group hit."""
    return allowed_category(df, category) & pattern_group(title, mode).isNull()


def text_heuristic_keep(title: str = "title", min_len: int = 5, max_len: int = 120, mode: str = "literal") -> Column:
    """F7 keep flag: length in [min,max] AND ('?' or a hook) AND no generic label."""
    t = F.coalesce(F.col(title), F.lit(""))
    n = title_len(t)
    hook = F.contains(t, F.lit("?")) | contains_any(t, HOOK_PHRASES, mode=mode)
    generic = contains_any(t, GENERIC_PATTERNS, mode=mode)
    return (n >= min_len) & (n <= max_len) & hook & ~generic


def language_keep(title: str = "title", enabled: bool = False) -> Column:
    """F8 keep flag: English-like titles, only when enabled."""
    return is_english_like(title) if enabled else F.lit(True)


def sft_quality_keep(source, source_text, title) -> Column:
    """title 10..100 and, per source, transcript 200..50,000 or
    description 40..20,000 characters (inclusive)."""
    tl = title_len(title)
    sl = title_len(source_text)
    src = F.col(source) if isinstance(source, str) else source
    title_ok = (tl >= TITLE_LEN[0]) & (tl <= TITLE_LEN[1])
    # as one bucket and not by ``between``, which would make the text, stripped by the caller, twice
    within = lambda lo, hi: F.width_bucket(sl, F.lit(lo), F.lit(hi + 1), F.lit(1)) == 1
    text_ok = (F.when(src == "transcript", within(*TRANSCRIPT_LEN))
               .when(src == "description", within(*DESCRIPTION_LEN))
               .otherwise(F.lit(False)))
    return title_ok & text_ok


def blank_transcripts(df: DataFrame, cols: Sequence[str] = ("video_id", "title", "description")) -> DataFrame:
    """rows with a blank transcript, projected for a retry."""
    return df.where(safe_strip("full_transcript") == "").select(*[safe_strip(c).alias(c) for c in cols])


def unretryable(df: DataFrame) -> DataFrame:
    """F16: rows still blank after a retry, with their status."""
    return (df.where(safe_strip("full_transcript") == "")
            .select(safe_strip("video_id").alias("video_id"), F.col("transcript_source").alias("status")))


def guard_min_rows(df: DataFrame, minimum: int = 20) -> DataFrame:
    """the rows of ``df``; reading them fails when there are fewer than
    ``minimum``. The check is part of the plan (a count over at most
    ``minimum`` rows as a scalar subquery), so nothing runs while it is built.
    No row at all fails too: the check's own row is what raises."""
    n = df.limit(minimum).agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit(f"at least {minimum} examples are needed, passed the filters: "), F.col("n").cast("string"))
    ok = n.select(F.when(F.col("n") >= minimum, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")).alias("ok"))
    return df.where(ok.scalar())


# ------------------------------------------------------ table-level rules
def tag_high_volume(df: DataFrame, channel: str = "channelTitle", max_videos: int = 400,
                    out: str = "high_volume") -> DataFrame:
    """Flag rows of channels with more than ``max_videos`` rows
    (counted over all input rows; strict ``>``)."""
    counts = (df.where(F.col(channel).isNotNull()).groupBy(channel).count()
              .where(F.col("count") > max_videos).select(channel, F.lit(True).alias(out)))
    return df.join(counts, channel, "left").withColumn(out, _b(F.col(out)))


def tag_virality(df: DataFrame, tie: Sequence[str], view_rel_min: float = 2.0, max_per_channel: int = 20,
                 channel: str = "channelTitle", out: str = "keep_virality") -> DataFrame:
    """F9 (A8 + W1): keep rows whose views are at least ``view_rel_min`` times
    their channel's median (median 0 counts as 1) and that rank within the
    channel's top ``max_per_channel`` by that ratio. Null channels never pass.

    A row below ``view_rel_min`` always ranks after every row above it, so the
    rank limit is applied to the passing rows only; Spark then plans a
    partial top-k before the shuffle. The kept rows come back as counts by
    (channel, tie, ratio): rows that repeat all of these are alike to the
    ranking, and as many of them are tagged as were kept (null-safe, so null
    dates count; no row is added or lost).
    """
    rel = _with_view_rel(df, channel)
    passing = rel.where(F.col(channel).isNotNull() & (F.col("view_rel") >= view_rel_min))
    key = [channel, *tie, "view_rel"]
    kept = _top_by_ratio(passing, tie, max_per_channel, channel, "view_rel")
    counts = kept.select(F.struct(*key).alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__kept"))
    among = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    tagged = rel.withColumn("__key", F.struct(*key)).join(counts, "__key", "left")
    tagged = tagged.withColumn("__nth", F.when(F.col("__kept").isNotNull(), among))
    return tagged.withColumn(out, _b(F.col("__nth") <= F.col("__kept"))).drop("__key", "__kept", "__nth")


def _with_view_rel(df: DataFrame, channel: str) -> DataFrame:
    """``view_rel``: views over the channel's median (A8); null without a channel."""
    vc = F.coalesce(F.col("view_count").try_cast("double"), F.lit(0.0))
    work = df.withColumn("__vc", vc)
    med = quantile(work.where(F.col(channel).isNotNull()), [channel], "__vc", 0.5, "__med")
    med = med.withColumn("__med", F.when(F.col("__med") == 0, F.lit(1.0)).otherwise(F.col("__med")))
    return work.join(med, channel, "left").withColumn("view_rel", F.col("__vc") / F.col("__med")).drop("__vc", "__med")


def _top_by_ratio(rows: DataFrame, tie: Sequence[str], k: int, channel: str, ratio: str) -> DataFrame:
    from titlelake.operators.windows import top_k_per_group

    return top_k_per_group(rows, [channel], [F.col(ratio).desc()] + [F.col(t) for t in tie], k)


def virality_kept(df: DataFrame, tie: Sequence[str], view_rel_min: float = 2.0, max_per_channel: int = 20,
                  channel: str = "channelTitle") -> DataFrame:
    """F9 kept side only: no join back to the removed rows."""
    rel = _with_view_rel(df.where(F.col(channel).isNotNull()), channel)
    passing = rel.where(F.col("view_rel") >= view_rel_min)
    return _top_by_ratio(passing, tie, max_per_channel, channel, "view_rel").drop("view_rel")


def engagement_thresholds(df: DataFrame, like_quantile: float = 0.5, comment_quantile: float = 0.5,
                          min_views: int = 10_000) -> DataFrame:
    """One row (like_thr, comment_thr) over rows with views >= min_views;
    no row at all when none is eligible."""
    e = with_engagement(df)
    vc = F.coalesce(F.col("view_count").try_cast("double"), F.lit(0.0))
    eligible = e.where(vc >= min_views)
    return quantiles(eligible, [], {"like_thr": ("like_rate", like_quantile),
                                    "comment_thr": ("comment_rate", comment_quantile)})


def tag_engagement(df: DataFrame, like_quantile: float = 0.5, comment_quantile: float = 0.5,
                   min_views: int = 10_000, out: str = "keep_engagement") -> DataFrame:
    """like_rate >= q_l AND comment_rate >= q_c; the thresholds enter as
    scalar subqueries (computed once). No eligible row -> every row passes."""
    if "view_count" not in df.columns:
        return df.withColumn(out, F.lit(True))
    thr = engagement_thresholds(df, like_quantile, comment_quantile, min_views)
    e = with_engagement(df)
    t = thr.select(F.struct("like_thr", "comment_thr")).scalar()
    keep = (F.coalesce(F.col("like_rate") >= t["like_thr"], F.lit(True))
            & F.coalesce(F.col("comment_rate") >= t["comment_thr"], F.lit(True)))
    return e.withColumn(out, keep)
