"""L2 ``clean``: deny-listed channels, high-volume channels, promotional
titles and denied categories, with the audit pair, removal report and
funnel (F1-F4, J7, K5, A11, A12).

One tagging pass: each rule is a boolean column; ``keep`` is the negated OR
and ``reasons`` lists the rules that fired. Kept and removed sides, the
report and the funnel are all views of that one tagged plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.operators import filters as flt

RULES = ("list", "high_volume", "promo_title", "category_25", "category_10")


@dataclass(frozen=True)
class CleanConfig:
    deny_channels: tuple = flt.DENY_CHANNELS
    max_videos: int = 400
    promo_literals: tuple = flt.PROMO_LITERALS
    channel: str = "channelTitle"


def tag_clean(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Input rows + one flag per rule + ``keep`` + ``reasons``."""
    t = flt.tag_high_volume(df, cfg.channel, cfg.max_videos, out="high_volume")
    has_cat = "categoryId" in df.columns
    flags = {
        "list": flt.deny_listed(cfg.channel, cfg.deny_channels),
        "high_volume": F.col("high_volume"),
        "promo_title": flt.promo_title("title", cfg.promo_literals),
        "category_25": flt.denied_category("categoryId", ("25",)) if has_cat else F.lit(False),
        "category_10": flt.denied_category("categoryId", ("10",)) if has_cat else F.lit(False),
    }
    t = t.withColumns({f"r_{k}": v for k, v in flags.items()})
    fired = F.filter(F.array(*[F.when(F.col(f"r_{k}"), F.lit(k)) for k in RULES]), lambda x: x.isNotNull())
    return t.withColumns({"reasons": fired, "keep": F.size(fired) == 0})


def clean(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """(kept, removed); removed carries ``reasons``. Kept has the input columns."""
    t = tag_clean(df, cfg)
    kept, removed = flt.split(t, "keep")
    return kept.select(*df.columns), removed.select(*df.columns, "reasons")


def removal_funnel(tagged: DataFrame) -> DataFrame:
    """Before / per-rule removed / removed / after (rules overlap)."""
    aggs = [F.count(F.lit(1)).alias("before")]
    aggs += [F.count_if(F.col(f"r_{k}")).alias(f"removed_{k}") for k in RULES]
    aggs += [F.count_if(~F.col("keep")).alias("removed"), F.count_if(F.col("keep")).alias("after")]
    return tagged.agg(*aggs)


def removal_report(tagged: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Per removed channel, rows removed by a channel rule and why
    ("list" wins over the volume rule)."""
    by_channel = tagged.where(F.col("r_list") | F.col("r_high_volume"))
    return (by_channel.groupBy(cfg.channel)
            .agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("r_list").cast("int")).alias("__l"))
            .select(cfg.channel, "rows",
                    F.when(F.col("__l") == 1, F.lit("list"))
                    .otherwise(F.lit(f">{cfg.max_videos} videos")).alias("source")))
