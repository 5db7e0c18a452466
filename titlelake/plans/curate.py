"""L3 ``curate``: the flagship curation plan.

virality (F9) -> engagement (F10) -> [category/pattern (F6), text heuristic
(F7): off by default] -> title dedupe (W2) -> [language (F8): opt-in].

One lazy DataFrame chain: a scan, one exchange on channel for the median
sketch, a small bracket histogram, a partial top-k before the channel
exchange, a scalar subquery for the global thresholds and one partial
aggregate on (channel, normalised title) for the dedupe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.operators import filters as flt
from titlelake.operators.windows import dedupe_titles
from titlelake.session import cut_lineage

TIE = ("video_id", "trending_date")


@dataclass(frozen=True)
class CurateConfig:
    view_rel_min: float = 2.0
    max_per_channel: int = 20
    like_quantile: float = 0.5
    comment_quantile: float = 0.5
    min_views: int = 10_000
    category_pattern: bool = False
    text_heuristic: bool = False
    pattern_mode: str = "literal"
    english_only: bool = False
    keep_empty_norm: bool = False
    tie: tuple = TIE


def curate_stages(df: DataFrame, cfg: CurateConfig = CurateConfig(), materialize: bool = False) -> dict:
    """Rows surviving each stage, keyed by stage name.

    Nothing runs while the plan is built. The virality survivors (at most
    ``max_per_channel`` rows per channel) feed both the engagement-threshold
    subquery and the main path; ``materialize`` checkpoints them once to the
    shared folder, where a second pass over the source costs more.
    """
    s1 = flt.virality_kept(df, cfg.tie, cfg.view_rel_min, cfg.max_per_channel)
    if materialize:
        s1 = cut_lineage(s1)
    s2 = flt.tag_engagement(s1, cfg.like_quantile, cfg.comment_quantile, cfg.min_views)
    s2 = s2.where("keep_engagement").drop("keep_engagement")
    stages = {"input": df, "virality": s1, "engagement": s2}
    if cfg.category_pattern:
        s2 = s2.where(flt.category_pattern_keep(s2, mode=cfg.pattern_mode))
        stages["category_pattern"] = s2
    if cfg.text_heuristic:
        s2 = s2.where(flt.text_heuristic_keep(mode=cfg.pattern_mode))
        stages["text_heuristic"] = s2
    s5 = dedupe_titles(s2, cfg.tie, keep_empty_norm=cfg.keep_empty_norm)
    stages["dedupe"] = s5
    if cfg.english_only:
        stages["language"] = s5.where(flt.language_keep(enabled=True))
    return stages


def curate(df: DataFrame, cfg: CurateConfig = CurateConfig(), materialize: bool = False) -> DataFrame:
    """Curated rows (input columns + like_rate, comment_rate)."""
    return list(curate_stages(df, cfg, materialize).values())[-1]


def curate_funnel(df: DataFrame, cfg: CurateConfig = CurateConfig(), materialize: bool = False) -> DataFrame:
    """Rows surviving each stage, as (step, stage, rows)."""
    stages = curate_stages(df, cfg, materialize)
    parts = [d.select(F.lit(i).alias("step"), F.lit(name).alias("stage"))
             for i, (name, d) in enumerate(stages.items())]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("step", "stage").agg(F.count(F.lit(1)).alias("rows"))
