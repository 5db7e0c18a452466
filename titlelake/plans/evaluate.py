"""Evaluate a run (M10 -> K6 JSON) and compare runs (S11 -> M12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.functions.text import fmt4

# The nine comparison metrics, in display order.
DISPLAY_KEYS = (
    "rougeL_f1_mean", "cosine_mean_corpus_mean", "cosine_max_sim_mean", "cosine_max_sim_prop_above_95",
    "sentiment_compound_abs_mean", "diversity_ttr", "diversity_self_bleu", "perplexity_self_ref_mean",
    "perplexity_base_ref_mean",
)


def compare_runs(runs: DataFrame) -> DataFrame:
    """One row per run (``run`` + metric columns), the nine display
    metrics formatted with four decimals; missing or NaN -> 'nan'; sorted by run."""
    cols = set(runs.columns)
    out = [F.col("run")] + [(fmt4(k) if k in cols else F.lit("nan")).alias(k) for k in DISPLAY_KEYS]
    return runs.select(*out).orderBy("run")


def label_runs(rows: dict[str, DataFrame]) -> DataFrame:
    """Union metric rows of several in-memory runs, tagged with their name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn("run", F.lit(name)) for name, df in rows.items()])
