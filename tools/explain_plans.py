"""Write the physical operator trees of the headline plans to PLANS.md.

Usage: python tools/explain_plans.py [sf_dir]
Only the operator tree of ``explain("formatted")`` is kept (node details omitted).
"""

from __future__ import annotations

import io
import sys
from contextlib import redirect_stdout

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import functions as F  # noqa: E402

from titlelake import fixtures as fx  # noqa: E402
from titlelake.operators import filters as flt  # noqa: E402
from titlelake.operators import metrics as mt  # noqa: E402
from titlelake.operators.quantiles import quantile  # noqa: E402
from titlelake.operators.windows import dedupe_titles, rank_within_channel  # noqa: E402
from titlelake.plans import sft, transcripts  # noqa: E402
from titlelake.session import local_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0].replace("== Physical Plan ==\n", "")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    # the fixtures are small: without this the plans would show broadcasts that real sizes do not allow
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    t = fx.trending(spark, sf)
    tie = ("video_id", "trending_date")
    plans = {
        "F9 virality (A8 exact channel median + partial top-k)": flt.virality_kept(t, tie),
        "A8 exact per-group median alone": quantile(t, ["channelTitle"], "view_count", 0.5),
        "W2 title dedupe (min_by, partial aggregation)": dedupe_titles(t, tie),
        "F10 engagement (thresholds as one scalar subquery)": flt.tag_engagement(t).where("keep_engagement"),
        "L6 transcript merge (semi/anti id joins + best-by-score)":
            transcripts.merge(fx.transcripts_in(spark, sf), fx.videos(spark, sf))[0],
        "W7 seeded split (cut hash per stratum)":
            sft.split(sft.examples(fx.videos(spark, sf).withColumn("row_index", F.col("doc_id")))),
        "M1 ROUGE-2 per pair (n-gram explode + keyed aggregates)":
            mt.rouge_n(fx.generations(spark, sf).select("id", "reference", F.col("raw_output").alias("prediction")), 2),
        "W1 rank within channel (value buckets)": rank_within_channel(t, "channelTitle", "view_count", tie),
        "M8 self-BLEU (count levels, no join on n-grams)":
            mt.self_bleu(fx.generations(spark, sf).select("id", "reference", F.col("raw_output").alias("prediction"))),
        "M4 max cosine (blocked matmul in mapInPandas)":
            mt.max_cosine(fx.pred_emb(spark, sf), fx.corpus_emb(spark, sf)),
    }
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `python tools/explain_plans.py {sf}` (local[8], AQE on, size-based broadcasts off; initial",
           "plans: at run time AQE may broadcast a measured small side or split skewed partitions).", ""]
    for title, df in plans.items():
        out += [f"## {title}", "", "```", tree(df).rstrip(), "```", ""]
    with open(__file__.rsplit("/tools/", 1)[0] + "/PLANS.md", "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
