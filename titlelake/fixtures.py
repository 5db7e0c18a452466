"""Derived input views over the driver tables.

The driver ships generic tables (documents, embeddings, conversations, ...).
The operators in this package work on trending tables, transcript records,
fetch outcomes, generations and token losses. Each view below derives one of
those shapes from a driver table with plain projections, so its size grows
with the table it reads. Every view is defined once as SQL select-list text
that Spark and DuckDB both accept; ``spark_view`` builds it as a DataFrame and
``duckdb_ctes`` renders the same definitions as a WITH prefix for the oracle
SQL. (A one-for-one character replace commutes with ``substr``, so titles
cut the text first and replace newlines in the short prefix only.) Nothing
here subsets rows for cost: ``pred_emb``/``corpus_emb`` split the
embeddings table into two roles that together cover every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- videos
VIDEOS = [
    "doc_id",
    "concat('v', cast(doc_id as string)) as video_id",
    "concat(case when doc_id % 7 = 0 then 'I tried ' else '' end,"
    " replace(substr(text, 1, cast(4 + doc_id % 113 as int)), chr(10), ' '),"
    " case when doc_id % 5 = 0 then '?' else '' end,"
    " case when doc_id % 11 = 3 then ' Official Video' when doc_id % 13 = 4 then ' MV out'"
    " when doc_id % 17 = 5 then ' vs. rival' when doc_id % 19 = 6 then ' season 2' else '' end) as title",
    "cast(date '2020-08-03' + cast(doc_id % 1300 as int) as timestamp) as publishedAt",
    "concat('UC', source) as channelId",
    "case when doc_id % 50 = 49 then null else source end as channelTitle",
    "cast(case doc_id % 11 when 0 then 10 when 1 then 17 when 2 then 19 when 3 then 20 when 4 then 22"
    " when 5 then 23 when 6 then 24 when 7 then 25 when 8 then 26 when 9 then 27 else 28 end as int) as categoryId",
    "case when doc_id % 9 = 0 then '[None]' else concat('t', cast(doc_id % 6 as string)) end as tags",
    "case when doc_id % 101 = 0 then cast(0 as bigint) else cast(n_chars as bigint) * 97 + doc_id end as view_count",
    "case when doc_id % 101 = 0 then cast(0 as bigint) else cast(floor((cast(n_chars as bigint) * 97 + doc_id)"
    " * (1 + doc_id % 9) / 100) as bigint) end as likes",
    "case when doc_id % 101 = 0 then cast(0 as bigint) else cast(floor((cast(n_chars as bigint) * 97 + doc_id)"
    " * (1 + doc_id % 5) / 1000) as bigint) end as comment_count",
    "case when doc_id % 61 = 0 then null else text end as description",
    "case when doc_id % 3 <> 0 then text else '' end as full_transcript",
]

# -------------------------------------------------------------- trending
# One row per (video, snapshot day d); a video trends for 1..3 days
# (d = 0 .. doc_id % 3). The day index comes from a per-row sequence, not
# from a join.
TRENDING = [
    "doc_id",
    "video_id",
    "case d when 1 then replace(title, ' ', '  ') when 2 then concat(title, '!!!') else title end as title",
    "publishedAt",
    "channelId",
    "channelTitle",
    "categoryId",
    "date '2020-08-12' + cast(doc_id % 1300 + d as int) as trending_date",
    "tags",
    "view_count * (1 + d) as view_count",
    "likes * (1 + d) as likes",
    "comment_count * (1 + d) as comment_count",
    "description",
]

# -------------------------------------------------------- transcripts_in
# Two overlapping transcript inputs (input_rank 0 and 1) plus blank and
# foreign ids.
TRANSCRIPTS_IN = [
    (
        "doc_id % 3 <> 1",
        [
            "cast(0 as int) as input_rank",
            "doc_id as pos",
            "video_id",
            "title",
            "case when doc_id % 4 = 0 then '' else full_transcript end as full_transcript",
            "case when doc_id % 4 = 0 then 'missing' else 'api' end as transcript_source",
        ],
    ),
    (
        "doc_id % 3 <> 0",
        [
            "cast(1 as int) as input_rank",
            "doc_id as pos",
            "video_id",
            "title",
            "description as full_transcript",
            "'api' as transcript_source",
        ],
    ),
    (
        "doc_id % 40 = 7",
        [
            "cast(1 as int) as input_rank",
            "doc_id as pos",
            "case when doc_id % 2 = 0 then '' else concat('x', cast(doc_id as string)) end as video_id",
            "title",
            "'gone' as full_transcript",
            "'api' as transcript_source",
        ],
    ),
]

FETCH_LOG = [
    "doc_id as pos",
    "video_id",
    "title",
    "description",
    "case when doc_id % 6 = 4 then 'NoTranscriptFound' when doc_id % 6 in (1,2,3,5) then 'RuntimeError'"
    " else null end as exc_type",
    "case doc_id % 6 when 1 then 'This video is age-restricted; sign in' when 2 then 'This video is private'"
    " when 3 then 'YouTube is blocking your requests'"
    " when 5 then concat('transcript_fetch_error:', video_id, ':timeout:30s') else null end as exc_msg",
    "case when doc_id % 6 = 0 then description else null end as raw_text",
]

# Raw model output for every video: quoted, multi-line, empty and
# truncated variants.
GENERATIONS = [
    "video_id as id",
    "case when full_transcript <> '' then 'transcript' else 'description' end as source",
    "title as reference",
    "case when doc_id % 10 = 1 then concat('  \"', title, '\"', chr(10), 'second line')"
    " when doc_id % 10 = 5 then ''"
    " when doc_id % 10 = 7 then concat('''', title, '''')"
    " else concat(replace(title, 'th', 't'), ' - ', coalesce(channelTitle, 'none')) end as raw_output",
]

REVIEW_RESPONSES = [
    "video_id",
    "title",
    "channelTitle",
    "tags",
    "case doc_id % 5 when 0 then 'KEEP - curiosity' when 1 then 'REMOVE - brand' when 2 then 'keep - do not remove'"
    " when 3 then 'unsure' else null end as response",
    "case when doc_id % 5 = 4 then 'timeout' else null end as error",
]

# Per-token negative log-likelihoods for every video, both models, both
# texts, five positions (position 128 lies past the 128-token window).
TOKEN_NLL_MODELS = ("base", "self")
TOKEN_NLL_KINDS = ("ref", "pred")
TOKEN_NLL_POSITIONS = (0, 1, 64, 127, 128)
TOKEN_NLL = [
    "video_id as id",
    "model",
    "kind",
    "pos",
    "cast(((doc_id * 31 + pos * 17 + length(model) * 7 + length(kind)) % 400) as double) / 100 as nll",
]

# The six-entry sentiment lexicon used by the M6 fixture.
LEXICON = [
    ("the", 1.5),
    ("and", -0.8),
    ("der", 2.1),
    ("tried", -1.2),
    ("official", 0.6),
    ("la", -2.0),
]


def _sel(exprs: list[str]) -> str:
    return ",\n  ".join(exprs)


# --------------------------------------------------------------- Spark side
def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "documents").selectExpr(*VIDEOS)


def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir)
    days = v.withColumn("d", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    return days.selectExpr(*TRENDING)


def transcripts_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir)
    parts = [v.where(cond).selectExpr(*exprs) for cond, exprs in TRANSCRIPTS_IN]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos(spark, sf_dir).selectExpr(*FETCH_LOG)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos(spark, sf_dir).selectExpr(*GENERATIONS)


def review_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos(spark, sf_dir).selectExpr(*REVIEW_RESPONSES)


def token_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir).select("doc_id", "video_id")
    v = v.withColumn("model", F.explode(F.array(*[F.lit(m) for m in TOKEN_NLL_MODELS])))
    v = v.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in TOKEN_NLL_KINDS])))
    v = v.withColumn("pos", F.explode(F.array(*[F.lit(p) for p in TOKEN_NLL_POSITIONS])))
    return v.selectExpr(*TOKEN_NLL)


def pred_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "embeddings").where("vec_id % 5 = 0").select("vec_id", "embedding")


def corpus_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0").select("vec_id", "embedding")


def lexicon(spark: SparkSession) -> DataFrame:
    # as VALUES its size is known, so that it is broadcast and the texts' tokens are not shuffled to meet it
    rows = ", ".join(f"('{t}', cast({v} as double))" for t, v in LEXICON)
    return spark.sql(f"select * from values {rows} as lexicon(token, valence)")


# -------------------------------------------------------------- DuckDB side
def _duck_views() -> dict[str, str]:
    ti = "\n  union all\n  ".join(
        f"select {_sel(exprs)} from videos where {cond}" for cond, exprs in TRANSCRIPTS_IN
    )
    models = ", ".join(f"'{m}'" for m in TOKEN_NLL_MODELS)
    kinds = ", ".join(f"'{k}'" for k in TOKEN_NLL_KINDS)
    poss = ", ".join(str(p) for p in TOKEN_NLL_POSITIONS)
    lex = " union all ".join(f"select '{t}' as token, cast({v} as double) as valence" for t, v in LEXICON)
    return {
        "videos": f"select {_sel(VIDEOS)} from documents",
        "trending": (
            f"select {_sel(TRENDING)} from (select *, unnest(generate_series(0, doc_id % 3)) as d from videos) s"
        ),
        "transcripts_in": ti,
        "fetch_log": f"select {_sel(FETCH_LOG)} from videos",
        "generations": f"select {_sel(GENERATIONS)} from videos",
        "review_responses": f"select {_sel(REVIEW_RESPONSES)} from videos",
        "token_nll": (
            f"select {_sel(TOKEN_NLL)} from (select *, unnest([{poss}]) as pos from"
            f" (select *, unnest([{kinds}]) as kind from"
            f" (select doc_id, video_id, unnest([{models}]) as model from videos) a) b) c"
        ),
        "pred_emb": "select vec_id, embedding from embeddings where vec_id % 5 = 0",
        "corpus_emb": "select vec_id, embedding from embeddings where vec_id % 5 <> 0",
        "lexicon": lex,
    }


_DEPENDS = {"trending": ["videos"], "transcripts_in": ["videos"], "fetch_log": ["videos"],
            "generations": ["videos"], "review_responses": ["videos"], "token_nll": ["videos"]}


def duckdb_ctes(*names: str) -> str:
    """WITH prefix defining the named derived views (and their inputs)."""
    views = _duck_views()
    order: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    return "with " + ",\n".join(f"{n} as (\n  {views[n]}\n)" for n in order) + "\n"


def duckdb_view(name: str) -> str:
    """Body of one derived view's DuckDB definition (its inputs not included)."""
    return _duck_views()[name]
