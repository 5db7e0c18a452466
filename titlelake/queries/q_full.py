"""Metrics and text functions over whole texts of ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import ORACLES, register
from titlelake.functions import text as tx
from titlelake.operators import metrics as mt
from titlelake.queries.q_functions import strip_sql, tokens_sql
from titlelake.queries.q_metrics import PAIRS, TOK
from titlelake.session import cut_lineage_and_shuffles

# Each whole text against itself with its halves swapped; every turn against the next.
HALVES = ["cast(doc_id as string) as id", "text as reference",
          "concat(substr(text, cast(floor(length(text) / 2) as int) + 1), ' isn''t ', substr(text, 1, cast(floor(length(text) / 2) as int))) as prediction"]
WHOLE = f"with recursive pp as (select {', '.join(HALVES)} from documents),\n" + (
    f"pairs as (select id, {strip_sql('reference')} as reference, {strip_sql('prediction')} as prediction from pp "
    f"where {strip_sql('reference')} <> '' and {strip_sql('prediction')} <> '')\n")


def whole_pairs(spark, sf):
    return mt.clean_pairs(fx.base(spark, sf, "documents").selectExpr(*HALVES))


def _on_whole(name: str) -> str:
    sql = ORACLES[name]
    assert sql.startswith(PAIRS)
    return WHOLE + sql[len(PAIRS):]


@register("M1_rouge1_whole_texts", _on_whole("M1_rouge1_pairs"))
def q_m1_whole(spark, sf):
    r = mt.rouge_n(whole_pairs(spark, sf), 1)
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@register("M1_rouge2_whole_texts", _on_whole("M1_rouge2_pairs"))
def q_m1_2_whole(spark, sf):
    r = mt.rouge_n(whole_pairs(spark, sf), 2)
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@register("M2_rougeL_conversations", f"""
with recursive toks as (
  select a.conv_id, a.turn, {TOK.format(x='a.text')} as r, {TOK.format(x='b.text')} as p
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
dp(conv_id, turn, i, j, v) as (
  select conv_id, turn, 0, unnest(range(0, len(p) + 1)), 0 from toks
  union all
  select s.conv_id, s.turn, s.i + 1, s.j,
    max(greatest(s.v, s.before + case when t.r[s.i + 1] = t.p[s.j] then 1 else 0 end)) over (partition by s.conv_id, s.turn order by s.j)
  from (select *, coalesce(lag(v) over (partition by conv_id, turn order by j), 0) as before from dp) s
  join toks t on s.conv_id = t.conv_id and s.turn = t.turn where s.i < len(t.r)),
l as (select t.conv_id, t.turn, len(t.r) as nr, len(t.p) as np, d.v as lcs from dp d join toks t
      on d.conv_id = t.conv_id and d.turn = t.turn and d.i = len(t.r) and d.j = len(t.p)),
m as (select conv_id, turn, case when nr > 0 and np > 0 then lcs / np else 0 end as p, case when nr > 0 and np > 0 then lcs / nr else 0 end as r from l)
select concat(conv_id, '/', turn) as id, round(p, 6) as p, round(r, 6) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from m""")
def q_m2_conversations(spark, sf):
    c = fx.base(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    pairs = c.join(after, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("reference"), "prediction")
    r = mt.rouge_l(pairs)
    return r.select("id", *[F.round(x, 6).alias(x) for x in ("p", "r", "f1")])


@register("M6_sentiment_whole_texts", _on_whole("M6_sentiment"))
def q_m6_whole(spark, sf):
    c = mt.compound_scores(whole_pairs(spark, sf), fx.lexicon(spark))
    return c.select("id", F.round("compound", 6).alias("compound"))


@register("M7_ttr_whole_texts", _on_whole("M7_ttr"))
def q_m7_whole(spark, sf):
    return mt.ttr(whole_pairs(spark, sf)).select(F.round("diversity_ttr", 6).alias("diversity_ttr"))


@register("M8_self_bleu_whole_texts", _on_whole("M8_self_bleu"))
def q_m8_whole(spark, sf):
    """Every whole document against all others; the oracle clips by brute force. Orders meet one after the other,
    so that no more is on disk than what one of them shuffles."""
    return mt.self_bleu(whole_pairs(spark, sf), hold=cut_lineage_and_shuffles).select(F.round("diversity_self_bleu", 6).alias("diversity_self_bleu"))


STOPS = "[" + ", ".join(f"'{w}'" for w in tx.ENGLISH_STOPWORDS) + "]"
SHARE = "length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) / greatest(length(coalesce(text, '')), 1)"
LINES = f"string_split_regex(coalesce(text, ''), '{tx.LINE_BREAK_CLASS}')"
SNIPPETS = f"list_filter(list_transform({LINES}, lambda s: {strip_sql('s')}), lambda s: s <> '')"


@register("P_text_functions_whole_texts", f"""
select doc_id, md5({strip_sql('text')}) as stripped, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) as norm,
  round({SHARE}, 6) as ascii_ratio, cast(len({tokens_sql('text')}) as int) as n_tokens, list_has_any({tokens_sql('text')}, {STOPS}) as has_stopword,
  (coalesce(text, '') <> '' and ({SHARE} >= 0.6 or list_has_any({tokens_sql('text')}, {STOPS}))) as english_like,
  md5({strip_sql(f"array_to_string({SNIPPETS}, ' ')")}) as snippets
from documents""")
def q_p_whole(spark, sf):
    d = fx.base(spark, sf, "documents")
    return d.select("doc_id", F.md5(tx.safe_strip("text")).alias("stripped"), F.md5(tx.normalize_title("text")).alias("norm"),
                    F.round(tx.ascii_letter_ratio("text"), 6).alias("ascii_ratio"), F.size(tx.word_tokens("text")).alias("n_tokens"),
                    tx.has_stopword("text").alias("has_stopword"), tx.is_english_like("text").alias("english_like"),
                    F.md5(tx.join_snippets(F.split(F.coalesce("text", F.lit("")), tx.LINE_BREAK_CLASS))).alias("snippets"))
