"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.functions.text import STRIP_CLASS
from titlelake.operators import metrics as mt
from titlelake.plans import sft
from titlelake.plans.evaluate import DISPLAY_KEYS, compare_runs, label_runs
from titlelake.queries.q_functions import strip_sql
from titlelake.queries.q_sft import ex_sql
from titlelake.session import cut_lineage


def _pairs(spark, sf):
    """Cleaned (reference, prediction) pairs, checkpointed by this caller: every metric reads them several times."""
    data, _, _ = sft.prepare(fx.videos(spark, sf).withColumn("row_index", F.col("doc_id")))
    return cut_lineage(mt.clean_pairs(sft.collect_predictions(fx.generations(spark, sf), data)))


PRED_SQL = (f"""regexp_replace(regexp_replace({strip_sql(f"string_split_regex({strip_sql('g.raw_output')}, "
            f"'[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]')[1]")}, '^"+|"+\\z', '', 'g'), """
            """'^''+|''+\\z', '', 'g')""")
PAIRS = "with recursive " + ex_sql(False)[5:] + f""",
g as ({fx.duckdb_ctes('generations').split('generations as (', 1)[1].rsplit(')', 1)[0]}),
pp as (select sp.id, {strip_sql('sp.title')} as reference, {strip_sql(PRED_SQL)} as prediction from sp join g on sp.id = g.id),
pairs as (select * from pp where reference <> '' and prediction <> '')
"""
TOK = "list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')"


def _grams_sql(n: int) -> str:
    """Grams of the token lists ``tr`` and ``tp``, which are cut once."""
    def side(t, s):
        return (f"select id, {s} as side, unnest(list_transform(range(1, len({t}) - {n} + 2), "
                f"lambda k: array_to_string({t}[k:k + {n - 1}], ' '))) as g from toks where len({t}) >= {n}")
    return side("tr", 1) + " union all " + side("tp", 2)


def _fin(rounded: bool, cols: str, raw: str) -> str:
    return cols if rounded else raw


def _rouge_sql(n: int, rounded: bool = True) -> str:
    tr, tp = TOK.format(x="reference"), TOK.format(x="prediction")
    return PAIRS + f""",
toks as materialized (select id, {tr} as tr, {tp} as tp from pairs),
gr as ({_grams_sql(n)}),
cg as (select id, g, count_if(side = 1) as cr, count_if(side = 2) as cp from gr group by id, g),
ov as (select id, sum(least(cr, cp)) as ov from cg group by id),
s as (select p.id, greatest(len(p.tr) - {n} + 1, 0) as nr, greatest(len(p.tp) - {n} + 1, 0) as np,
        coalesce(o.ov, 0) as ov from toks p left join ov o on p.id = o.id),
m as (select id, ov / greatest(np, 1) as p, ov / greatest(nr, 1) as r from s)
select """ + _fin(rounded, "id, round(p, 6) as p, round(r, 6) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1",
                 "id, p, r, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1") + " from m"


def _rouge_q(n):
    def q(spark, sf):
        r = mt.rouge_n(_pairs(spark, sf), n)
        return r.select("id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])
    return q


register("M1_rouge1_pairs", _rouge_sql(1))(_rouge_q(1))
register("M1_rouge2_pairs", _rouge_sql(2))(_rouge_q(2))


def _rouge_l_sql(rounded: bool = True) -> str:
    tr, tp = TOK.format(x="reference"), TOK.format(x="prediction")
    return PAIRS + f""",
toks as (select id, {tr} as r, {tp} as p from pairs),
dp(id, i, rw) as (
  select id, 0, list_transform(range(0, len(p) + 1), lambda x: 0) from toks
  union all
  select d.id, d.i + 1,
    [0] || list_transform(range(1, len(t.p) + 1), lambda j:
       list_max(list_transform(range(1, j + 1), lambda k:
          greatest(d.rw[k + 1], d.rw[k] + case when t.r[d.i + 1] = t.p[k] then 1 else 0 end))))
  from dp d join toks t on d.id = t.id where d.i < len(t.r)),
l as (select t.id, len(t.r) as nr, len(t.p) as np, d.rw[len(d.rw)] as lcs from dp d join toks t on d.id = t.id
      where d.i = len(t.r)),
m as (select id, case when nr > 0 and np > 0 then lcs / np else 0 end as p,
        case when nr > 0 and np > 0 then lcs / nr else 0 end as r from l)
select """ + _fin(rounded, "id, round(p, 6) as p, round(r, 6) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1",
                 "id, p, r, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1") + " from m"


@register("M2_rougeL_pairs", _rouge_l_sql())
def q_m2(spark, sf):
    r = mt.rouge_l(_pairs(spark, sf))
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


UNIT = "list_transform(cast({e} as double[]), lambda x: x / sqrt(list_sum(list_transform(cast({e} as double[]), lambda y: y * y))))"
EMB = fx.duckdb_ctes("pred_emb", "corpus_emb")


@register("M3_cosine_to_centroid", EMB + f""",
cu as (select {UNIT.format(e='embedding')} as u from corpus_emb),
d as (select i, avg(u[i]) as m from cu, (select unnest(range(1, 65)) as i) r group by i),
c as (select list(m order by i) as c from d),
cn as (select list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) as c from c)
select p.vec_id, round(list_dot_product({UNIT.format(e='p.embedding')}, cn.c), 6) as cos_centroid from pred_emb p, cn""")
def q_m3(spark, sf):
    r = mt.cosine_to_centroid(fx.pred_emb(spark, sf), fx.corpus_emb(spark, sf))
    return r.select("vec_id", F.round("cos_centroid", 6).alias("cos_centroid"))


MAXCOS = EMB + f""",
mx as (select p.vec_id, max(list_dot_product({UNIT.format(e='p.embedding')}, {UNIT.format(e='c.embedding')})) as max_sim
       from pred_emb p, corpus_emb c group by p.vec_id)
"""


@register("M4_max_cosine", MAXCOS + "select vec_id, round(max_sim, 6) as max_sim from mx")
def q_m4(spark, sf):
    r = mt.max_cosine_by_cells(fx.pred_emb(spark, sf), fx.corpus_emb(spark, sf), pivots=16, block_bytes=1 << 16)
    return r.select("vec_id", F.round("max_sim", 6).alias("max_sim"))


@register("M5_mode_collapse", MAXCOS + """
select round(avg(cast(max_sim >= 0.95 as double)), 6) as prop_above_95, round(avg(max_sim), 6) as max_sim_mean,
  round(stddev_pop(max_sim), 6) as max_sim_std from mx""")
def q_m5(spark, sf):
    preds, corpus = fx.pred_emb(spark, sf), fx.corpus_emb(spark, sf)
    s = mt.cosine_summary(preds, corpus, max_sims=mt.max_cosine_by_cells(preds, corpus))
    return s.select(F.round("cosine_max_sim_prop_above_95", 6).alias("prop_above_95"),
                    F.round("cosine_max_sim_mean", 6).alias("max_sim_mean"),
                    F.round("cosine_max_sim_std", 6).alias("max_sim_std"))


NEG = "[" + ", ".join(f"'{w}'" for w in mt.NEGATIONS) + "]"
WT = "list_filter(string_split_regex(lower(coalesce(prediction, '')), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"


RAW = "regexp_replace(coalesce(prediction, ''), '([A-Za-z]+[nN])[''\u2019]([tT])([^A-Za-z]|$)', '\\1\\2\\3', 'g')"
OT = f"list_filter(string_split_regex({RAW}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
IS_CAPS = "(o[i] = upper(o[i]) and o[i] <> lower(o[i]))"


def _sentiment_sql(phrases: str = "", valence: str = "l.valence", joined: str = "") -> str:
    return PAIRS + f""",
{fx.duckdb_ctes('lexicon')[5:]},
tk0 as (select id, {OT} as o,
          length(coalesce(prediction, '')) - length(replace(coalesce(prediction, ''), '!', '')) as bang,
          length(coalesce(prediction, '')) - length(replace(coalesce(prediction, ''), '?', '')) as qm from pairs),
tk as (select *, list_transform(o, lambda w: lower(w)) as t,
         len(list_filter(o, lambda w: w = upper(w) and w <> lower(w))) as ncaps from tk0),
tk2 as (select *, ncaps > 0 and ncaps < len(o) as cap_diff, list_position(t, 'but') as but_at from tk),
{phrases}tx as (select id, t, o, cap_diff, but_at, unnest(range(1, len(t) + 1)) as i from tk2),
h0 as (select tx.*, {valence} as valence from tx join lexicon l on t[i] = lower(l.token){joined}),
h1 as (select id, i, but_at, t, case when cap_diff and {IS_CAPS} then
         case when valence > 0 then valence + {mt.CAPS_INCREMENT} else valence - {mt.CAPS_INCREMENT} end
         else valence end as v from h0),
h2 as (select id, i, but_at, v * pow({mt.NEGATION_SCALAR}, case when i > 1 then
         len(list_filter(t[greatest(i - 3, 1):i - 1], lambda w: list_contains({NEG}, w))) else 0 end) as v from h1),
hits as (select id, case when coalesce(but_at, 0) > 0 and i < but_at then v * {mt.BUT_BEFORE}
           when coalesce(but_at, 0) > 0 and i > but_at then v * {mt.BUT_AFTER} else v end as v from h2),
s0 as (select tk2.id, tk2.bang, tk2.qm, coalesce(sum(h.v), 0) as s from tk2 left join hits h on tk2.id = h.id
       group by tk2.id, tk2.bang, tk2.qm),
s1 as (select id, s, least(bang, 4) * {mt.BANG_INCREMENT} + case when qm > 1 then case when qm <= 3
         then qm * {mt.QUESTION_INCREMENT} else {mt.QUESTION_MAX} end else 0 end as punct from s0),
s as (select id, case when s > 0 then s + punct when s < 0 then s - punct else s end as s from s1)
select id, round(s / sqrt(s * s + 15), 6) as compound from s"""


@register("M6_sentiment", _sentiment_sql())
def q_m6(spark, sf):
    c = mt.compound_scores(_pairs(spark, sf), fx.lexicon(spark))
    return c.select("id", F.round("compound", 6).alias("compound"))


#: Phrases for M6: the beginnings of two and three tokens of every prediction.
PHRASES = """ph as (select p as phrase, (length(p) * 37 % 50 - 25) / 10.0 as valence from (
  select t[1] || ' ' || t[2] as p from tk where len(t) > 1 union select t[1] || ' ' || t[2] || ' ' || t[3] from tk where len(t) > 2) x),
"""
IN_PHRASE = """ left join (
  select x.id, x.i, max_by(ph.valence, x.size * 100 - x.k) as pv from (
    select id, i, t, size, unnest(range(greatest(i - size + 1, 1), least(i, len(t) - size + 1) + 1)) as k from
      (select id, t, unnest(range(1, len(t) + 1)) as i from tk) y, unnest([2, 3, 4]) as z(size)) x
  join ph on ph.phrase = array_to_string(x.t[x.k:x.k + x.size - 1], ' ') and x.k >= x.i - 3 group by x.id, x.i) q on q.id = tx.id and q.i = tx.i"""


@register("M6_sentiment_phrases", _sentiment_sql(PHRASES, "coalesce(q.pv, l.valence)", IN_PHRASE))
def q_m6_phrases(spark, sf):
    """M6 with a table of phrases taken from the predictions themselves."""
    pairs = _pairs(spark, sf)
    raw = F.regexp_replace(F.coalesce(F.col("prediction"), F.lit("")), mt.CONTRACTION_RE, "$1$2$3")
    words = pairs.select(F.transform(F.filter(F.split(raw, mt.NON_WORD_RE), lambda x: x != ""), F.lower).alias("t"))
    phrases = words.select(F.explode(F.array(*[F.when(F.size("t") >= n, F.array_join(F.slice("t", 1, n), " ")) for n in (2, 3)])).alias("phrase"))
    phrases = phrases.where(F.col("phrase").isNotNull()).distinct().withColumn("valence", (F.length("phrase") * 37 % 50 - 25) / 10.0)
    c = mt.compound_scores(pairs, fx.lexicon(spark), phrases=phrases)
    return c.select("id", F.round("compound", 6).alias("compound"))


@register("M7_ttr", PAIRS + f"""
select round(count(distinct w) / count(*), 6) as diversity_ttr from
  (select unnest(list_filter(string_split_regex(lower({strip_sql('prediction')}), '[^\\p{{L}}\\p{{N}}_]+'),
     lambda w: w <> '')) as w from pairs) x""")
def q_m7(spark, sf):
    return mt.ttr(_pairs(spark, sf)).select(F.round("diversity_ttr", 6).alias("diversity_ttr"))


def _bleu_sql() -> str:
    toks = f"list_filter(string_split_regex({strip_sql('prediction')}, '{STRIP_CLASS}+'), lambda w: w <> '')"
    grams = " union all ".join(
        f"select id, {n} as n, unnest(list_transform(range(1, len - {n} + 2), "
        f"lambda k: array_to_string(t[k:k + {n - 1}], ' '))) as g from tk where len >= {n}" for n in range(1, 5))
    logs = " + ".join(
        f"ln(case when coalesce(n{n}, 0) > 0 then n{n} / greatest(len - {n - 1}, 1) "
        f"else 0.1 / greatest(len - {n - 1}, 1) end) / 4" for n in range(1, 5))
    return PAIRS + f""",
tk as (select id, t, len(t) as len from (select id, {toks} as t from pairs) a where len(t) > 0),
gr as ({grams}),
cnt as (select id, n, g, count(*) as c from gr group by id, n, g),
cl as (select a.id, a.n, a.g, least(a.c, coalesce(max(b.c), 0)) as num from cnt a
       left join cnt b on a.n = b.n and a.g = b.g and a.id <> b.id group by a.id, a.n, a.g, a.c),
nums as (select id, sum(num) filter (where n = 1) as n1, sum(num) filter (where n = 2) as n2,
         sum(num) filter (where n = 3) as n3, sum(num) filter (where n = 4) as n4 from cl group by id),
h as (select len, count(*) as k from tk group by len),
h2 as (select len, k, lag(len) over (order by len) as lo, lead(len) over (order by len) as hi from h),
rl as (select len, case when k >= 2 then len when lo is null then hi when hi is null then lo
         when len - lo <= hi - len then lo else hi end as rl from h2),
per as (select tk.id, tk.len, nums.n1, nums.n2, nums.n3, nums.n4, rl.rl from tk left join nums on tk.id = nums.id
        left join rl on tk.len = rl.len),
sc as (select case when coalesce(n1, 0) = 0 then 0.0 else
         (case when len > rl then 1.0 else exp(1 - rl / len) end) * exp({logs}) end as b from per where rl is not null)
select round(case when (select count(*) from tk) >= 2 and avg(b) is not null then avg(b) else 'nan'::double end, 6)
  as diversity_self_bleu from sc"""


@register("M8_self_bleu", _bleu_sql())
def q_m8(spark, sf):
    return mt.self_bleu(_pairs(spark, sf)).select(F.round("diversity_self_bleu", 6).alias("diversity_self_bleu"))


@register("M9_perplexity", fx.duckdb_ctes("token_nll") + """,
per as (select id, model, kind, exp(avg(nll)) as ppl from token_nll where pos < 128 group by id, model, kind)
select """ + ", ".join(
    f"round(avg(ppl) filter (where model = '{m}' and kind = '{k}'), 6) as perplexity_{m}_{k}_mean, "
    f"round(stddev_pop(ppl) filter (where model = '{m}' and kind = '{k}'), 6) as perplexity_{m}_{k}_std"
    for m in ("base", "self") for k in ("pred", "ref")) + " from per")
def q_m9(spark, sf):
    s = mt.perplexity_summary(fx.token_nll(spark, sf))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _l12_sql() -> str:
    from titlelake.catalog import ORACLES

    def summ(tag: str, sub: str) -> str:
        cols = ", ".join(f"avg({m}) as {m}_mean, stddev_pop({m}) as {m}_std" for m in ("p", "r", "f1"))
        return f"(select {cols} from ({sub}) x) {tag}"

    sent = ORACLES["M6_sentiment"].replace("round(s / sqrt(s * s + 15), 6) as compound", "s / sqrt(s * s + 15) as compound")
    unit_p, unit_c = UNIT.format(e="p.embedding"), UNIT.format(e="c.embedding")
    cos = EMB + f""",
cu as (select {UNIT.format(e='embedding')} as u from corpus_emb),
d as (select i, avg(u[i]) as m from cu, (select unnest(range(1, 65)) as i) r group by i),
c0 as (select list(m order by i) as c from d),
cn as (select list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) as c from c0),
cc as (select p.vec_id, list_dot_product({unit_p}, cn.c) as v from pred_emb p, cn),
mx as (select p.vec_id, max(list_dot_product({unit_p}, {unit_c})) as v from pred_emb p, corpus_emb c group by p.vec_id)
select (select avg(v) from cc) as cosine_mean_corpus_mean, (select stddev_pop(v) from cc) as cosine_mean_corpus_std,
  (select avg(v) from mx) as cosine_max_sim_mean, (select stddev_pop(v) from mx) as cosine_max_sim_std,
  (select avg(cast(v >= 0.95 as double)) from mx) as cosine_max_sim_prop_above_95"""
    mk = [(m, k) for m in ("base", "self") for k in ("pred", "ref")]
    perp = PAIRS + f""",
token_nll as ({fx.duckdb_view('token_nll')}),
per as (select id, model, kind, exp(avg(nll)) as ppl from token_nll where pos < 128
        and id in (select id from pairs) group by id, model, kind)
select """ + ", ".join(
        f"avg(ppl) filter (where model = '{m}' and kind = '{k}') as perplexity_{m}_{k}_mean, "
        f"stddev_pop(ppl) filter (where model = '{m}' and kind = '{k}') as perplexity_{m}_{k}_std" for m, k in mk) + " from per"
    sent_sum = f"""(select avg(compound) as sentiment_compound_mean, stddev_pop(compound) as sentiment_compound_std,
  avg(abs(compound)) as sentiment_compound_abs_mean, stddev_pop(abs(compound)) as sentiment_compound_abs_std,
  count_if(compound > 0.05) / count(*) as sentiment_prop_positive, count_if(compound < -0.05) / count(*) as sentiment_prop_negative,
  count_if(compound between -0.05 and 0.05) / count(*) as sentiment_prop_neutral from ({sent}) x) se"""
    srcs = ", ".join([summ("r1", _rouge_sql(1, False)), summ("r2", _rouge_sql(2, False)), summ("rl", _rouge_l_sql(False)),
                      f"({cos}) co", f"({perp}) pp", sent_sum, f"({ORACLES['M7_ttr']}) tt", f"({ORACLES['M8_self_bleu']}) sb"])
    outs = []
    for name in mt.METRIC_NAMES:
        if name.startswith("rouge"):
            fam, met, stat = name.split("_")
            tag = {"rouge1": "r1", "rouge2": "r2", "rougeL": "rl"}[fam]
            outs.append(f"round({tag}.{met}_{stat}, 6) as {name}")
        else:
            outs.append(f"round({name}, 6) as {name}")
    return "select " + ", ".join(outs) + " from " + srcs


@register("L12_evaluate_run", _l12_sql())
def q_l12(spark, sf):
    row = mt.evaluate(_pairs(spark, sf), fx.lexicon(spark), fx.pred_emb(spark, sf), fx.corpus_emb(spark, sf),
                      fx.token_nll(spark, sf))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@register("M11_empty_contract", "select " + ", ".join(f"'nan'::double as {n}" for n in mt.METRIC_NAMES))
def q_m11(spark, sf):
    """Pairs whose prediction is blank: F12 leaves nothing, every metric is NaN."""
    data, _, _ = sft.prepare(fx.videos(spark, sf).withColumn("row_index", F.col("doc_id")))
    preds = sft.collect_predictions(fx.generations(spark, sf), data)
    blank = cut_lineage(preds.where(F.col("prediction") == ""))
    return mt.evaluate(blank, fx.lexicon(spark))


def _m12_sql() -> str:
    from titlelake.catalog import ORACLES
    echo_pairs = PAIRS.replace(f"{strip_sql(PRED_SQL)} as prediction", f"{strip_sql('sp.title')} as prediction")
    assert echo_pairs != PAIRS

    def fmt(x: str) -> str:
        return f"case when {x} is null or isnan({x}) then 'nan' else printf('%.4f', {x}) end"

    def run(name: str, pairs_sql: str) -> str:
        rl = _rouge_l_sql(False).replace(PAIRS, pairs_sql)
        sent = (ORACLES["M6_sentiment"].replace("round(s / sqrt(s * s + 15), 6) as compound",
                                                "s / sqrt(s * s + 15) as compound").replace(PAIRS, pairs_sql))
        ttr = ORACLES["M7_ttr"].replace("round(count(distinct w) / count(*), 6)", "count(distinct w) / count(*)")
        bleu = ORACLES["M8_self_bleu"].replace("round(case when (select count(*) from tk) >= 2", "(case when (select count(*) from tk) >= 2")
        bleu = bleu.replace("else 'nan'::double end, 6)", "else 'nan'::double end)")
        vals = {
            "rougeL_f1_mean": f"(select avg(f1) from ({rl}) x)",
            "sentiment_compound_abs_mean": f"(select avg(abs(compound)) from ({sent}) x)",
            "diversity_ttr": f"({ttr.replace(PAIRS, pairs_sql)})",
            "diversity_self_bleu": f"({bleu.replace(PAIRS, pairs_sql)})",
        }
        cols = [f"'{name}' as run"] + [fmt(vals[k]) + f" as {k}" if k in vals else f"'nan' as {k}" for k in DISPLAY_KEYS]
        return "select " + ", ".join(cols)

    return run("model", PAIRS) + " union all " + run("echo", echo_pairs)


@register("M12_compare_runs", _m12_sql())
def q_m12(spark, sf):
    """Two runs over the same examples: the model's predictions and the
    references echoed back as predictions."""
    data, _, _ = sft.prepare(fx.videos(spark, sf).withColumn("row_index", F.col("doc_id")))
    preds = cut_lineage(sft.collect_predictions(fx.generations(spark, sf), data))
    echo = preds.withColumn("prediction", F.col("reference"))
    lex = fx.lexicon(spark)
    runs = label_runs({"model": mt.evaluate(preds, lex), "echo": mt.evaluate(echo, lex)})
    return compare_runs(runs).select("run", *DISPLAY_KEYS)
