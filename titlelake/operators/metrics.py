"""Generation metrics (M1-M11) as Spark jobs.

Inputs are DataFrames: ``pairs(id, reference, prediction)``, optional
embedding frames ``(vec_id, embedding)``, a token-loss table
``(id, model, kind, pos, nll)`` and a sentiment lexicon ``(token, valence)``.
Every metric reduces to n-gram explodes, keyed partial aggregates and joins;
corpus-level results are one-row frames. Empty inputs give NaN, as the
reference's empty-metrics contract requires.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlelake.functions.text import NON_WORD_RE, STRIP_CLASS, not_blank, safe_strip, word_tokens
from titlelake.operators.aggregates import mean_std, mean_std_columns
from titlelake.operators.lone_grams import lone_counts
from titlelake.operators.nearest import max_products

NAN = float("nan")
# Mode-collapse cut, sentiment cuts, the published VADER
# constants (normalisation alpha 15, negation scalar -0.74, caps increment
# 0.733, "but" weights 0.5 / 1.5, "!" 0.292 up to 4, "?" 0.18 up to 3 else
# 0.96, booster decay 0.95 / 0.9 at distance 2 / 3) and the negation words.
MODE_COLLAPSE_THRESHOLD = 0.95
SENTIMENT_CUT = 0.05
VADER_ALPHA = 15.0
NEGATION_SCALAR = -0.74
CAPS_INCREMENT = 0.733
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
BANG_INCREMENT = 0.292
QUESTION_INCREMENT = 0.18
QUESTION_MAX = 0.96
BOOST_DECAY_2 = 0.95
BOOST_DECAY_3 = 0.9
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent",
    "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "no", "nobody", "none", "nope", "nor", "not",
    "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt",
    "rarely", "seldom", "despite",
)
# "isn't" and "don't" become one word before tokens are cut.
CONTRACTION_RE = "([A-Za-z]+[nN])['\u2019]([tT])([^A-Za-z]|$)"
#: Most tokens of a sentiment phrase.
PHRASE_WORDS = 4
SELF_BLEU_MAX_N = 4
SMOOTH_EPS = 0.1


def one_row_join(frames: list[DataFrame]) -> DataFrame:
    """Put one-row aggregate frames side by side (each side has exactly one
    row, so broadcasting it is size-bounded)."""
    keyed = [f.withColumn("__k", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(F.broadcast(b), "__k"), keyed).drop("__k")


# ------------------------------------------------------------------ F12
def clean_pairs(pairs: DataFrame) -> DataFrame:
    """strip both sides; keep pairs where both are non-blank."""
    kept = pairs.where(not_blank("reference") & not_blank("prediction"))
    return kept.select("id", safe_strip("reference").alias("reference"), safe_strip("prediction").alias("prediction"))


# ------------------------------------------------------------- ROUGE
def _runs_of(text: Column, one: str) -> Column:
    """The runs of characters that match ``one``, in order. (``split`` compiles its pattern anew for each row.)"""
    return F.regexp_extract_all(text, F.lit(f"{one}+"), F.lit(0))


def rouge_tokens(t) -> Column:
    """ROUGE tokens: lower-case, runs of non [a-z0-9] split, no stemming."""
    s = F.lower(F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit("")))
    return _runs_of(s, "[a-z0-9]")


def _ngrams(tokens: Column, n: int) -> Column:
    """All contiguous n-grams (space-joined); empty when there are fewer than n tokens. (Tokens are
    picked one by one: ``slice`` goes through the whole array each time.)"""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.concat_ws(" ", *[F.get(tokens, k + j) for j in range(n)]))


def _gram_counts(texts: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """``texts`` with each token array of ``cols`` replaced by its distinct n-grams and their counts (structs
    ``g, c``), counted within the row: equal grams are neighbours in the sorted array, a run of them one entry."""
    rest = [c for c in texts.columns if c not in cols]
    # each step is read several times by the next, so Spark keeps it as a column
    ordered = texts.select(*rest, *[F.sort_array(_ngrams(F.col(c), n)).alias(c) for c in cols])

    def starts(c: str) -> Column:
        at = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1)))

    found = ordered.select(*rest, *cols, *[starts(c).alias(f"__at_{c}") for c in cols])

    def runs(c: str) -> Column:
        at = F.col(f"__at_{c}")
        ends = F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(F.size(c)))
        return F.zip_with(at, F.when(F.size(at) > 0, ends).otherwise(at), lambda a, b: F.struct(F.get(c, a).alias("g"), (b - a).alias("c")))

    return found.select(*rest, *[runs(c).alias(c) for c in cols])


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """M1: per pair ROUGE-n precision / recall / F1 from clipped n-gram
    overlap. A pair's grams are counted and met within its row: the i-th occurrence of a
    gram on one side meets the i-th on the other. No gram is a row and nothing is shuffled."""
    tok = pairs.select("id", rouge_tokens("reference").alias("r"), rouge_tokens("prediction").alias("p"))
    sized = tok.select("*", *[F.greatest(F.size(c) - n + 1, F.lit(0)).alias(f"n{c}") for c in ("r", "p")])

    def numbered(c: str) -> Column:
        # no token holds "#", so later occurrences are told from all other grams
        again = lambda e: F.transform(F.sequence(F.lit(1), e["c"]), lambda k: F.when(k == 1, e["g"]).otherwise(F.concat(e["g"], F.lit("#"), k.cast("string"))))
        return F.flatten(F.transform(c, again))

    counted = _gram_counts(sized, ("r", "p"), n)
    s = counted.select("id", "nr", "np", F.size(F.array_intersect(numbered("r"), numbered("p"))).cast("long").alias("ov"))
    prec = F.col("ov") / F.greatest(F.col("np"), F.lit(1))
    rec = F.col("ov") / F.greatest(F.col("nr"), F.lit(1))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return s.select("id", prec.cast("double").alias("p"), rec.cast("double").alias("r"), f1.alias("f1"))


@F.pandas_udf(T.LongType())
def _lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of two token arrays, bit-parallel: a bit of ``row`` stands for
    a token of ``y`` and is cleared where the common subsequence grows, so
    one token of ``x`` is a handful of operations on whole machine words."""
    out = np.zeros(len(a), dtype=np.int64)
    for k, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None or len(x) == 0 or len(y) == 0:
            continue
        at: dict[str, int] = {}
        for j, tok in enumerate(y):
            at[tok] = at.get(tok, 0) | 1 << j
        full = (1 << len(y)) - 1
        row = full
        for tok in x:
            hit = row & at.get(tok, 0)
            if hit:
                row = (row + hit | row - hit) & full
        out[k] = len(y) - row.bit_count()
    return pd.Series(out)


def rouge_l(pairs: DataFrame) -> DataFrame:
    """M2: per pair ROUGE-L precision / recall / F1 (LCS over tokens)."""
    tok = pairs.select("id", rouge_tokens("reference").alias("r"), rouge_tokens("prediction").alias("p"))
    s = tok.select("id", F.size("r").alias("nr"), F.size("p").alias("np"), _lcs_len("r", "p").alias("lcs"))
    ok = (F.col("nr") > 0) & (F.col("np") > 0)
    prec = F.when(ok, F.col("lcs") / F.col("np")).otherwise(F.lit(0.0))
    rec = F.when(ok, F.col("lcs") / F.col("nr")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return s.select("id", prec.alias("p"), rec.alias("r"), f1.alias("f1"))


def rouge_summary(pairs: DataFrame) -> DataFrame:
    """M1+M2 corpus summary: mean / population std of p, r, f1 per variant."""
    frames = []
    for name, per in (("rouge1", rouge_n(pairs, 1)), ("rouge2", rouge_n(pairs, 2)), ("rougeL", rouge_l(pairs))):
        frames.append(mean_std(per, {f"{name}_{k}": k for k in ("p", "r", "f1")}))
    return one_row_join(frames)


# ------------------------------------------------------------- cosine
def _unit(v) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    c = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    # a zero vector has no direction: NaN, which summaries skip
    return F.transform(c, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(NAN)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroid(corpus: DataFrame, col: str = "embedding") -> DataFrame:
    """M3: one row ``c``: mean of unit corpus vectors, renormalised. The
    per-dimension average is a keyed partial aggregate; the result has one
    entry per dimension."""
    dims = corpus.select(F.posexplode(_unit(col)).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    arr = dims.agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("s"))
    return arr.select(_unit(F.transform("s", lambda e: e["m"])).alias("c"))


def cosine_to_centroid(preds: DataFrame, corpus: DataFrame, col: str = "embedding") -> DataFrame:
    """M3: per prediction, cosine to the corpus centroid."""
    c = centroid(corpus, col).withColumn("__k", F.lit(1))
    p = preds.select("vec_id", _unit(col).alias("u")).withColumn("__k", F.lit(1))
    return p.join(F.broadcast(c), "__k").select("vec_id", _dot(F.col("u"), F.col("c")).alias("cos_centroid"))


def max_cosine(preds: DataFrame, corpus: DataFrame, col: str = "embedding", pred_blocks: int | None = None,
               corpus_blocks: int | None = None) -> DataFrame:
    """M4 (J8): per prediction, max cosine to any corpus vector (no self-exclusion).

    Exact all-pairs work is done block by block: both sides are reduced to
    their distinct unit vectors (a maximum does not change, and however many
    vectors are equal, none fills a block) and hashed into blocks, every
    (prediction block, corpus block) pair meets once through an equi-join on
    the replicated corpus-block index, a vectorised matmul in ``mapInPandas``
    yields each vector's best score per corpus block, and a keyed ``max``
    combines the blocks. Individual pairs never become rows.

    The block counts default to the session's shuffle partitions (an eighth of
    them for the corpus, since predictions are replicated once per corpus
    block), so plan building reads no data; pass counts to bound a block's rows.
    A zero vector gives NaN, and a corpus with one gives NaN for all, as numpy's maximum does.
    """
    partitions = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pred_blocks = pred_blocks or max(1, partitions)
    corpus_blocks = corpus_blocks or max(1, partitions // 8)
    # Blocks travel as flat row-major double arrays (one Arrow list per
    # block), which convert to numpy without per-element Python objects.
    units = preds.select("vec_id", _unit(col).alias("u")).withColumn("uk", F.xxhash64("u"))
    pb = (units.select("uk", "u").groupBy("uk").agg(F.first("u").alias("u"))
          .groupBy(F.pmod(F.xxhash64("uk"), F.lit(pred_blocks)).alias("pb"))
          .agg(F.collect_list(F.struct("uk", "u")).alias("s"))
          .select("pb", F.transform("s", lambda r: r["uk"]).alias("ids"),
                  F.flatten(F.transform("s", lambda r: r["u"])).alias("P")))
    cb = (corpus.select(_unit(col).alias("u")).withColumn("uk", F.xxhash64("u"))
          .groupBy("uk").agg(F.first("u").alias("u"))
          .groupBy(F.pmod(F.xxhash64("uk"), F.lit(corpus_blocks)).alias("cb"))
          .agg(F.flatten(F.collect_list("u")).alias("C")))
    grid = pb.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1)))).join(cb, "cb")

    def block_max(it):
        for pdf in it:
            ids, best = [], []
            for i_arr, P, C in zip(pdf["ids"], pdf["P"], pdf["C"]):
                n_p = len(i_arr)
                if n_p == 0 or C is None or len(C) == 0:
                    continue
                pm = np.asarray(P, dtype=np.float64).reshape(n_p, -1)
                cm = np.asarray(C, dtype=np.float64).reshape(-1, pm.shape[1])
                ids.append(np.asarray(i_arr, dtype=np.int64))
                best.append((pm @ cm.T).max(axis=1))
            if ids:
                top = np.concatenate(best)
                none = np.isnan(top)  # pandas would turn NaN into null
                yield pd.DataFrame({"uk": np.concatenate(ids), "s": np.where(none, 0.0, top), "none": none})

    per_block = grid.select("ids", "P", "C").mapInPandas(block_max, "uk long, s double, none boolean")
    best = per_block.groupBy("uk").agg(F.when(F.max("none"), F.lit(NAN)).otherwise(F.max("s")).alias("max_sim"))
    return units.select("vec_id", "uk").join(best, "uk").select("vec_id", "max_sim")


def max_cosine_by_cells(preds: DataFrame, corpus: DataFrame, col: str = "embedding", pivots: int = 64,
               block_bytes: int = 8 << 20) -> DataFrame:
    """M4 (J8) for a large corpus: the same maximum by the pivot cells of ``titlelake.operators.nearest``.

    A block of the corpus holds
    ``block_bytes`` at most and is opened only by predictions whose maximum may lie in it. The
    corpus' blocks and each prediction's first similarity are computed when this is called, so callers
    pass its result on (``cosine_summary`` and ``evaluate`` take it as ``max_sims``). A zero
    vector gives NaN, and a corpus with one gives NaN for all, as numpy's maximum does; null vectors are skipped.
    """
    units, distinct = distinct_units(preds, col)
    _, pool = distinct_units(corpus, col)
    usable = lambda df: df.where(~F.isnan(F.element_at("u", 1)))
    found = max_products(usable(distinct), usable(pool), pivots, block_bytes)
    spoilt = pool.agg(F.bool_or(F.isnan(F.element_at("u", 1))).alias("nan")).first()["nan"]
    if found is None or spoilt:
        every = units.select("vec_id", F.lit(NAN).alias("max_sim"))
        return every if spoilt else every.limit(0)
    out = units.join(found.best, "uk", "left")
    return out.select("vec_id", F.coalesce("s", F.lit(NAN)).alias("max_sim"))


def distinct_units(vectors: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """``vec_id, uk`` of every vector that is not null (where it has an id) and its distinct unit vectors ``uk, u``."""
    have = vectors.where(F.col(col).isNotNull() & (F.size(col) > 0))
    units = have.select(*[c for c in ("vec_id",) if c in have.columns], _unit(col).alias("u")).withColumn("uk", F.xxhash64("u"))
    return units.drop("u"), units.groupBy("uk").agg(F.first("u").alias("u"))


def cells_opened(preds: DataFrame, corpus: DataFrame, col: str = "embedding", pivots: int = 64, block_bytes: int = 8 << 20) -> DataFrame:
    """One row: ``opened``, the blocks that the distinct predictions open together, of ``possible`` without bounds."""
    distinct, pool = distinct_units(preds, col)[1], distinct_units(corpus, col)[1]
    found = max_products(distinct, pool, pivots, block_bytes)
    if found is None:
        return distinct.agg(F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("possible"))
    return found.met.agg(F.sum("n").alias("opened")).withColumn("possible", F.lit(found.blocks * distinct.count()).cast("long"))


def cosine_summary(preds: DataFrame, corpus: DataFrame, col: str = "embedding", max_sims: DataFrame | None = None) -> DataFrame:
    """M3-M5 summary row; NaN when either side is empty. ``max_sims``: the result of
    ``max_cosine_by_cells``, where the corpus is large; without it ``max_cosine`` is part of the plan."""
    names = COSINE_NAMES
    cc = mean_std(cosine_to_centroid(preds, corpus, col), {"cosine_mean_corpus": "cos_centroid"})
    mx = max_cosine(preds, corpus, col) if max_sims is None else max_sims
    ms = mean_std(mx, {"cosine_max_sim": "max_sim"})
    prop = mx.agg(F.when(F.count(F.lit(1)) > 0, F.avg(((F.col("max_sim") >= MODE_COLLAPSE_THRESHOLD) & ~F.isnan("max_sim")).cast("double")))
                  .otherwise(F.lit(NAN)).alias("cosine_max_sim_prop_above_95"))
    return one_row_join([cc, ms, prop]).select(*names)


# ------------------------------------------------------------ sentiment
def compound_scores(texts: DataFrame, lexicon: DataFrame, text: str = "prediction",
                    boosters: DataFrame | None = None, negations: Sequence[str] = NEGATIONS,
                    phrases: DataFrame | None = None) -> DataFrame:
    """M6: per text, the lexicon compound score ``s / sqrt(s^2 + 15)``.

    Rules of Hutto & Gilbert (2014) applied to each lexicon hit (the lexicon
    is a caller table joined on the lower-cased token): an ALL-CAPS hit in a
    mixed-case text moves 0.733 away from zero; each of the three preceding
    tokens that is one of ``negations`` scales by -0.74 (contractions such as
    "isn't" are one token, "isnt"); hits before the first "but" scale by 0.5, after
    it by 1.5. ``s`` then moves away from zero by 0.292 per "!" (at most 4)
    plus, for two or more "?", 0.18 each (0.96 beyond three).

    With an optional ``boosters`` table (token, increment), a booster word
    (not itself in the lexicon) among the three tokens before a hit adds its
    increment in the hit's direction (plus 0.733 when it is ALL CAPS in a
    mixed-case text), scaled by 1, 0.95 and 0.9 with distance; this comes
    before the negation rule.

    With an optional ``phrases`` table (phrase, valence; two to four tokens, space-joined), a phrase that
    a hit stands in gives the hit its valence instead of the lexicon's ("kiss of death", "the shit"), before all
    other rules; of several the longest counts, then the one that starts first.

    A token row carries at most the three tokens before and after it, so rows stay
    linear in the text. Rows are told apart by their content; rows alike in
    identifier and text are scored together and divided by their number. Texts and hits meet
    in one aggregate, so a text is shuffled once, as numbers, and joined with nothing."""
    raw = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), CONTRACTION_RE, "$1$2$3")
    src = texts.select("id", F.xxhash64("id", text).alias("__row"), raw.alias("raw"))
    orig = F.filter(F.split("raw", NON_WORD_RE), lambda x: x != "")
    tok = src.select("id", "__row", orig.alias("o"),
                     (F.length("raw") - F.length(F.replace("raw", F.lit("!"), F.lit("")))).alias("bang"),
                     (F.length("raw") - F.length(F.replace("raw", F.lit("?"), F.lit("")))).alias("qm"))
    caps = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    n_caps = F.size(F.filter("o", caps))
    tok = tok.withColumns({"cap_diff": (n_caps > 0) & (n_caps < F.size("o")),
                           "but_at": F.array_position(F.transform("o", F.lower), "but")})
    # those tokens that there are; ``slice`` would go through the whole text for each
    near = lambda i, steps: F.filter(F.array(*[F.get("o", i + k) for k in steps]), lambda x: x.isNotNull())
    entry = F.transform("o", lambda x, i: F.struct(
        i.alias("i"), x.alias("word"), near(i, (-3, -2, -1)).alias("prev"),
        *([near(i, range(1, PHRASE_WORDS)).alias("next")] if phrases is not None else [])))
    ex = tok.select("id", "__row", "cap_diff", "but_at", F.explode(entry).alias("e")).select(
        "id", "__row", "cap_diff", "but_at", "e.*").withColumn("token", F.lower("word"))
    hits = ex.join(lexicon.select(F.lower("token").alias("token"), "valence"), "token")
    if phrases is not None:
        hits = hits.join(_phrase_valences(hits, phrases), ["__row", "i"], "left")
        hits = hits.withColumn("valence", F.coalesce("phrase_valence", "valence"))
    val = F.col("valence")
    v = F.when(F.col("cap_diff") & caps(F.col("word")),
               F.when(val > 0, val + CAPS_INCREMENT).otherwise(val - CAPS_INCREMENT)).otherwise(val)
    if boosters is not None:
        hits = hits.join(_booster_sums(hits, lexicon, boosters), ["__row", "i"], "left")
        v = v + F.coalesce(F.col("boost"), F.lit(0.0))
    n_neg = F.size(F.filter("prev", lambda x: F.lower(x).isin(*negations)))
    v = v * F.pow(F.lit(NEGATION_SCALAR), n_neg)
    pos1 = F.col("i") + 1
    v = (F.when((F.col("but_at") > 0) & (pos1 < F.col("but_at")), v * BUT_BEFORE)
         .when((F.col("but_at") > 0) & (pos1 > F.col("but_at")), v * BUT_AFTER).otherwise(v))
    none = F.lit(None)
    both = tok.select("id", "__row", "bang", "qm", F.lit(1).alias("rows"), none.cast("double").alias("v")).unionByName(
        hits.select("id", "__row", none.cast("int").alias("bang"), none.cast("int").alias("qm"), none.cast("int").alias("rows"), v.alias("v")))
    out = both.groupBy("id", "__row").agg(F.max("bang").alias("bang"), F.max("qm").alias("qm"), F.sum("rows").alias("rows"), F.sum("v").alias("s"))
    out = out.withColumn("s", F.coalesce(F.col("s") / F.col("rows"), F.lit(0.0)))
    qm = F.col("qm")
    punct = (F.least(F.col("bang"), F.lit(4)) * BANG_INCREMENT
             + F.when(qm > 1, F.when(qm <= 3, qm * QUESTION_INCREMENT).otherwise(F.lit(QUESTION_MAX)))
             .otherwise(F.lit(0.0)))
    s2 = (F.when(F.col("s") > 0, F.col("s") + punct).when(F.col("s") < 0, F.col("s") - punct)
          .otherwise(F.col("s")))
    scored = out.select("id", (s2 / F.sqrt(s2 * s2 + VADER_ALPHA)).alias("compound"), "rows")
    return scored.select("id", "compound", F.explode(F.sequence(F.lit(1), "rows"))).drop("col")  # one row for each text


def _phrase_valences(hits: DataFrame, phrases: DataFrame) -> DataFrame:
    """``__row, i, phrase_valence`` of the hits that stand in a phrase: each names the
    runs of two to four tokens around it (nine at most), which a keyed join looks up."""
    around = F.concat("prev", F.array("word"), "next")
    own = hits.select("__row", "i", around.alias("w"), (F.size("prev") + 1).alias("at"))

    def runs_of(size: int) -> Column:
        first, last = F.greatest(F.col("at") - size + 1, F.lit(1)), F.least(F.col("at"), F.size("w") - size + 1)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(F.lit(size).alias("size"), k.alias("start"), F.lower(F.array_join(F.slice("w", k, F.lit(size)), " ")).alias("phrase")))

    runs = [runs_of(size) for size in range(2, PHRASE_WORDS + 1)]
    cand = own.select("__row", "i", F.explode(F.concat(*runs)).alias("r")).select("__row", "i", "r.*")
    table = phrases.groupBy(F.lower("phrase").alias("phrase")).agg(F.max("valence").alias("pv"))
    return cand.join(table, "phrase").groupBy("__row", "i").agg(F.max_by("pv", F.struct(F.col("size"), -F.col("start"))).alias("phrase_valence"))


def _booster_sums(hits: DataFrame, lexicon: DataFrame, boosters: DataFrame) -> DataFrame:
    """Per lexicon hit: summed booster contributions of the up to three
    preceding tokens, the nearest last in ``prev`` (keyed joins; no per-row
    Python). Rows alike in identifier and text each add theirs."""
    near = F.transform("prev", lambda x, k: F.struct(x.alias("pword"), (F.size("prev") - k).alias("d")))
    cand = hits.select("__row", "i", "valence", "cap_diff", F.explode(near).alias("n")).select(
        "__row", "i", "valence", "cap_diff", "n.*").withColumn("ptok", F.lower("pword"))
    cand = (cand.join(boosters.select(F.lower("token").alias("ptok"), "increment"), "ptok")
            .join(lexicon.select(F.lower("token").alias("ptok")), "ptok", "left_anti"))
    val, pw = F.col("valence"), F.col("pword")
    scalar = F.when(val < 0, -F.col("increment")).otherwise(F.col("increment"))
    caps = F.col("cap_diff") & (pw == F.upper(pw)) & (pw != F.lower(pw))
    scalar = F.when(caps, F.when(val > 0, scalar + CAPS_INCREMENT).otherwise(scalar - CAPS_INCREMENT)).otherwise(scalar)
    scale = F.when(F.col("d") == 1, 1.0).when(F.col("d") == 2, BOOST_DECAY_2).otherwise(BOOST_DECAY_3)
    # equal entries of rows alike are one contribution
    one = cand.groupBy("__row", "i", "d").agg(F.first(scalar * scale).alias("x"))
    return one.groupBy("__row", "i").agg(F.sum("x").alias("boost"))


def sentiment_summary(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    c = compound_scores(pairs, lexicon).withColumn("abs", F.abs("compound"))
    n = F.count(F.lit(1))
    share = lambda cond: F.when(n > 0, F.count_if(cond) / n).otherwise(F.lit(NAN))
    # one aggregate: the scores are computed once
    return c.agg(*mean_std_columns({"sentiment_compound": "compound", "sentiment_compound_abs": "abs"}),
                 share(F.col("compound") > SENTIMENT_CUT).alias("sentiment_prop_positive"),
                 share(F.col("compound") < -SENTIMENT_CUT).alias("sentiment_prop_negative"),
                 share(F.col("compound").between(-SENTIMENT_CUT, SENTIMENT_CUT)).alias("sentiment_prop_neutral"))


# ------------------------------------------------------------ diversity
def ttr(pairs: DataFrame, text: str = "prediction") -> DataFrame:
    """M7: distinct / total word tokens over the corpus; none -> NaN."""
    toks = pairs.select(F.explode(word_tokens(F.lower(safe_strip(text)))).alias("w"))
    per = toks.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.when(F.sum("c") > 0, F.count(F.lit(1)) / F.sum("c")).otherwise(F.lit(NAN)).alias("diversity_ttr"))


def self_bleu(pairs: DataFrame, text: str = "prediction", max_n: int = SELF_BLEU_MAX_N,
              hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """M8: mean sentence BLEU-``max_n`` of each text against all *other*
    texts (uniform weights, epsilon-0.1 smoothing of zero counts, zero when
    no unigram matches, brevity from the closest other length, ties to the
    shorter); fewer than two texts -> NaN. Whitespace tokens, case-sensitive.

    Linear and without a join on n-grams: clipped against all others, a text keeps the i-th
    occurrence of a gram if another text has i of them too, and loses it otherwise. So per text
    and order, matches = number of grams - occurrences that it alone has, which ``lone_counts`` finds.
    Equal texts are texts each; identifiers are not used. The brevity factor depends on the number of tokens only, so the
    rest of the score is summed by it. With ``hold`` (see ``lone_counts``) jobs run when it is called.
    """
    per = lone_counts(pairs.select(text), max_n, hold)
    nums = {n: F.greatest(F.col("len") - n + 1, F.lit(0)) - F.col(str(n)) for n in range(1, max_n + 1)}
    logp = []
    for n in range(1, max_n + 1):
        num = nums[n].cast("double")
        den = F.greatest(F.col("len") - n + 1, F.lit(1)).cast("double")
        p = F.when(num > 0, num / den).otherwise(F.lit(SMOOTH_EPS) / den)
        logp.append(F.log(p) / max_n)
    precision = F.when(nums[1] == 0, F.lit(0.0)).otherwise(F.exp(reduce(lambda a, b: a + b, logp)))
    hist = per.groupBy("len").agg(F.sum("k").alias("k"), F.sum(precision * F.col("k")).alias("p"))
    # Closest other length (ties -> shorter), from the length histogram. The
    # neighbour lookup orders the *distinct token counts* (at most the length
    # of the longest text), not the texts, so one task suffices.
    w = Window.orderBy("len")
    hist = hist.select("len", "k", "p", F.lag("len").over(w).alias("lo"), F.lead("len").over(w).alias("hi"))
    closest = F.when(F.col("k") >= 2, F.col("len")).when(
        F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(
        F.col("len") - F.col("lo") <= F.col("hi") - F.col("len"), F.col("lo")).otherwise(F.col("hi"))
    c, r = F.col("len").cast("double"), closest.cast("double")
    bp = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))  # null where there is no other text
    scored = hist.agg(F.sum("k").alias("__n"), (F.sum(bp * F.col("p")) / F.sum("k")).alias("__m"))
    return scored.select(
        F.when((F.col("__n") >= 2) & F.col("__m").isNotNull(), F.col("__m")).otherwise(F.lit(NAN))
        .alias("diversity_self_bleu"))


# ------------------------------------------------------------ perplexity
def perplexity_summary(nll: DataFrame, max_positions: int = 128, models=("base", "self"),
                       kinds=("pred", "ref")) -> DataFrame:
    """M9: per text exp(mean token NLL over positions < ``max_positions``),
    non-finite -> NaN; then NaN-safe mean / std per (model, kind). Models
    absent from the table give NaN."""
    t = nll.where(F.col("pos") < max_positions)
    per = t.groupBy("id", "model", "kind").agg(F.avg("nll").alias("m")).select(
        "model", "kind", F.exp("m").alias("ppl"))
    specs = {f"perplexity_{m}_{k}": F.when((F.col("model") == m) & (F.col("kind") == k), F.col("ppl"))
             for m in models for k in kinds}
    return mean_std(per, specs)


# ------------------------------------------------------------ M10 / M11
ROUGE_NAMES = [f"{n}_{m}_{s}" for n in ("rouge1", "rouge2", "rougeL") for m in ("p", "r", "f1") for s in ("mean", "std")]
COSINE_NAMES = ["cosine_mean_corpus_mean", "cosine_mean_corpus_std", "cosine_max_sim_mean", "cosine_max_sim_std",
                "cosine_max_sim_prop_above_95"]
PERPLEXITY_NAMES = [f"perplexity_{m}_{k}_{s}" for m in ("base", "self") for k in ("pred", "ref") for s in ("mean", "std")]
SENTIMENT_NAMES = ["sentiment_compound_mean", "sentiment_compound_std", "sentiment_compound_abs_mean",
                   "sentiment_compound_abs_std", "sentiment_prop_positive", "sentiment_prop_negative",
                   "sentiment_prop_neutral"]
DIVERSITY_NAMES = ["diversity_ttr", "diversity_self_bleu"]
METRIC_NAMES = ROUGE_NAMES + COSINE_NAMES + PERPLEXITY_NAMES + SENTIMENT_NAMES + DIVERSITY_NAMES
METRICS_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in METRIC_NAMES])


def _nan_row(like: DataFrame, names: Sequence[str]) -> DataFrame:
    return like.sparkSession.range(1).select(*[F.lit(NAN).alias(n) for n in names])


def evaluate(pairs: DataFrame, lexicon: DataFrame, pred_emb: DataFrame | None = None,
             corpus_emb: DataFrame | None = None, token_nll: DataFrame | None = None,
             ref_emb: DataFrame | None = None, max_sims: DataFrame | None = None) -> DataFrame:
    """Every metric family in one wide row (the 40 names of
    ``METRIC_NAMES``). Empty input -> every value NaN (M11).

    Embeddings enter as tables: ``pred_emb`` (``vec_id, embedding``, and ``id``
    where they belong to pairs: then only those of kept pairs count), and the
    corpus as ``corpus_emb`` (rows whose optional ``text`` is blank are left
    out) or, without one, ``ref_emb`` (``id, embedding``): the references of the
    kept pairs are the corpus. ``max_sims``: see ``cosine_summary``. The plan is lazy; a caller that has costly
    pairs passes them materialised, since every family reads them."""
    p = clean_pairs(pairs)
    kept = p.select("id")
    if pred_emb is not None and "id" in pred_emb.columns:
        pred_emb = pred_emb.join(kept, "id", "left_semi")
    if corpus_emb is not None and "text" in corpus_emb.columns:
        corpus_emb = corpus_emb.where(safe_strip("text") != "")
    if corpus_emb is None and ref_emb is not None:
        corpus_emb = ref_emb.join(kept, "id", "left_semi")
    parts = [rouge_summary(p), cosine_summary(pred_emb, corpus_emb, max_sims=max_sims) if pred_emb is not None and corpus_emb is not None
             else _nan_row(p, COSINE_NAMES)]
    parts.append(perplexity_summary(token_nll.join(kept, "id", "left_semi")) if token_nll is not None
                 else _nan_row(p, PERPLEXITY_NAMES))
    parts += [sentiment_summary(p, lexicon), ttr(p), self_bleu(p)]
    row = one_row_join(parts)
    return row.select(*[F.col(n).cast("double").alias(n) for n in METRIC_NAMES])
