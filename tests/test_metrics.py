import math
from collections import Counter

from titlelake.operators import metrics as mt


def brute_self_bleu(texts):
    toks = [t.split() for t in texts]
    cnt = [[Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for n in range(1, 5)] for t in toks]
    out = []
    for i, t in enumerate(toks):
        ps = []
        for n in range(4):
            hc = cnt[i][n]
            num = sum(min(c, max(cnt[j][n].get(g, 0) for j in range(len(toks)) if j != i)) for g, c in hc.items())
            ps.append((num, max(1, sum(hc.values()))))
        if ps[0][0] == 0:
            out.append(0.0)
            continue
        r = min((len(toks[j]) for j in range(len(toks)) if j != i), key=lambda L: (abs(L - len(t)), L))
        bp = 1.0 if len(t) > r else math.exp(1 - r / len(t))
        out.append(bp * math.exp(sum(0.25 * math.log(a / b if a else 0.1 / b) for a, b in ps)))
    return sum(out) / len(out)


def pairs_df(spark, preds):
    return spark.createDataFrame([(str(i), "ref", p) for i, p in enumerate(preds)],
                                 "id string, reference string, prediction string")


def test_self_bleu_matches_brute_force(spark):
    preds = ["the cat sat on the mat", "the cat ran", "a dog sat on a log today", "the cat sat on the mat",
             "I tried it", "nothing here matches at all", "on the mat the cat sat", "x"]
    got = mt.self_bleu(pairs_df(spark, preds)).first()[0]
    assert math.isclose(got, brute_self_bleu(preds), rel_tol=1e-9)


def test_self_bleu_needs_two_texts(spark):
    assert math.isnan(mt.self_bleu(pairs_df(spark, ["only one"])).first()[0])


def lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_rouge_l_matches_dp(spark):
    rows = [("1", "The quick brown fox jumps", "quick fox jumps high"), ("2", "a b c d e", "e d c b a"),
            ("3", "!!!", "something")]
    df = spark.createDataFrame(rows, "id string, reference string, prediction string")
    got = {r["id"]: r for r in mt.rouge_l(df).collect()}
    r1 = got["1"]
    n = lcs("the quick brown fox jumps".split(), "quick fox jumps high".split())
    assert math.isclose(r1["p"], n / 4) and math.isclose(r1["r"], n / 5)
    assert got["3"]["f1"] == 0.0


def test_empty_input_gives_nan_row(spark):
    lex = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    row = mt.evaluate(pairs_df(spark, ["", "  "]), lex).first()
    assert len(row) == len(mt.METRIC_NAMES) == 40
    assert all(math.isnan(v) for v in row)


def test_sentiment_rules(spark):
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    texts = {"a": "good", "b": "not good", "c": "GOOD movie", "d": "bad but good", "e": "good!!", "f": "good??",
             "g": "nothing here"}
    df = spark.createDataFrame(list(texts.items()), "id string, prediction string")
    got = {r["id"]: r["compound"] for r in mt.compound_scores(df, lex).collect()}

    def comp(s):
        return s / math.sqrt(s * s + 15)
    want = {"a": comp(1.9), "b": comp(1.9 * -0.74), "c": comp(1.9 + 0.733), "d": comp(-2.5 * 0.5 + 1.9 * 1.5),
            "e": comp(1.9 + 2 * 0.292), "f": comp(1.9 + 2 * 0.18), "g": 0.0}
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12), k


def test_sentiment_boosters(spark):
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    boost = spark.createDataFrame([("very", 0.293), ("barely", -0.293)], "token string, increment double")
    texts = {"a": "very good", "b": "very very good", "c": "VERY good stuff", "d": "very bad", "e": "barely good",
             "f": "good"}
    df = spark.createDataFrame(list(texts.items()), "id string, prediction string")
    got = {r["id"]: r["compound"] for r in mt.compound_scores(df, lex, boosters=boost).collect()}

    def comp(s):
        return s / math.sqrt(s * s + 15)
    want = {"a": comp(1.9 + 0.293), "b": comp(1.9 + 0.293 + 0.293 * 0.95), "c": comp(1.9 + 0.293 + 0.733),
            "d": comp(-2.5 - 0.293), "e": comp(1.9 - 0.293), "f": comp(1.9)}
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9), k


def test_pairs_of_one_id_are_scored_each_for_itself(spark):
    rows = [("1", "the cat sat", "the cat sat"), ("1", "a dog", "no match here"), ("2", "a b c", "a b x"), ("2", "a b c", "a b x")]
    df = spark.createDataFrame(rows, "id string, reference string, prediction string")
    got = sorted(round(r["f1"], 6) for r in mt.rouge_n(df, 1).collect())
    assert got == [0.0, 0.666667, 0.666667, 1.0]


def test_zero_vector_is_nan_and_skipped(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    corpus = df.where("vec_id > 1")
    row = mt.cosine_summary(df, corpus).first()
    assert math.isclose(row["cosine_max_sim_mean"], 1.0) and math.isclose(row["cosine_mean_corpus_mean"], math.sqrt(0.5))
    assert math.isclose(row["cosine_max_sim_prop_above_95"], 2 / 3)


def test_max_cosine_with_equal_vectors(spark):
    """Mode collapse: all vectors equal are one vector of one block."""
    same = spark.range(3000).selectExpr("id as vec_id", "array(1D, 2D, 3D) as embedding")
    got = mt.max_cosine(same, same, pred_blocks=5, corpus_blocks=5)
    assert got.count() == 3000 and got.where("abs(max_sim - 1) > 1e-9").count() == 0


def test_sentiment_contractions_and_double_negation(spark):
    lex = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    texts = ["this isn't good", "is not good", "don\u2019t say good", "not never good", "good", "good", "NOT good"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("4", "good")], "id string, prediction string")
    got = {}
    for r in mt.compound_scores(df, lex).collect():
        got.setdefault(r["id"], []).append(round(r["compound"], 4))
    norm = lambda s: round(s / math.sqrt(s * s + 15), 4)
    neg, plain = norm(1.9 * -0.74), norm(1.9)
    assert got["0"] == got["1"] == got["2"] == [neg] and got["3"] == [norm(1.9 * 0.74 * 0.74)]
    assert got["4"] == [plain, plain] and got["5"] == [plain] and got["6"] == [neg]
    own = mt.compound_scores(df, lex, negations=("say",)).where("id = '2'").first()["compound"]
    assert round(own, 4) == neg


def test_evaluate_takes_references_as_corpus_and_kept_pairs_only(spark):
    pairs = spark.createDataFrame([("1", "a b", "a c"), ("2", "x", " ")], "id string, reference string, prediction string")
    emb = spark.createDataFrame([("1", 1, [1.0, 0.0]), ("2", 2, [0.0, 1.0])], "id string, vec_id long, embedding array<double>")
    lex = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    row = mt.evaluate(pairs, lex, pred_emb=emb, ref_emb=emb).first()
    assert row["cosine_max_sim_mean"] == 1.0 and row["cosine_mean_corpus_mean"] == 1.0
    corpus = spark.createDataFrame([("t", [0.0, 1.0]), (" ", [1.0, 0.0])], "text string, embedding array<double>")
    assert mt.evaluate(pairs, lex, pred_emb=emb, corpus_emb=corpus).first()["cosine_max_sim_mean"] == 0.0


def test_sentiment_phrases(spark):
    """A phrase gives the hits in it its valence: the longest, then the first; other rules follow."""
    lex = spark.createDataFrame([("kiss", 1.8), ("death", -2.9), ("good", 1.9)], "token string, valence double")
    phrases = spark.createDataFrame([("Kiss of death", -1.5), ("of death", 3.0), ("good kiss", 0.5), ("so good", 2.5), ("one two three four five", 9.0)], "phrase string, valence double")
    texts = ["a kiss of death", "KISS of Death here", "kiss", "not so good", "good kiss good", "of death", "kiss of good death"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, prediction string")
    got = {r["id"]: round(r["compound"], 6) for r in mt.compound_scores(df, lex, phrases=phrases).collect()}
    norm = lambda s: round(s / math.sqrt(s * s + 15), 6)
    assert got["0"] == norm(-1.5 * 2) and got["1"] == norm(-1.5 * 2 - 0.733) and got["2"] == norm(1.8)
    assert got["3"] == norm(2.5 * -0.74) and got["4"] == norm(0.5 * 2 + 1.9) and got["5"] == norm(3.0) and got["6"] == norm(1.8 + 1.9 - 2.9)
    plain = {r["id"]: round(r["compound"], 9) for r in mt.compound_scores(df, lex, phrases=phrases.limit(0)).collect()}
    assert plain == {r["id"]: round(r["compound"], 9) for r in mt.compound_scores(df, lex).collect()}


def test_rouge_n_meets_grams_within_the_row(spark):
    """Repeated grams count as often as both sides have them, rows alike each for itself, and nothing is shuffled."""
    import random

    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["a", "b", "a1", "1", "c2"]) for _ in range(rng.randrange(0, 30)))
    rows = [(str(k), text(), text()) for k in range(60)] + [("x", "a a a b", "a a b"), ("x", "a a a b", "a a b"), ("y", None, "a b")]
    pairs = spark.createDataFrame(rows, "id string, reference string, prediction string").repartition(3)
    for n in (1, 2, 3):
        df = mt.rouge_n(pairs.coalesce(1), n)
        grams = lambda t, n=n: Counter(zip(*[(t or "").split()[k:] for k in range(n)]))
        want = []
        for i, r, p in rows:
            a, b = grams(r), grams(p)
            ov = sum((a & b).values())
            prec, rec = ov / max(sum(b.values()), 1), ov / max(sum(a.values()), 1)
            want.append((i, round(prec, 9), round(rec, 9), round(2 * prec * rec / (prec + rec) if ov else 0.0, 9)))
        assert sorted((x["id"], round(x["p"], 9), round(x["r"], 9), round(x["f1"], 9)) for x in df.collect()) == sorted(want)
        plan = mt.rouge_n(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as id", "text as reference", "lang as prediction"), n)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_sentiment_tokens_are_not_shuffled_to_meet_the_lexicon(spark):
    from titlelake import fixtures as fx

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as id", "text as prediction")
    plan = mt.compound_scores(texts, fx.lexicon(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [token" in plan and "hashpartitioning(token" not in plan
    assert fx.lexicon(spark).collect() == spark.createDataFrame(fx.LEXICON, "token string, valence double").collect()


def test_self_bleu_shuffles_no_grams_as_text(spark):
    """What meets the other texts is a hash of fixed width; no inferred filter counts a text's grams once more for each gram."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as id", "text as prediction")
    df = mt.self_bleu(texts)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(h#" in plan and "hashpartitioning(n#" not in plan and "hashpartitioning(key#0, k" not in plan
    assert "size(zip_with" not in plan
    few = [" ".join(r.prediction.split()[:12]) for r in texts.limit(30).collect()] + ["a b a b a", "a b a b a", "a a a a b", "z"]
    got = mt.self_bleu(pairs_df(spark, few)).collect()[0]["diversity_self_bleu"]
    assert math.isclose(got, brute_self_bleu(few), rel_tol=1e-9)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentiment_scores_are_computed_once_and_joined_with_the_lexicon_only(spark):
    lexicon = spark.createDataFrame([("great", 3.0)], "token string, valence double")
    rows = spark.createDataFrame([(None, "r", "great"), (None, "r", "great"), ("a", "r", "great"), ("b", "r", "dull")], "id string, reference string, prediction string")
    assert _optimized(mt.sentiment_summary(rows, lexicon)).count("Join") == 1
    got = mt.compound_scores(rows, lexicon).collect()
    assert sorted(str(r["id"]) for r in got) == ["None", "None", "a", "b"]  # rows alike stay rows
    assert all(math.isclose(r["compound"], 0.0 if r["id"] == "b" else 3 / math.sqrt(24)) for r in got)


def test_self_bleu_cuts_the_texts_once(spark):
    plan = _optimized(mt.self_bleu(pairs_df(spark, ["a b", "a b", "c d"])))
    distinct = [line for line in plan.splitlines() if "Aggregate [_groupingexpression" in line]
    assert distinct and all("first(t" in line for line in distinct)  # the number of texts is read from the same aggregate
