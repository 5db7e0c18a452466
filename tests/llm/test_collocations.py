import random
import re
from collections import Counter

import pytest

from titlelake.llm import collocations_dic
from titlelake.llm.collocations_dic import Config, collocations, phrase_counts


def brute(rows, least, top=2000):
    """Everything from explicit lists of words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = [(g, p, a) for (g, p), a in f.items() if len(p) > 1 and a >= least]
    more = {}
    for g, p, a in cands:
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = g, p[i : i + m]
                more[key] = max(a, more.get(key, 0))
    out = {}
    for g, p, a in cands:
        if 100 * more.get((g, p), 0) >= 80 * a:
            continue
        score, k, l, r = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])), f


def texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "the", "a", "é", "日本", "of", "Zürich", "x'y", "\x1c", "<ff>", "one two"]
    sets = [["new", "york", "city", "hall"], ["of", "the", "A", "team"], ["strč", "prst"], ["a", "a", "a", "a"]]
    out = []
    for _ in range(n):
        line = ""
        for _ in range(rng.randint(0, 60)):
            line += " ".join(rng.choice(sets)) if rng.random() < 0.2 else rng.choice(words)
            line += rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\x0b"])
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), line))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'x' as phrase", "1 as n", "2 as a").repartition(parts)


@pytest.mark.parametrize("cfg", [Config(), Config(least=5, shards=1), Config(least=9, shards=5, block_words=200), Config(least=4, shards=2, block_words=50, slots=64)])
def test_against_lists_of_words(spark, cfg):
    rows = texts(3, 150)
    want, f = brute(rows, cfg.least)
    got = collocations(frame(spark, rows), cfg)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want and want
    if cfg.slots == 64:  # nearly every slot set by others: more is counted, nothing else found
        counts, _ = phrase_counts(frame(spark, rows), cfg)
        found = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in counts.collect()}
        assert found == {k: c for k, c in f.items() if c >= cfg.least}


def test_top_and_ties(spark):
    rows = [("en", f"{a} {b}") for a in "abcdefgh" for b in "éz" for _ in range(6)]
    want, _ = brute(rows, 6, top=5)
    got = collocations(frame(spark, rows), Config(least=6, top=5)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 5


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    want, _ = brute([("en", t) for _, t in edge_rows], 30)
    got = collocations(edge_docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == want and want
    assert collocations(no_docs).count() == 0


def test_exact_keys_of_large_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    numbers = [rng.integers(0, 1 << 20, 500) for _ in range(4)]
    numbers = [np.concatenate([x, x]) for x in numbers]
    keys = collocations_dic.exact_keys(numbers, 1 << 20)
    assert len(np.unique(keys)) == len(set(zip(*(x.tolist() for x in numbers)))) and (keys[:500] == keys[500:]).all()
