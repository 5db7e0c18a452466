import math
import random

import numpy as np
import pytest

from titlelake.llm import whitening_polar
from titlelake.llm.whitening_polar import whiten


def brute(rows, k=4):
    """Rows by exact integers and a covariance of explicitly centred products."""
    whole = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in whole}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    y = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in whole:
        own = [n * x[j] - sums[j] for j in range(d)]
        z = (np.array([v / n for v in own]) @ vectors) / np.sqrt(np.maximum(values, 1e-300))
        out.append((i, sum(v * v for v in own), z[:k]))
    return n, values[:k], cov.trace(), out


def check(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = whiten(frame.selectExpr("*", "'x' as x", "1 as n", "2 as i")).collect()
    n, values, trace, want = brute(rows)
    k = len(values)
    assert len(got) == k * len(want) and {r["n"] for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r)
    for i, deviation, z in want:
        own = by_row[i, deviation]
        assert sorted(own) == list(range(1, k + 1))
        for c in own:
            assert any(abs(abs(r["whitened"]) - abs(z[c - 1])) < 1e-7 * max(1, abs(z[c - 1])) for r in own[c])
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
    return got


def vectors(rng, n, d, shift=0.0):
    axes = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(3)]
    out = []
    for i in range(n):
        w = [rng.gauss(0, s) for s in (0.9, 0.5, 0.2)]
        out.append((i, [shift + sum(a * b[j] for a, b in zip(w, axes)) + rng.gauss(0, 0.05) for j in range(d)]))
    return out


def test_rows_copies_and_unusable_rows(spark):
    rows = vectors(random.Random(1), 120, 7)
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[5][1])]
    rows += [(900, None), (901, [None] * 7), (902, [float("nan")] * 7), (903, [float("inf")] + [0.0] * 6), (904, [1.0, 2.0]), (905, [])]
    usable = [r for r in rows if not (r[0] or 0) >= 904]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert {r["vec_id"] for r in whiten(frame).collect()} == {r[0] for r in usable if (r[0] or 0) < 900}
    check(spark, usable)


def test_large_means_lose_nothing(spark):
    check(spark, vectors(random.Random(2), 80, 5, shift=1e6), "double")


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(4)
    check(spark, [(i, [rng.uniform(-1, 1) * 2.0**47 for _ in range(4)]) for i in range(60)], "double")
    check(spark, [(i, [rng.uniform(-1, 1) * 2.0**35 for _ in range(4)]) for i in range(60)], "double")


@pytest.mark.parametrize("reach", [1 << 10, 1 << 40, 1 << 61])
def test_square_sums_are_exact(reach):
    rng = np.random.default_rng(6)
    w = rng.integers(-reach, reach, (300, 4))
    want = [sum(int(v) ** 2 for v in w[:, j]) for j in range(4)]
    assert list(whitening_polar.square_sums(w, reach)) == want == list(whitening_polar.square_sums(w.astype(object), reach))


def test_without_variance(spark):
    rows = [(1, [1.0, 2.0, 3.0])] * 3
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert len(got) == 9 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, None, None)}
    rows = [(i, [float(i), 1.0, 1.0, 1.0, 1.0]) for i in range(5)]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and len(got) == 20
    assert {round(r["explained"], 9) for r in got if r["component"] == 1} == {1.0}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whiten(frame).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id bigint, embedding array<float>")).count() == 0
