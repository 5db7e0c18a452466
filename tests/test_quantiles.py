import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from titlelake.operators.quantiles import quantiles
from titlelake.operators.windows import rank_within_channel


def test_exact_with_hot_group(spark):
    rng = np.random.default_rng(7)
    n = 20000
    g = rng.choice(["hot", "b", "c"], size=n, p=[0.7, 0.29, 0.01])
    v = np.where(rng.random(n) < 0.3, 5.0, rng.integers(0, 500, n).astype(float))
    pdf = pd.DataFrame({"g": g, "v": v})
    got = quantiles(spark.createDataFrame(pdf), ["g"], {"q1": ("v", 0.1), "q5": ("v", 0.5), "q9": ("v", 0.93)}).toPandas()
    got = got.set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.93]).unstack().sort_index()
    assert np.allclose(got[["q1", "q5", "q9"]].values, want.values)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_global_matches_pandas(spark, values, p):
    df = spark.createDataFrame([(float(x),) for x in values], "v double")
    got = quantiles(df, [], {"q": ("v", p)}).first()["q"]
    assert np.isclose(got, pd.Series(values).quantile(p), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("settings_", [{}, {"spark.sql.exchange.reuse": "false"}, {"spark.sql.adaptive.enabled": "false"}])
def test_exact_whatever_the_plan(spark, settings_):
    """Sorted, tie-heavy, skewed, narrow and very wide values, a group with 60 %
    of the rows, 64 partitions, with and without exchange reuse and adaptive execution."""
    rng = np.random.default_rng(11)
    n = 20000
    cases = {
        "sorted": np.sort(rng.normal(size=n)),
        "ties": rng.integers(0, 7, n).astype(float),
        "skewed": np.concatenate([np.zeros(n // 2), rng.exponential(size=n - n // 2)]),
        "narrow": 100 + rng.random(n) * 1e-9,
        "wide": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n),
    }
    old = {k: spark.conf.get(k, None) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        for name, v in cases.items():
            pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.6, "hot", rng.choice(["b", "c"], n)), "v": v})
            df = spark.createDataFrame(pdf).repartition(64)
            got = quantiles(df, ["g"], {"q": ("v", 0.37), "m": ("v", 0.5)}).toPandas().set_index("g").sort_index()
            want = pdf.groupby("g")["v"].quantile([0.37, 0.5]).unstack().sort_index()
            assert np.allclose(got[["q", "m"]].values, want.values, rtol=1e-12), name
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_null_keys_nan_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", None), ("b", 2.0)], "g string, v double")
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], {"q": ("v", 0.5)}).collect()}
    assert got == {None: 2.0, "b": 2.0}
    assert quantiles(df.where("false"), [], {"q": ("v", 0.5)}).count() == 0


def test_rows_are_never_dealt_by_the_group_alone(spark):
    """What is dealt by the group alone are counts (of buckets, steps, results)
    and the distinct values of one step; the exchange of rows is on (group, value)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(100000).selectExpr("id % 3 as g", "cast(id as double) as v")
        plan = quantiles(df, ["g"], {"q": ("v", 0.5)})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for line, below in zip(plan.split("\n"), plan.split("\n")[1:]):
        if "Exchange hashpartitioning" in line and "__v" not in line.split("hashpartitioning")[1]:
            assert not re.search("Generate|Range|Scan", below), (line, below)


@pytest.mark.parametrize("tied", [False, True])
def test_rank_matches_pandas(spark, tied):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"ch": rng.choice(["hot", "x", None], n, p=[0.8, 0.15, 0.05]), "s": rng.integers(0, 5 if tied else 10**6, n).astype(float),
                        "id": [f"v{i:05d}" for i in rng.permutation(n)]})
    pdf.loc[rng.random(n) < 0.05, "s"] = None
    df = spark.createDataFrame(pdf.astype({"ch": object}).where(pdf.notna(), None), "ch string, s double, id string")
    got = {r["id"]: r["rank_within_channel"] for r in rank_within_channel(df, "ch", "s", ("id",)).collect()}
    order = pdf.assign(ch=pdf["ch"].fillna("")).sort_values(["s", "id"], ascending=[False, True], na_position="last")
    want = dict(zip(order["id"], order.groupby("ch").cumcount() + 1))
    assert got == want


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name, scans", [("A8_channel_median", 1), ("A9_engagement_thresholds", 1), ("A3_describe", 2), ("F9_virality", 2), ("L1_profile", 3)])
def test_the_source_is_read_and_dealt_once(spark, name, scans):
    """Quantiles take one scan and one exchange of rows; F9 reads the rows besides, A3 and L1 their plain aggregates."""
    from tests.conftest import SF_SMALL
    from titlelake.catalog import QUERIES, load_all

    load_all()
    old = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 28))
    try:
        plan = _final(QUERIES[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", old)
    assert plan.count("FileScan parquet") == scans
    assert "ReusedExchange" in plan


def test_shared_values_and_counts(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, None), ("a", 4.0, 9.0), ("b", 7.0, None)], "g string, v double, w double")
    got = {r["g"]: r for r in quantiles(df, ["g"], {"lo": ("v", 0.0), "mid": ("w", 0.5), "hi": ("v", 1.0)}, count="n").collect()}
    assert tuple(got["a"]) == ("a", 1.0, 7.0, 4.0, 3) and tuple(got["b"]) == ("b", 7.0, None, 7.0, 1)
