"""Registered queries vs their DuckDB oracles at sf0.001 (a fast subset;
tools/check_oracles.py runs all of them at any scale)."""

import math

import duckdb
import pytest

from titlelake import fixtures as fx
from titlelake.catalog import ORACLES, QUERIES, load_all
from tests.conftest import SF_SMALL

load_all()
FAST = ["L3_curate", "L2_clean_kept", "A2_missing", "P_text_functions", "L6_merge_kept", "L9_prepare_sft",
        "M1_rouge2_pairs", "M8_self_bleu", "F10_engagement", "W2_dedupe_titles", "A14_merge_counters"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(repr(norm(x)) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in fx.BASE_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    got = rows(QUERIES[name](spark, SF_SMALL).toPandas())
    want = rows(con.execute(ORACLES[name]).df())
    assert got == want


def test_every_query_has_a_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 70
