import duckdb
import pytest

from tests.llm.conftest import SF

import __spark_entry__ as entry
import corpus_pipeline
from titlelake.llm.queries import ORACLES, QUERIES


def table(sf, name):
    return f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(table(SF, "documents"))
    want = con.execute(ORACLES[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert got[cols].sort_values(cols).reset_index(drop=True).astype(str).equals(want[cols].sort_values(cols).reset_index(drop=True).astype(str))


#: One row for each vector or phrase: their own tests hold them.
OTHER_ROWS = {"op13_embedding_whitening"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - OTHER_ROWS))
def test_query_covers_the_table(spark, name):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = entry.queries()[name](spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == ids


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        before = {r["doc_id"] for r in docs.collect()}
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert {r["doc_id"] for r in docs.collect()} <= before
        if name in ("passage_dedup", "personal_data"):
            assert docs.count() == len(before)
    last = {r["doc_id"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == last
    # pieces of a document follow one another without a gap
    for d in last:
        own = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == d)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))


def test_stages_on_edge_rows(spark, edge_docs):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        if name == "packing":
            ids = {r["doc_id"] for r in rows}
        else:
            assert after.columns == edge_docs.columns, name
            docs = spark.createDataFrame(rows, after.schema)
    kept = {r["doc_id"] for r in docs.collect()}
    assert ids == kept and {None, 2, 3, 8, -3} <= kept  # nulls, empty and very long texts are kept
    assert not {5, 15} & kept  # copies of 1 and 13 are not


def test_stored_tables_can_be_cleared(spark):
    from titlelake.llm import common

    frame = common.stored(spark.range(3), "x")
    path = common._written[-1]
    assert frame.count() == 3
    common.clear_stored(spark)
    assert not common._written and not spark._jvm.java.io.File(path.removeprefix("file:")).exists()


def test_empty_tables(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
