import numpy as np
import pytest

from titlelake.operators import metrics as mt


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(rng, n, d, spread):
    centres = rng.normal(size=(12, d))
    return centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("spread, block_bytes, pivots", [(0.05, 1024, 12), (0.05, 1 << 20, 1), (3.0, 800, 5), (0.0, 64, 40)])
def test_maximum_equals_all_pairs(spark, spread, block_bytes, pivots):
    rng = np.random.default_rng(7)
    corpus, preds = clusters(rng, 700, 6, spread), clusters(rng, 300, 6, spread)
    preds[:5] = corpus[:5] * 3.0
    preds[5:40] = preds[5]
    got = {r["vec_id"]: r["max_sim"] for r in mt.max_cosine_by_cells(frame(spark, preds), frame(spark, corpus), pivots=pivots, block_bytes=block_bytes).collect()}
    want = (unit(preds) @ unit(corpus).T).max(1)
    assert len(got) == 300 and np.allclose([got[i] for i in range(300)], want, atol=1e-12)


def test_equal_vectors_are_one(spark):
    same = spark.range(3000).selectExpr("id as vec_id", "array(1D, 2D, 3D) as embedding")
    got = mt.max_cosine_by_cells(same, same, block_bytes=64)
    assert got.count() == 3000 and got.where("abs(max_sim - 1) > 1e-9").count() == 0


def test_blocks_are_bounded_and_most_stay_shut(spark):
    from titlelake.operators import nearest

    rng = np.random.default_rng(8)
    corpus, preds = clusters(rng, 900, 8, 0.05), clusters(rng, 200, 8, 0.05)
    pool = mt.distinct_units(frame(spark, corpus), "embedding")[1]
    found = nearest.cells(pool, 24, 10 * 64)
    sizes = [len(r["matrix"]) // 64 for r in found.blocks.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 10
    row = mt.cells_opened(frame(spark, preds), frame(spark, corpus), pivots=24, block_bytes=10 * 64).first()
    assert 200 <= row["opened"] < 0.4 * row["possible"]


def test_nulls_zero_vectors_and_empty_sides(spark):
    schema = "vec_id long, embedding array<double>"
    preds = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (None, [4.0, 3.0]), (4, [])], schema)
    corpus = spark.createDataFrame([(1, [0.0, 2.0]), (2, None)], schema)
    got = {r["vec_id"]: r["max_sim"] for r in mt.max_cosine_by_cells(preds, corpus).collect()}
    assert set(got) == {1, 3, None} and got[1] == pytest.approx(0.8) and got[None] == pytest.approx(0.6) and np.isnan(got[3])
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], schema)
    assert all(np.isnan(r["max_sim"]) for r in mt.max_cosine_by_cells(preds, zero).collect())
    assert mt.max_cosine_by_cells(preds, corpus.limit(0)).count() == 0
    assert mt.max_cosine_by_cells(preds.limit(0), corpus).count() == 0


def test_vectors_are_sent_to_shelves_not_to_blocks(spark):
    """With blocks of one vector and nothing separated, all blocks meet all vectors; a vector is still sent to each shelf once a round."""
    from titlelake.operators import nearest as ns

    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(40, 24)), rng.normal(size=(600, 24))
    found = ns.cells(mt.distinct_units(frame(spark, y), "embedding")[1], 4, 1)
    assert len(found.number) == 600 > 2 * ns.SHELVES
    u = mt.distinct_units(frame(spark, x), "embedding")[1]
    sent = ns.further_meetings(u.selectExpr("uk", "u", "-1.0D as s").coalesce(1), found).selectExpr("length(uks) / 8 as vectors", "n").toPandas()
    assert sent["n"].sum() == 40 * 599
    assert sent["vectors"].sum() <= 40 * ns.SHELVES
    got = [r["max_sim"] for r in mt.max_cosine_by_cells(frame(spark, x), frame(spark, y), pivots=4, block_bytes=1).orderBy("vec_id").collect()]
    assert np.allclose(got, (unit(x) @ unit(y).T).max(1))


def test_batches_are_cut_by_what_they_become():
    """A batch of many vectors is taken in parts whose products keep within the bound."""
    import pyarrow as pa

    from titlelake.operators import nearest as ns

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["uk"])
    cut = list(ns._filled(iter([batch, batch.slice(0, 0)]), 4000))
    assert sum(b.num_rows for b in cut) == 10_000 and max(b.num_rows for b in cut) * 4000 <= ns.PRODUCT
