from pyspark.sql import functions as F

from titlelake.plans import sft


def _examples(spark, sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(f"{s}-{i}", s, "x" * 300, "A fine title here", len(rows)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, source string, source_text string, title string, row_index long")


def expected_k(n, p):
    if n <= 1:
        return 1
    return max(1, min(round(n * p), n - 1))


def test_k_per_stratum_and_disjoint(spark):
    sizes = {"a": 1, "b": 2, "c": 5, "d": 25, "e": 35}
    ex = _examples(spark, sizes)
    s = sft.split(ex, sft.SplitConfig(test_size=0.1, seed=3, stratify_source=True))
    got = {r["source"]: r["k"] for r in s.groupBy("source").agg(F.sum(F.col("is_test").cast("int")).alias("k")).collect()}
    assert got == {k: expected_k(n, 0.1) for k, n in sizes.items()}
    tr = s.where(~F.col("is_test")).select("id")
    te = s.where(F.col("is_test")).select("id")
    assert tr.intersect(te).count() == 0
    assert tr.count() + te.count() == sum(sizes.values())


def test_split_independent_of_partitioning(spark):
    ex = _examples(spark, {"a": 40})
    a = {r["id"] for r in sft.split(ex).where("is_test").collect()}
    b = {r["id"] for r in sft.split(ex.repartition(7)).where("is_test").collect()}
    assert a == b
