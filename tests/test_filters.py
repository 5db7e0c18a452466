from pyspark.sql import functions as F

from titlelake.operators import filters as flt


def _titles(spark, titles):
    return spark.createDataFrame([(t,) for t in titles], "title string")


def test_text_heuristic_length_bounds(spark):
    titles = ["a" * 3 + "?", "a" * 4 + "?", "a" * 119 + "?", "a" * 120 + "?", None, "i tried it", "after dark?"]
    got = [r[0] for r in _titles(spark, titles).select(flt.text_heuristic_keep()).collect()]
    # lengths 4, 5, 120, 121; null -> length 0; hook phrase; literal "ft." does not hit "after"
    assert got == [False, True, True, False, False, True, True]
    regex = [r[0] for r in _titles(spark, ["after dark?"]).select(flt.text_heuristic_keep(mode="regex")).collect()]
    assert regex == [False]


def test_sft_quality_bounds(spark):
    rows = [("transcript", "x" * 200, "t" * 10), ("transcript", "x" * 199, "t" * 10),
            ("description", "x" * 40, "t" * 100), ("description", "x" * 40, "t" * 101),
            ("description", "x" * 39, "t" * 9), ("", "", "t" * 50)]
    df = spark.createDataFrame(rows, "source string, source_text string, title string")
    got = [r[0] for r in df.select(flt.sft_quality_keep("source", "source_text", "title")).collect()]
    assert got == [True, False, True, False, False, False]


def test_category_rules(spark):
    df = spark.createDataFrame([(25,), (10,), (22,), (None,)], "categoryId int")
    assert [r[0] for r in df.select(flt.denied_category("categoryId")).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(flt.allowed_category(df)).collect()] == [False, False, True, False]
    no_col = spark.createDataFrame([(1,)], "x int")
    assert no_col.select(flt.allowed_category(no_col)).first()[0] is True


def test_engagement_passes_all_without_eligible_rows(spark):
    df = spark.createDataFrame([("a", 10, 1, 0), ("b", 20, 5, 1)], "video_id string, view_count long, likes long, comment_count long")
    out = flt.tag_engagement(df, min_views=10_000)
    assert out.where(F.col("keep_engagement")).count() == 2


def test_high_volume_is_strict(spark):
    rows = [("big", i) for i in range(5)] + [("edge", i) for i in range(4)] + [(None, 0)]
    df = spark.createDataFrame(rows, "channelTitle string, i int")
    got = {r[0]: r[1] for r in flt.tag_high_volume(df, max_videos=4).groupBy("channelTitle").agg(F.max("high_volume")).collect()}
    assert got == {"big": True, "edge": False, None: False}


def test_a_whole_text_is_stripped_once_to_be_judged(spark):
    import re

    from titlelake.functions.records import select_source
    from titlelake.functions.text import WHITESPACE, not_blank, safe_strip
    from titlelake.operators.filters import sft_quality_keep
    from titlelake.plans import sft

    texts = [" " + "x" * 200 + "　", "x" * 199 + "  ", "y" * 50_001, "\n" + "y" * 50_000 + "\x85", WHITESPACE, "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    keep = sft_quality_keep(F.lit("transcript"), safe_strip("t"), F.lit("a title of ten"))
    assert [r[0] for r in rows.select(keep).collect()] == [True, False, False, True, False, False, False]
    assert [r[0] for r in rows.select(not_blank("t")).collect()] == [True] * 4 + [False] * 3
    src = select_source(F.col("t"), F.lit(None), F.lit(" d "))
    assert [tuple(r[0]) for r in rows.select(src).collect()][3:] == [("transcript", "y" * 50_000)] + [("description", "d")] * 3

    v = spark.createDataFrame([("v", "title", "text", "more", 0)], "video_id string, title string, full_transcript string, description string, row_index long")
    plan = sft._usable(v, "row_index").select("id")._jdf.queryExecution().optimizedPlan().toString()
    # once where a row is a transcript, and once where it is a description
    assert len(re.findall(r"(?<!l)trim\(CASE WHEN", plan)) <= 2, plan
