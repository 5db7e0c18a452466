import json

import pytest
from pyspark.sql import types as T

from titlelake.plans.evaluate import compare_runs
from titlelake.sources import readers as rd
from titlelake.sources import sinks as sk

SCHEMA = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("title", T.StringType())])


def test_latin1_transcode_and_string_csv(spark, scratch):
    src = f"{scratch}/latin.csv"
    with open(src, "wb") as f:
        f.write("video_id,title\nv1,Caf\xe9 na\xefve\n".encode("latin-1"))
    rd.transcode_csv(spark, src, f"{scratch}/utf8")
    df = rd.read_csv_strings(spark, f"{scratch}/utf8")
    assert [tuple(r) for r in df.collect()] == [("v1", "Café naïve")]
    with pytest.raises(ValueError):
        rd.read_csv_strings(spark, f"{scratch}/utf8", required=("video_id", "description"))


def test_strict_jsonl_and_json_array(spark, scratch):
    good = f"{scratch}/good.jsonl"
    with open(good, "w") as f:
        f.write('{"video_id": "a", "title": "x"}\n\n{"video_id": "b", "title": "y"}\n')
    assert rd.read_jsonl_strict(spark, good, SCHEMA).count() == 2
    bad = f"{scratch}/bad.jsonl"
    with open(bad, "w") as f:
        f.write('{"video_id": "a"}\nnot json\n')
    with pytest.raises(Exception):
        rd.read_jsonl_strict(spark, bad, SCHEMA).collect()
    arr = f"{scratch}/arr.json"
    with open(arr, "w") as f:
        json.dump([{"video_id": "a", "title": "x"}, {"video_id": "b", "title": None}], f)
    assert rd.read_json_array(spark, arr, SCHEMA).count() == 2
    assert rd.read_records(spark, arr, SCHEMA).count() == 2
    with pytest.raises(ValueError):
        rd.read_records(spark, f"{scratch}/x.parquet")


def test_id_list_write_keeps_order(spark, scratch):
    ids = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (4, "a")], "pos long, id string")
    sk.write_id_list(ids, f"{scratch}/ids")
    back = [r["id"] for r in rd.read_id_list(spark, f"{scratch}/ids").orderBy("pos").collect()]
    assert back == ["a", "b", "c", "a"]


def test_append_and_replace(spark, scratch):
    a = spark.createDataFrame([("v1", "t")], SCHEMA)
    sk.append_jsonl(a, f"{scratch}/j")
    sk.append_jsonl(a, f"{scratch}/j")
    assert spark.read.json(f"{scratch}/j").count() == 2
    sk.replace_dataset(spark, a, f"{scratch}/p")
    cur = spark.read.parquet(f"{scratch}/p")
    sk.replace_dataset(spark, cur.union(cur), f"{scratch}/p")
    assert spark.read.parquet(f"{scratch}/p").count() == 2


def test_metrics_json_and_compare(spark, scratch):
    row = spark.createDataFrame([(0.5, float("nan"))], "rougeL_f1_mean double, diversity_ttr double")
    for run in ("runB", "runA"):
        sk.write_metrics_json(row, f"{scratch}/{run}")
    runs = rd.read_run_metrics(spark, f"{scratch}/*/part-*")
    got = compare_runs(runs).collect()
    assert [r["run"] for r in got] == ["runA", "runB"]
    assert got[0]["rougeL_f1_mean"] == "0.5000" and got[0]["diversity_ttr"] == "nan"
    assert got[0]["perplexity_base_ref_mean"] == "nan"


def test_head_zero_keeps_all(spark):
    from titlelake.operators.sets import head
    df = spark.createDataFrame([(i,) for i in range(10)], "k int")
    assert head(df, 0, "k").count() == 10
    assert [r["k"] for r in head(df, 3, "k").collect()] == [0, 1, 2]


def test_min_rows_guard(spark):
    from titlelake.operators.filters import guard_min_rows
    for n in (5, 0):
        with pytest.raises(Exception, match="at least 20 examples are needed"):
            guard_min_rows(spark.range(n), 20).collect()
    assert guard_min_rows(spark.range(50), 20).count() == 50


def test_csv_binds_by_name(spark, scratch):
    p = f"{scratch}/n.csv"
    with open(p, "w") as f:
        f.write('title,extra,video_id\n"a ""b"", c",1,v1\nt2,2,v2,overflow\nt3\n')
    got = {tuple(r) for r in rd.read_trending_csv(spark, p, SCHEMA).select("video_id", "title").collect()}
    assert got == {(None, "t3"), ("v1", 'a "b", c')}


def test_jsonl_two_objects_on_a_line_are_rejected(spark, scratch):
    from titlelake.schemas import TRANSCRIPT
    p = f"{scratch}/two.jsonl"
    with open(p, "w") as f:
        f.write('{"video_id":"a"} {"video_id":"b"}\n{"video_id":"c"}, {"video_id":"d"}\n{"video_id":"e", "title": "x}{"}\n{"video_id":"f"} junk}\n')
    assert [r["video_id"] for r in rd.read_jsonl_tolerant(spark, p, TRANSCRIPT).collect()] == ["e"]


def test_json_array_needs_an_array(spark, scratch):
    from titlelake.schemas import SFT_RECORD
    for name, text, ok in (("a", ' [{"id":"1"}, {"id":"2"}]', 2), ("b", '{"id":"1"}', None), ("c", '[{"id":"1"}', None)):
        with open(f"{scratch}/{name}.json", "w") as f:
            f.write(text)
        df = rd.read_json_array(spark, f"{scratch}/{name}.json", SFT_RECORD)
        if ok:
            assert df.count() == ok
        else:
            with pytest.raises(Exception):
                df.collect()


def test_run_metrics_skips_absent_globs(spark, scratch):
    import os
    os.makedirs(f"{scratch}/r1")
    with open(f"{scratch}/r1/m.json", "w") as f:
        f.write('{"a": 1.5, "b": NaN}')
    got = rd.read_run_metrics(spark, [f"{scratch}/none/*.json", f"{scratch}/*/m.json"]).collect()
    assert [(r["run"], r["a"]) for r in got] == [("r1", 1.5)] and got[0]["b"] != got[0]["b"]
    assert rd.read_run_metrics(spark, f"{scratch}/none.json").count() == 0


def test_metrics_json_writes_bare_nan(spark):
    import json
    from titlelake.sources.sinks import metrics_json
    text = metrics_json(spark.range(1).selectExpr("double('NaN') as a", "double('-Infinity') as b", "1.5D as c", "'NaN ' as d")).first()[0]
    assert '"a":NaN' in text and json.loads(text)["b"] == float("-inf") and json.loads(text)["d"] == "NaN "


def test_replace_dataset_swaps_and_leaves_nothing(spark, scratch):
    import os
    from titlelake.sources.sinks import replace_dataset
    path = f"{scratch}/t"
    replace_dataset(spark, spark.range(5), path)
    replace_dataset(spark, spark.read.parquet(path).selectExpr("id + 10 as id"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(10, 15))
    with pytest.raises(Exception):
        replace_dataset(spark, spark.read.parquet(path).selectExpr("raise_error('x') as id"), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(scratch) == ["t"]


def test_csv_encoding_auto_falls_back_to_latin1(spark, scratch):
    p = f"{scratch}/enc.csv"
    with open(p, "wb") as f:
        f.write("video_id,title\nv1,Caf\xe9\n".encode("latin-1"))
    got = rd.read_trending_csv(spark, p, SCHEMA, encoding="auto").collect()
    assert [tuple(r) for r in got] == [("v1", "Café")]


def test_audit_pair_written_by_flag(spark, scratch):
    from titlelake import fixtures as fx
    from titlelake.plans.clean import tag_clean
    from tests.conftest import SF_SMALL
    tagged = tag_clean(fx.trending(spark, SF_SMALL)).select("video_id", "title", "keep", "reasons")
    sk.write_audit_pair(tagged, f"{scratch}/audit")
    back = spark.read.option("header", True).csv(f"{scratch}/audit")
    assert back.count() == tagged.count()
    assert back.where("keep = false and reasons = ''").count() == 0


def test_read_predictions_strips_and_fills(spark, scratch):
    p = f"{scratch}/pred.jsonl"
    with open(p, "w") as f:
        f.write('{"id": " a ", "source": "transcript", "reference": " Ref ", "prediction": null}\n')
    got = rd.read_predictions(spark, p).collect()
    assert [tuple(r) for r in got] == [("a", "transcript", "Ref", "")]


def test_csv_to_parquet_prunes_columns(spark, scratch):
    p = f"{scratch}/in.csv"
    with open(p, "w") as f:
        f.write('video_id,title\nv1,"a\nb"\nv2,c\n')
    df = rd.csv_to_parquet(spark, p, f"{scratch}/pq", SCHEMA)
    assert sorted(tuple(r) for r in df.collect()) == [("v1", "a\nb"), ("v2", "c")]
    plan = df.where("video_id = 'v2'").select("title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(video_id), EqualTo(video_id,v2)]" in plan


@pytest.mark.parametrize("name", ["q_s6", "q_s9"])
def test_large_channels_are_several_documents(spark, scratch, monkeypatch, name):
    """No document gathers a channel: rows of a document stay near the limit, and all are read back."""
    import glob
    import re

    from titlelake.queries import q_io

    rows = spark.range(1200).selectExpr("concat('v', id) as video_id", "if(id < 1000, 'hot', concat('c', id % 20)) as channelId", "concat('t', id) as title", "'x' as tags")
    monkeypatch.setattr(q_io, "DOCUMENT_ROWS", 100)
    monkeypatch.setattr(q_io.fx, "videos", lambda spark, sf: rows)
    monkeypatch.setattr(q_io, "_scratch", lambda spark, name: f"{scratch}/{name}")
    got = [r[0] for r in getattr(q_io, name)(spark, "").collect()]
    assert sorted(got) == sorted(f"v{i}" for i in range(1200))
    files = [open(f).read() for f in glob.glob(f"{scratch}/*/channelId=hot/part-*")]
    assert 5 <= len(files) <= 10
    assert max(len(re.findall(r'"v[0-9]', x)) for x in files) <= 160
