import json

from pyspark.sql import types as T

from titlelake.sources import readers as rd
from titlelake.sources import sinks as sk


def test_csv_overflow_and_short_rows(spark, scratch):
    p = f"{scratch}/t.csv"
    with open(p, "w") as f:
        f.write('a,b,c\n1,"multi\nline ""q""",x\n2,too,many,fields\n3,short\n')
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])
    rows = sorted(tuple(r) for r in rd.read_trending_csv(spark, p, schema).collect())
    assert rows == [("1", 'multi\nline "q"', "x"), ("3", "short", None)]


def test_jsonl_tolerant(spark, scratch):
    p = f"{scratch}/t.jsonl"
    with open(p, "w") as f:
        f.write('{"video_id": "a", "title": "x"}\n\nnot json\n[1,2]\n{"video_id": null}\n{"video_id": "b"} junk\n')
    schema = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("title", T.StringType())])
    rows = [tuple(r) for r in rd.read_jsonl_tolerant(spark, p, schema).collect()]
    assert sorted(rows, key=str) == sorted([("a", "x"), (None, None)], key=str)


def test_id_lists(spark, scratch):
    p = f"{scratch}/ids.txt"
    with open(p, "w") as f:
        f.write(" b \n\na\nb\n")
    got = [r["id"] for r in rd.read_id_list(spark, p).orderBy("pos").collect()]
    assert got == ["b", "a", "b"]
    j = f"{scratch}/ids.json"
    with open(j, "w") as f:
        json.dump(["x", " ", "y", "x"], f)
    got = [(r["pos"], r["id"]) for r in rd.read_id_json_list(spark, j).orderBy("pos").collect()]
    assert got == [(0, "x"), (2, "y")]


def test_jsonl_round_trip_keeps_unicode(spark, scratch):
    df = spark.createDataFrame([("v1", "Ça marche ✓")], "video_id string, title string")
    sk.write_jsonl(df, f"{scratch}/out")
    back = spark.read.json(f"{scratch}/out").collect()
    assert back[0]["title"] == "Ça marche ✓"


def test_resolve_column(spark):
    df = spark.createDataFrame([(1,)], "ChannelTitle int")
    assert rd.resolve_column(df, "channel", "channeltitle") == "ChannelTitle"
    assert rd.resolve_column(df, "nope") is None
