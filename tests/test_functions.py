import hashlib

from pyspark.sql import functions as F

from titlelake.functions import records as rc
from titlelake.functions import text as tx


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


def test_safe_strip_unicode(spark):
    for raw in ["  hi  ", "\x1c\tok\x85", None, "  "]:
        assert one(spark, tx.safe_strip("x"), raw) == ("" if raw is None else raw.strip())


def test_normalize_and_len(spark):
    assert one(spark, tx.normalize_title("x"), "  Hello,   WORLD!! 2024 ") == "hello world 2024"
    assert one(spark, tx.normalize_title("x"), "日本語") == ""
    assert one(spark, tx.title_len("x"), None) == 0


def test_english_like(spark):
    assert one(spark, tx.is_english_like("x"), "") is False
    assert one(spark, tx.is_english_like("x"), "ça va très bien and") is True
    assert one(spark, tx.is_english_like("x"), "日本語のタイトル") is False


def test_clean_prediction(spark):
    cases = {'  "Big Title"\nsecond': "Big Title", "'quoted'": "quoted", "": "", "\"'x'\"": "x"}
    for raw, want in cases.items():
        assert one(spark, tx.clean_prediction("x"), raw) == want


def test_regex_mode_matches_everything(spark):
    assert one(spark, tx.contains_any("x", ["live |"], mode="regex"), "calm title") is True
    assert one(spark, tx.contains_any("x", ["ft."], mode="regex"), "after dark") is True
    assert one(spark, tx.contains_any("x", ["ft."]), "after dark") is False


def test_parse_verdict_remove_wins(spark):
    df = spark.createDataFrame([("KEEP - do not remove", None), ("maybe", None), (None, "boom")],
                               "r string, e string")
    got = [tuple(r) for r in df.select(rc.parse_verdict("r", "e").alias("v")).select("v.*").collect()]
    assert got == [(False, "KEEP - do not remove"), (True, "UNCLEAR: maybe"), (True, "ERROR: boom")]


def test_shard_and_hash_match_python(spark):
    ids = ["abc", "v1", "ünï"]
    df = spark.createDataFrame([(i,) for i in ids], "x string")
    got = df.select(rc.shard_of("x", 7).alias("s"), rc.hash_key(3, F.col("x")).alias("h")).collect()
    for i, r in zip(ids, got):
        assert r["s"] == int(hashlib.md5(i.encode()).hexdigest()[:8], 16) % 7
        assert r["h"] == hashlib.sha1(f"3:{i}".encode()).hexdigest()


def test_retryable_id(spark):
    assert one(spark, rc.retryable_id("x"), "transcript_fetch_error:abc:timeout:3") == "abc"
    assert one(spark, rc.retryable_id("x"), "transcript_fetch_error:abc") is None


def test_view_int_edges(spark):
    from titlelake.functions.numeric import to_view_int
    df = spark.createDataFrame([("12.9",), ("-3.7",), ("1e30",), ("inf",), ("nan",), ("abc",), (None,)], "x string")
    assert [r[0] for r in df.select(to_view_int("x")).collect()] == [12, -3, 0, 0, 0, 0, 0]
