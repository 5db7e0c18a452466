from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.plans.clean import tag_clean
from titlelake.plans.curate import curate
from titlelake.streaming.ingest import FETCH_LOG_SCHEMA, batch_equivalent, run_ingest
from tests.conftest import SF_SMALL


def test_stream_equals_batch_and_resumes(spark, scratch):
    log = fx.fetch_log(spark, SF_SMALL).select(*FETCH_LOG_SCHEMA.fieldNames())
    log.repartition(3, "video_id").write.parquet(f"{scratch}/in")
    run_ingest(spark, f"{scratch}/in", f"{scratch}/sink", f"{scratch}/ck", max_files_per_trigger=1)
    got = spark.read.parquet(f"{scratch}/sink")
    want = batch_equivalent(log)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    n = got.count()
    # New file with already-ingested ids: the second run adds nothing.
    log.limit(5).write.mode("append").parquet(f"{scratch}/in")
    run_ingest(spark, f"{scratch}/in", f"{scratch}/sink", f"{scratch}/ck")
    assert spark.read.parquet(f"{scratch}/sink").count() == n


def test_clean_audit_pair_partitions_input(spark):
    t = fx.trending(spark, SF_SMALL)
    tagged = tag_clean(t)
    assert tagged.count() == t.count()
    assert tagged.where("keep").count() + tagged.where("not keep").count() == t.count()
    assert tagged.where("keep and size(reasons) > 0").count() == 0


def test_dedupe_idempotent(spark):
    from titlelake.operators.windows import dedupe_titles
    t = fx.trending(spark, SF_SMALL)
    once = dedupe_titles(t, ("video_id", "trending_date"))
    twice = dedupe_titles(once, ("video_id", "trending_date"))
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_core_plans_stay_in_the_jvm(spark):
    from titlelake.plans import sft, transcripts
    from titlelake.plans.clean import clean
    t = fx.trending(spark, SF_SMALL)
    frames = [curate(t, materialize=False), clean(t)[0],
              transcripts.merge(fx.transcripts_in(spark, SF_SMALL), fx.videos(spark, SF_SMALL))[0],
              sft.split(sft.examples(fx.videos(spark, SF_SMALL).withColumn("row_index", F.col("doc_id"))))]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan


def test_review_hook_keeps_rows_on_scorer_error(spark):
    from titlelake.operators.review import review
    v = fx.videos(spark, SF_SMALL).select("video_id", "title", "channelTitle", "tags")

    def broken(prompts):
        raise RuntimeError("quota")
    out = review(v, broken, "criteria")
    assert out.where(F.col("keep") & F.col("reason").startswith("ERROR: ")).count() == v.count()


def test_merge_and_counters_match_sequential_scan(spark):
    """W5 + A14 against a plain sequential scan, with one id holding most rows."""
    import random
    from titlelake.plans.transcripts import merge, merge_counters
    rnd = random.Random(5)
    rows = []
    for pos in range(600):
        vid = "hot" if rnd.random() < 0.6 else f"v{rnd.randrange(40)}"
        text = rnd.choice(["", " ", "a", "ab", "abc", "abcd", "x" * rnd.randrange(1, 9)])
        rows.append((rnd.randrange(2), pos, vid, text))
    df = spark.createDataFrame(rows, "input_rank int, pos long, video_id string, full_transcript string")
    best, replaced = {}, 0
    for r, pos, vid, text in sorted(rows, key=lambda x: (x[0], x[1])):
        score = (1 if text.strip() else 0, len(text.strip()))
        if vid not in best:
            best[vid] = (score, r, pos)
        elif score > best[vid][0]:
            best[vid] = (score, r, pos)
            replaced += 1
    kept, _ = merge(df)
    got = {x["video_id"]: (x["input_rank"], x["pos"]) for x in kept.collect()}
    assert got == {k: (v[1], v[2]) for k, v in best.items()}
    again, _ = merge(df.repartition(7, "pos"))
    assert {x["video_id"]: (x["input_rank"], x["pos"]) for x in again.collect()} == got
    c = merge_counters(df).first()
    assert c["replaced"] == replaced and c["unique_ids"] == len(best)


def test_curate_from_csv_round_trip(spark, scratch):
    """S1 -> L3: the trending table written as CSV and read back with the
    explicit 16-column schema curates to the same rows as the parquet path."""
    from titlelake.plans.curate import curate
    from titlelake.schemas import TRENDING
    from titlelake.sources.readers import read_trending_csv
    from titlelake.sources.sinks import write_csv
    t = fx.trending(spark, SF_SMALL)
    full = t.select(*[(F.col(f.name) if f.name in t.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in TRENDING.fields])
    write_csv(full, f"{scratch}/trending_csv")
    back = read_trending_csv(spark, f"{scratch}/trending_csv", TRENDING)
    assert back.count() == full.count()
    key = ["video_id", "trending_date", "title", "view_count"]
    a = curate(full, materialize=False).select(*key)
    b = curate(back, materialize=False).select(*key)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_retryable_failure_never_hides_a_later_outcome(spark, scratch):
    rows = [(1, "a", "t", "d", "RuntimeError", "transcript_fetch_error:a:timeout", None), (2, "a", "t", "d", None, None, "text"), (3, "b", "t", "d", None, None, "b")]
    log = spark.createDataFrame(rows, FETCH_LOG_SCHEMA)
    for n in (1, 100):
        for i in range(3):
            log.where(F.col("pos") == i + 1).coalesce(1).write.mode("append").parquet(f"{scratch}/in{n}")
        run_ingest(spark, f"{scratch}/in{n}", f"{scratch}/sink{n}", f"{scratch}/ck{n}", max_files_per_trigger=n)
        assert sorted(r["video_id"] for r in spark.read.parquet(f"{scratch}/sink{n}").collect()) == ["a", "b"]
    assert batch_equivalent(log).count() == 2


def test_review_does_not_depend_on_the_batch(spark):
    from titlelake.operators.review import review
    v = spark.range(20).selectExpr("cast(id as string) as video_id", "concat('t', id) as title", "'c' as channelTitle", "'x' as tags")

    def scorer(prompts):
        if any('"t7"' in p for p in prompts):
            raise RuntimeError("bad prompt")
        return ["REMOVE"] * len(prompts)

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        out = review(v, scorer, "criteria").collect()
        assert [r["video_id"] for r in out if r["keep"]] == ["7"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_tag_virality_keeps_rows_with_repeated_or_null_keys(spark):
    from titlelake.operators.filters import tag_virality, virality_kept
    rows = [("c", "a", "2020", 1), ("c", "b", "2020", 2), ("c", "d", "2020", 2), ("c", "e", "2020", 2), ("c", "x", "2021", 50), ("c", "x", "2021", 50), ("c", "y", None, 40),
            (None, "z", "2020", 99)]
    df = spark.createDataFrame(rows, "channelTitle string, video_id string, trending_date string, view_count long")
    for k in (1, 2, 20):
        tagged = tag_virality(df, ("video_id", "trending_date"), max_per_channel=k)
        assert tagged.count() == len(rows)
        kept = tagged.where("keep_virality").select(*df.columns)
        want = virality_kept(df, ("video_id", "trending_date"), max_per_channel=k).select(*df.columns)
        assert kept.count() == min(k, 3) and kept.exceptAll(want).count() == 0


def test_plans_run_nothing_while_they_are_built(spark):
    """Building L3, L9, M8 and M10 starts no job."""
    from titlelake.operators import metrics as mt
    from titlelake.plans import sft
    rows = fx.videos(spark, SF_SMALL).withColumn("row_index", F.col("doc_id"))
    t, emb, lex = fx.trending(spark, SF_SMALL), fx.pred_emb(spark, SF_SMALL), fx.lexicon(spark)
    raw = fx.generations(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("build-only", "none")
    try:
        curate(t)
        data, _, _ = sft.prepare(rows)
        preds = sft.collect_predictions(raw, data)
        mt.self_bleu(mt.clean_pairs(preds))
        mt.evaluate(preds, lex, emb, emb)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_checkpoint_folder_is_never_local_on_a_cluster():
    from titlelake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    import pytest
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def _log(spark, rows):
    return spark.createDataFrame([(p, i, "t", "d", None, None, x) for p, i, x in rows], FETCH_LOG_SCHEMA).coalesce(1)


def _sink(spark, path):
    return sorted((r["video_id"], r["full_transcript"]) for r in spark.read.parquet(path).collect())


def test_ids_of_earlier_batches_are_state_not_a_read_of_the_sink(spark, scratch, monkeypatch):
    from titlelake.streaming import ingest

    reads = []
    own = ingest._sink_ids
    monkeypatch.setattr(ingest, "_sink_ids", lambda *a: reads.append(a) or own(*a))
    for i, rows in enumerate([[(5, "a", "late"), (1, "a", "first"), (2, " ", "blank")], [(0, "a", "again"), (3, "b ", "b")], [(9, "b", "again"), (4, "c", "c")]]):
        _log(spark, rows).write.mode("append").parquet(f"{scratch}/in")
        run_ingest(spark, f"{scratch}/in", f"{scratch}/sink", f"{scratch}/ck", max_files_per_trigger=1)
    assert _sink(spark, f"{scratch}/sink") == [("a", "first"), ("b", "b"), ("c", "c")]
    assert len(reads) == 1  # the first run asks whether the sink had rows before its checkpoint


def test_a_sink_older_than_the_checkpoint(spark, scratch):
    _log(spark, [(1, "a", "old")]).write.parquet(f"{scratch}/in1")
    run_ingest(spark, f"{scratch}/in1", f"{scratch}/sink", f"{scratch}/ck1")
    _log(spark, [(1, "b", "b")]).write.parquet(f"{scratch}/in2")
    run_ingest(spark, f"{scratch}/in2", f"{scratch}/sink", f"{scratch}/ck2")
    _log(spark, [(1, " a", "new"), (2, "c", "c")]).write.mode("append").parquet(f"{scratch}/in2")
    run_ingest(spark, f"{scratch}/in2", f"{scratch}/sink", f"{scratch}/ck2")
    assert _sink(spark, f"{scratch}/sink") == [("a", "old"), ("b", "b"), ("c", "c")]


def test_a_batch_that_was_written_and_not_committed(spark, scratch):
    import os

    _log(spark, [(1, "a", "a"), (2, "b", "b")]).write.parquet(f"{scratch}/in")
    run_ingest(spark, f"{scratch}/in", f"{scratch}/sink", f"{scratch}/ck")
    for name in os.listdir(f"{scratch}/ck/commits"):
        if name.strip(".").split(".")[0] == "0":
            os.remove(f"{scratch}/ck/commits/{name}")
    run_ingest(spark, f"{scratch}/in", f"{scratch}/sink", f"{scratch}/ck")
    assert _sink(spark, f"{scratch}/sink") == [("a", "a"), ("b", "b")]


def test_state_stays_in_the_jvm_and_first_rows_win(spark, scratch):
    """Ids in several rows of a micro-batch and in several micro-batches, rows without a position, folders with blanks in their names."""
    rows = [[(5, "a", "five"), (3, " a ", "three"), (None, "a", "none"), (None, "n", "only")], [(1, "a", "late"), (7, "c", "seven"), (9, "c", "nine"), (2, "n", "late")], [(0, "c", "late"), (4, "d", "four")]]
    for part in rows:
        log = spark.createDataFrame([(p, v, "t", "d", None, None, x) for p, v, x in part], FETCH_LOG_SCHEMA)
        log.coalesce(1).write.mode("append").parquet(f"{scratch}/in 1%20")
    q = run_ingest(spark, f"{scratch}/in 1%20", f"{scratch}/sink", f"{scratch}/ck", max_files_per_trigger=1)
    got = {r["video_id"]: r["full_transcript"] for r in spark.read.parquet(f"{scratch}/sink").collect()}
    assert got == {"a": "three", "n": "only", "c": "seven", "d": "four"}
    assert spark.read.parquet(f"{scratch}/sink").count() == 4
    assert {s["operatorName"] for s in q.lastProgress["stateOperators"]} == {"stateStoreSave"}
