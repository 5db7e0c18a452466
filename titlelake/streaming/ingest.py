"""ST1: resumable transcript ingest with Structured Streaming.

New fetch-outcome files landing in ``source_dir`` are processed once each
(file source + checkpoint). Every micro-batch keeps the first row per id
that is no retryable failure and whose id no earlier batch has written. Which ids
were written is keyed state in the state store (RocksDB: on disk, one
small entry for each id: the place of its first row), so a micro-batch costs what its own rows cost, however large the sink has
grown. The state sees ids and outcomes only; the texts of new ids are read from their files by place. ``trigger(availableNow=True)`` drains what is there and stops.

The sink is looked at in two cases only. A new checkpoint over a sink that already has
rows copies their ids once to a snapshot beside the checkpoint, which the stream is
filtered by. A micro-batch that a stopped job had begun and not committed
leaves out what it had already written. A checkpoint of the earlier form (state
kept by a Python function) can't be continued: begin a new one over the same sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlelake.functions.records import classify_fetch
from titlelake.functions.text import safe_strip
from titlelake.operators.joins import anti_by_id
from titlelake.operators.windows import keep_first
from titlelake.plans.transcripts import TRANSCRIPT_COLS, assemble
from titlelake.sources.readers import existing

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FETCH_LOG_SCHEMA = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("video_id", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("exc_type", T.StringType()), T.StructField("exc_msg", T.StringType()),
    T.StructField("raw_text", T.StringType()),
])


def _sink_ids(spark: SparkSession, sink_dir: str) -> DataFrame | None:
    """Ids in the sink; None only where nothing was written yet (any other failure to read it is an error)."""
    return spark.read.parquet(sink_dir).select("video_id") if existing(spark, f"{sink_dir.rstrip('/')}/part-*") else None


def _final(log: DataFrame) -> DataFrame:
    """Rows that are no retryable failure (such a failure never hides a later
    outcome, however files fall into micro-batches), with stripped ids that are not blank."""
    final = log.where(classify_fetch("exc_type", "exc_msg") != "retryable")
    return final.withColumn("video_id", safe_strip("video_id")).where("video_id <> ''")


def new_rows(log: DataFrame) -> DataFrame:
    """``video_id, first, now`` of the ids that a micro-batch of the stream ``log`` holds: the place of the id's first row
    (time of its micro-batch, order, file, row in the file), and the time of this micro-batch.  An id is new where both times are equal."""
    now = F.current_timestamp()  # one value for a whole micro-batch, kept in the checkpoint: a replay has the same
    at = F.struct(now.alias("batch"), F.col("pos").isNull().alias("last"), "pos", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return _final(log.select("video_id", "exc_type", "exc_msg", at.alias("at"))).groupBy("video_id").agg(
        F.min("at").alias("first"), F.max("at.batch").alias("now"))


def _rows_at(spark: SparkSession, source_dir: str, places: DataFrame) -> DataFrame:
    """The log's rows at the places (``file, row``); the files of one micro-batch are named by the driver, and no others are read."""
    files = [r["file"] for r in places.select("file").distinct().collect()]
    log = spark.read.schema(FETCH_LOG_SCHEMA).parquet(source_dir)
    log = log.where(F.col("_metadata.file_path").isin(files)) if files else log.where(F.lit(False))
    log = log.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return _final(log.join(places, ["file", "row"], "left_semi").drop("file", "row"))


def _entries(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder of the checkpoint; none if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()


def _snapshot(spark: SparkSession, sink_dir: str, checkpoint_dir: str) -> DataFrame | None:
    """Ids that the sink had before this checkpoint began, or None."""
    path = f"{checkpoint_dir.rstrip('/')}-ids-before"
    if not _entries(spark, f"{checkpoint_dir}/offsets"):
        had = _sink_ids(spark, sink_dir)
        if had is not None:
            had.distinct().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path) if existing(spark, f"{path}/_SUCCESS") else None


def run_ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
               max_files_per_trigger: int = 100):
    """Start the stream (file source -> keyed state -> appends) and wait until the
    files present now are processed."""
    before = _snapshot(spark, sink_dir, checkpoint_dir)
    numbers = lambda kind: {n for n in _entries(spark, f"{checkpoint_dir}/{kind}") if n.isdigit()}
    unfinished = numbers("offsets") - numbers("commits")
    stream = (spark.readStream.schema(FETCH_LOG_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    if before is not None:
        stream = anti_by_id(stream, before)

    def append(ids: DataFrame, batch: int) -> None:
        places = ids.where(F.col("first.batch") == F.col("now")).select("first.file", "first.row").persist()
        try:
            rows = _rows_at(spark, source_dir, places)
            if str(batch) in unfinished:
                written = _sink_ids(spark, sink_dir)
                rows = rows if written is None else anti_by_id(rows, written, stripped=True)
            assemble(rows).select(*TRANSCRIPT_COLS).write.mode("append").parquet(sink_dir)
        finally:
            places.unpersist()

    had = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = (new_rows(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir)
             .foreachBatch(append).trigger(availableNow=True).start())
    finally:
        spark.conf.unset(STATE_STORE) if had is None else spark.conf.set(STATE_STORE, had)
    q.awaitTermination()
    return q


def batch_equivalent(log: DataFrame) -> DataFrame:
    """What one batch run over all files would write (for replay checks)."""
    return assemble(keep_first(_final(log), "video_id", "pos")).select(*TRANSCRIPT_COLS)


__all__ = ["run_ingest", "new_rows", "batch_equivalent", "FETCH_LOG_SCHEMA"]
