"""Spark session helpers.

Library code never creates a session of its own; it takes the caller's.
These helpers exist for tests, the bench and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every titlelake job relies on: UTC wall clock (the trending
# timestamps are UTC), AQE for runtime re-planning (partition coalescing,
# skew-join splitting, broadcast conversion from measured sizes).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Skip per-call Python stack capture for error context (several JVM
    # round trips per Column call while building plans).
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Remove checkpoint files once the checkpointed data is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches to Python are cut by bytes as well as rows, so a batch of
    # block-matrix rows (max cosine) stays within a bounded size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


# Suggested additions for a large cluster (about 100 TB of input): many
# initial shuffle partitions that AQE coalesces toward the advisory size,
# scan splits and skew thresholds sized so one task handles a few hundred MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "titlelake") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TITLELAKE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is used as is. Only when it is unset and the master is local
    (tests) is a scratch folder created; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="titlelake-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and continue from
    that copy (reliable checkpoint: survives executor loss, no recompute of
    the upstream plan by later consumers)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_and_shuffles(df):
    """``cut_lineage``, after which what was shuffled for ``df`` is deleted at once (Spark 4.1 and later; before, when the driver collects its
    garbage). Should a stage of it be needed again, Spark runs it again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut_lineage(df.select("*"))  # the setting holds for tables that are made under it
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
