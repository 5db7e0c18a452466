"""Datasets replaced without renames (K7): a manifest names the version that readers see.

    <path>/data-<version>/...     one folder for each version, written by Spark
    <path>/manifest-<number>      one short file for each publication, never changed

A new version is written to a folder of its own and becomes visible by one
put of a new manifest, after it is complete.  Readers follow the highest-numbered
complete manifest, so whenever a job dies they see the old version or the new one,
whole; this needs neither renames nor listings of data folders, which object
stores don't do at once.  Two writers that pick the same number: the put of the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST, DATA = "manifest-", "data-"


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """Complete manifests, oldest first; one that a writer began and did not end is no JSON and does not count."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.startswith(MANIFEST):
            continue
        stream = fs.open(status.getPath())
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            out.append({"number": int(name.removeprefix(MANIFEST)), **json.loads(text)})
        except ValueError:
            continue
    return sorted(out, key=lambda m: m["number"])


def publish(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 2) -> int:
    """Write ``df``, which may read ``path``, as its new version; returns the publication's number.

    The ``keep`` newest versions stay, so that a reader of the one before can end."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    spark, path = df.sparkSession, path.rstrip("/")
    version = DATA + uuid.uuid4().hex
    df.write.format(fmt).save(f"{path}/{version}")
    fs, folder = _fs(spark, path)
    taken = [int(s.getPath().getName().removeprefix(MANIFEST)) for s in fs.listStatus(folder) if s.getPath().getName().startswith(MANIFEST)]
    number = max(taken, default=0) + 1
    put = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}{number:012d}"), False)
    try:
        put.write(bytearray(json.dumps({"data": version, "format": fmt}).encode()))
    finally:
        put.close()
    _clear(spark, path, keep)
    return number


def _clear(spark: SparkSession, path: str, keep: int) -> None:
    """Delete the manifests, and then the versions, before the ``keep`` newest."""
    fs, _ = _fs(spark, path)
    for old in _manifests(spark, path)[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}{old['number']:012d}"), False)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old['data']}"), True)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version."""
    found = _manifests(spark, path.rstrip("/"))
    if not found:
        raise FileNotFoundError(f"{path} has no published version")
    return spark.read.format(found[-1]["format"]).load(f"{path.rstrip('/')}/{found[-1]['data']}")
