import os

import pytest

from titlelake.sources import published as pb


def ids(spark, path):
    return sorted(r["id"] for r in pb.read_published(spark, path).collect())


def test_versions_replace_one_another(spark, scratch):
    path = f"{scratch}/t"
    with pytest.raises(FileNotFoundError):
        pb.read_published(spark, path)
    assert pb.publish(spark.range(3), path) == 1
    held = pb.read_published(spark, path)
    assert pb.publish(held.selectExpr("id + 10 as id"), path) == 2  # reads the version before
    assert ids(spark, path) == [10, 11, 12] and sorted(r["id"] for r in held.collect()) == [0, 1, 2]
    assert pb.publish(pb.read_published(spark, path).filter("id = 10"), path, fmt="json") == 3
    assert ids(spark, path) == [10]
    left = os.listdir(path)
    assert sum(x.startswith("data-") for x in left) == 2 == sum(x.startswith("manifest-") for x in left)


@pytest.mark.parametrize("step", ["data", "manifest", "clear"])
def test_a_job_that_dies_leaves_a_whole_version(spark, scratch, monkeypatch, step):
    path = f"{scratch}/t"
    pb.publish(spark.range(2), path, keep=1)
    if step == "data":  # while data is written
        with pytest.raises(Exception):
            pb.publish(spark.range(5).selectExpr("raise_error('dies') as id"), path)
    if step == "manifest":  # data is complete, its manifest is not
        os.makedirs(f"{path}/data-half")
        with open(f"{path}/manifest-000000000002", "w") as f:
            f.write('{"data": "data-ha')
    if step == "clear":  # the new version is published, the old one not yet deleted
        monkeypatch.setattr(pb, "_clear", lambda *a: (_ for _ in ()).throw(OSError("dies")))
        with pytest.raises(OSError):
            pb.publish(spark.range(7), path)
    assert ids(spark, path) == (list(range(7)) if step == "clear" else [0, 1])
    monkeypatch.undo()
    pb.publish(spark.range(1), path, keep=1)
    assert ids(spark, path) == [0]


def test_two_writers_of_one_number(spark, scratch, monkeypatch):
    path = f"{scratch}/t"
    pb.publish(spark.range(2), path)
    fs, folder = pb._fs(spark, path)
    first = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-000000000001")
    with pytest.raises(Exception):
        fs.create(first, False)
    assert ids(spark, path) == [0, 1]
