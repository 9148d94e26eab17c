"""Merges that rewrite touched buckets only."""

import glob
import os

import pytest

from seriesloom.sources import bucket_table as bt

SCHEMA = "k STRING, ts INT, v DOUBLE, tie BIGINT"


def table(path, **more):
    return bt.BucketTable(str(path / "t"), SCHEMA, ("k", "ts"), ("tie",), ("k",), buckets=16, **more)


def rows(spark, t):
    return {(r["k"], r["ts"]): r["v"] for r in bt.current(spark, t).collect()}


def files(t):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{t.path}/data/*/*/part-*")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = table(tmp_path)
    every = [(f"k{i}", d, float(i), 0) for i in range(40) for d in (1, 2)]
    assert len(bt.merge(t, spark.createDataFrame(every, SCHEMA), "s", 0)) > 8
    before = files(t)
    touched = bt.merge(t, spark.createDataFrame([("k1", 1, 99.0, 0), ("k1", 3, 7.0, 0)], SCHEMA), "s", 1)
    assert len(touched) == 1
    after = files(t)
    kept = {f for f in before if f"bucket={touched[0]}/" not in f}
    assert kept and {f: after[f] for f in kept} == {f: before[f] for f in kept}
    got = rows(spark, t)
    assert got.pop(("k1", 1)) == 99.0 and got.pop(("k1", 3)) == 7.0
    assert got == {(k, d): v for k, d, v, _ in every if (k, d) != ("k1", 1)}


def test_a_retried_batch_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(tmp_path)
    bt.merge(t, spark.createDataFrame([("a", 1, 1.0, 0)], SCHEMA), "s", 0)
    second = spark.createDataFrame([("a", 1, 2.0, 0), ("b", 1, 3.0, 0)], SCHEMA)
    # Lost after the data and before the manifest: readers still see the first version.
    with monkeypatch.context() as m:
        def lost(*args):
            raise OSError("lost")

        m.setattr(bt, "_publish", lost)
        with pytest.raises(OSError):
            bt.merge(t, second, "s", 1)
    assert os.path.isdir(f"{t.path}/data/v=2")
    assert rows(spark, t) == {("a", 1): 1.0}
    assert bt.merge(t, second, "s", 1)
    want = {("a", 1): 2.0, ("b", 1): 3.0}
    assert rows(spark, t) == want
    assert bt.merge(t, spark.createDataFrame([("a", 1, -1.0, 9)], SCHEMA), "s", 1) == []
    assert rows(spark, t) == want
    # Another source counts its own batches.
    assert bt.merge(t, spark.createDataFrame([("c", 1, 4.0, 0)], SCHEMA), "other", 0)
    assert rows(spark, t) == {**want, ("c", 1): 4.0}


def test_order_decides_when_no_batch_wins(spark, tmp_path):
    t = table(tmp_path, newer_batch_wins=False)
    bt.merge(t, spark.createDataFrame([("a", 1, 1.0, 5), ("a", 1, 2.0, 4)], SCHEMA))
    bt.merge(t, spark.createDataFrame([("a", 1, 3.0, 3)], SCHEMA))
    assert rows(spark, t) == {("a", 1): 1.0}
    bt.merge(t, spark.createDataFrame([("a", 1, 3.0, 5)], SCHEMA))
    assert rows(spark, t) == {("a", 1): 3.0}


def test_empty_batches_and_null_keys(spark, tmp_path):
    t = table(tmp_path)
    none = spark.createDataFrame([], SCHEMA)
    assert bt.current(spark, t).count() == 0 and bt.merge(t, none) == [] and bt.merge(t, none, "s", 0) == []
    assert bt.current(spark, t).count() == 0
    bt.merge(t, spark.createDataFrame([(None, 1, 1.0, 0), ("a", None, None, None)], SCHEMA), "s", 1)
    bt.merge(t, spark.createDataFrame([(None, 1, 2.0, 0)], SCHEMA), "s", 2)
    assert rows(spark, t) == {(None, 1): 2.0, ("a", None): None}


def test_old_versions_go(spark, tmp_path):
    t = table(tmp_path)
    for i in range(5):
        bt.merge(t, spark.createDataFrame([("a", 1, float(i), 0)], SCHEMA), "s", i)
    assert rows(spark, t) == {("a", 1): 4.0}
    assert len(glob.glob(f"{t.path}/data/v=*")) == len(glob.glob(f"{t.path}/manifest/v=*")) == bt.KEPT_VERSIONS
