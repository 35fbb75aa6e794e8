"""A07 / K04 on a bucketed table: bytes follow the batch, replays and restarts change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog as C
from shelfspark.operators.buckets import BucketedTable, BucketedUpsert

SCHEMA = "url string, name string, source_site string, ts long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def versions(base):
    return {int(d.split("=")[1]): sorted(int(x.split("=")[1]) for x in os.listdir(f"{base}/data/{d}") if "=" in x) for d in os.listdir(f"{base}/data")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    old = spark.range(5000).selectExpr("concat('u', id) as url", "concat('n', id) as name", "'s' as source_site", "id as ts")
    t = BucketedTable.create(old, str(tmp_path / "t"), buckets=64)
    new = spark.createDataFrame([("u7", "x", "z", 1), ("u8", "y", "z", 2), ("fresh", "f", "z", 3), ("u7", "later", None, 9)], SCHEMA)
    touched = t.upsert(new, seq="ts", preserve=["source_site"])
    assert 1 <= len(touched) <= 3 and versions(t.base)[2] == sorted(touched)
    again = BucketedTable(spark, t.base)
    assert rows(again.read()) == rows(C.upsert_by_key(old, new, seq="ts", preserve=["source_site"]))
    assert {r[1] for r in rows(again.read()) if r[0] == "u7"} == {"later"}
    assert again.upsert(new.limit(0)) == [] and rows(BucketedTable(spark, t.base).read()) == rows(again.read())


def test_log_is_merged_on_read_and_by_compaction(spark, tmp_path):
    old = spark.createDataFrame([("u1", "a", "s1", 0), ("u2", "b", "s2", 0), ("u9", None, None, None)], SCHEMA)
    t = BucketedTable.create(old, str(tmp_path / "t"), buckets=16)
    sink = BucketedUpsert(t, "ts")
    sink(spark.createDataFrame([("u1", "x", "z", 50), ("u3", "c", "s3", 1), ("u1", "early", "z", 2)], SCHEMA), 0)
    sink(spark.createDataFrame([("u1", "y", "z", 1)], SCHEMA), 1)
    sink(spark.createDataFrame([("u1", "y", "z", 1)], SCHEMA), 1)  # a replayed epoch overwrites its own folder
    want = [("u1", "y", "s1", 1), ("u2", "b", "s2", 0), ("u3", "c", "s3", 1), ("u9", None, None, None)]
    assert rows(BucketedTable(spark, t.base).table(preserve=["source_site"])) == want  # after a restart
    assert len(t.compact(preserve=["source_site"])) <= 2
    assert rows(BucketedTable(spark, t.base).read()) == want
    assert t.compact() == []
    sink(spark.createDataFrame([("u2", "again", None, 7)], SCHEMA), 2)
    assert ("u2", "again", None, 7) in rows(BucketedTable(spark, t.base).table())


def test_untouched_buckets_do_not_shuffle(spark, tmp_path):
    t = BucketedTable.create(spark.range(1000).selectExpr("concat('u', id) as url", "'n' as name", "'s' as source_site", "id as ts"), str(tmp_path / "t"), buckets=8)
    t.append(spark.createDataFrame([("u1", "x", "z", 1)], SCHEMA), 0)
    merged = t.table()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Union" in plan
    assert merged.count() == 1000


def test_a_replayed_epoch_of_an_upsert_changes_nothing(spark, tmp_path):
    t = BucketedTable.create(spark.createDataFrame([("u1", "a", "s", 0)], SCHEMA), str(tmp_path / "t"), buckets=4)
    batch = spark.createDataFrame([("u1", "b", "s", 0), (None, "no key", "s", 0)], SCHEMA)
    assert len(t.upsert(batch, epoch=3)) >= 1
    t = BucketedTable(spark, t.base)
    assert t.upsert(batch.withColumn("name", F.lit("c")), epoch=3) == [] and {r[1] for r in rows(t.read())} == {"b", "no key"}
    assert t.upsert(batch.withColumn("name", F.lit("c")), epoch=4) and {r[1] for r in rows(t.read())} == {"c"}


def test_crash_before_the_manifest_leaves_the_table(spark, tmp_path, monkeypatch):
    t = BucketedTable.create(spark.createDataFrame([("u1", "a", "s", 0)], SCHEMA), str(tmp_path / "t"), buckets=4)
    batch = spark.createDataFrame([("u1", "b", "s", 0)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "_commit", lambda self, *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.upsert(batch)
    t = BucketedTable(spark, t.base)
    assert [r[1] for r in rows(t.read())] == ["a"]
    t.upsert(batch)
    assert [r[1] for r in rows(BucketedTable(spark, t.base).read())] == ["b"]


def test_empty_table(spark, tmp_path):
    t = BucketedTable.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"))
    assert t.read().count() == t.table().count() == 0
    t.upsert(spark.createDataFrame([("u1", "a", "s", 0)], SCHEMA))
    assert rows(BucketedTable(spark, t.base).read()) == [("u1", "a", "s", 0)]
    with pytest.raises(ValueError):
        BucketedTable.create(t.read(), t.base)
