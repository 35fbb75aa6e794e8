"""Fan-out with rejects (K01), late rows (K02, K03), daily states (E01), scorer hook."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import daily
from shelfspark.operators.scoring import ScoreTable
from shelfspark.streaming import fanout as FO

LANDED = "id long, kind string, url string, source string, product_name string, page string, message_id string, rating string, comment string, user_id string, session_id string, environment string, ts timestamp_ntz"


def landed(spark, rows):
    cols = [c.split()[0] for c in LANDED.split(", ")]
    return spark.createDataFrame([tuple({"environment": "p", **r}.get(c) for c in cols) for r in rows], LANDED.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_fanout_rejects_and_replays(spark, tmp_path):
    sink = FO.EventFanOut(spark, str(tmp_path / "f"))
    first = landed(spark, [{"id": 1, "kind": "click", "url": "/a"}, {"id": 2, "kind": "click", "url": " "}, {"id": 3, "kind": "pageview", "page": "/"},
                           {"id": 4, "kind": "feedback", "message_id": "m", "rating": "up"}, {"id": 5, "kind": "feedback", "message_id": "m", "rating": "UP"},
                           {"id": 6, "kind": "feedback", "rating": "up"}, {"id": 7, "kind": None}, {"id": 8, "kind": "pageview"}])
    sink(first, 0)
    sink(landed(spark, [{"id": 9, "kind": "click", "url": "/b"}]), 1)
    sink(first, 0)  # a replayed epoch
    again = FO.EventFanOut(spark, str(tmp_path / "f"))
    ids = {k: sorted(r.id for r in again.read(k).collect()) for k in [*FO.TABLES, "reject"]}
    assert ids == {"click": [1, 9], "pageview": [3], "feedback": [4], "reject": [2, 5, 6, 7, 8]}
    assert {r.id: r.reason for r in again.read("reject").collect()} == {2: "click without url", 5: "rating not up or down", 6: "feedback without message", 7: "unknown kind", 8: "pageview without page"}
    assert again.records()[0] == {"click": 1, "pageview": 1, "feedback": 1, "reject": 5}


def test_an_epoch_without_its_record_is_not_read(spark, tmp_path, monkeypatch):
    sink = FO.EventFanOut(spark, str(tmp_path / "f"))
    with monkeypatch.context() as m:
        m.setattr(FO.EventFanOut, "record", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink(landed(spark, [{"id": 1, "kind": "click", "url": "/a"}]), 0)
    assert sink.read("click") is None
    sink(landed(spark, [{"id": 1, "kind": "click", "url": "/a"}]), 0)
    assert sink.read("click").count() == 1


def times(spark, rows):
    return spark.createDataFrame(rows, "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_late_hours_are_kept(spark, tmp_path):
    sink = FO.HourlyWithLate(spark, str(tmp_path / "h"), "ts", 3600)
    sink(times(spark, [(1, "2024-01-01 10:30:00"), (2, "2024-01-01 10:59:00")]), 0)
    sink(times(spark, [(3, "2024-01-01 13:10:00"), (4, "2024-01-01 10:01:00")]), 1)  # watermark 09:59: both in time
    sink(times(spark, [(5, "2024-01-01 10:02:00"), (6, "2024-01-01 12:20:00")]), 2)  # watermark 12:10: hour 10 is closed
    sink(times(spark, [(5, "2024-01-01 10:02:00"), (6, "2024-01-01 12:20:00")]), 2)
    assert [r.id for r in sink.read("late").collect()] == [5]
    hours = lambda df: {str(r.hour)[11:13]: r.views for r in df.collect()}
    assert hours(sink.closed()) == {"10": 3} and hours(sink.table()) == {"10": 4, "12": 1, "13": 1}


def test_dedupe_keeps_late_rows(spark, tmp_path):
    sink = FO.DedupeWithLate(spark, str(tmp_path / "d"), "id", "ts", 3600)
    a = times(spark, [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00")])
    sink(a, 0)
    sink(times(spark, [(2, "2024-01-01 12:00:00"), (3, "2024-01-01 09:00:00"), (1, "2024-01-01 10:00:00"), (4, "2024-01-01 13:00:00")]), 1)
    assert sorted(r.id for r in sink.read("late").collect()) == [1, 3]
    assert sorted(r.id for r in sink.table(a.schema).collect()) == [1, 2, 3, 4]


def clicks(spark, rows):
    return spark.createDataFrame(rows, "ts string, user string, env string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_daily_states_equal_raw_rows(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} {h:02d}:00:00", None if (d + h) % 11 == 0 else f"u{(d * h) % 17}", "ab"[h % 2]) for d in range(1, 21) for h in (0, 5, 12, 23)]
    raw = clicks(spark, rows)
    st = daily.DailyStates(spark, str(tmp_path / "s"), "ts", ["env"], ["user"], {"rows": F.count(F.lit(1))})
    st.refresh(raw.where("ts <= timestamp_ntz'2024-01-10 00:00:00'"))
    st.refresh(raw.where("ts > timestamp_ntz'2024-01-10 00:00:00'"))
    names = {"rows": "n", "user": "users"}
    for as_of, days, env in (("2024-01-21 00:00:00", 7, None), ("2024-01-21 00:00:00", 30, "a"), ("2024-01-12 00:00:00", 1, "b"), ("2024-02-20 00:00:00", 1, None), ("2024-01-15 05:00:00", 4, None)):
        cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
        want = raw.where(F.col("ts") > cut).where(F.lit(env is None) | (F.col("env") == F.lit(env))).agg(F.count(F.lit(1)), F.count_distinct("user")).first()
        assert tuple(st.totals(names, as_of, days, raw=raw, env=env).first()) == tuple(want), (as_of, days, env)
    with pytest.raises(ValueError):
        st.totals(names, "2024-01-15 05:00:00", 4)


def test_a_new_day_touches_one_day(spark, tmp_path):
    st = daily.DailyStates(spark, str(tmp_path / "s"), "ts", ["env"], ["user"], {"rows": F.count(F.lit(1))})
    st.refresh(clicks(spark, [("2024-01-01 10:00:00", "u1", "a"), ("2024-01-02 10:00:00", "u2", "a")]))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/s/states/day=*/*.parquet")}
    before = files()
    st.refresh(clicks(spark, [("2024-01-03 10:00:00", "u1", "a"), ("2024-01-03 11:00:00", "u9", "a")]))
    after = files()
    assert {f: t for f, t in after.items() if "2024-01-03" not in f} == before and len(after) > len(before)
    assert tuple(st.totals({"rows": "n", "user": "users"}, "2024-01-04 00:00:00", 7).first()) == (4, 3)


def test_scores_are_kept(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def scorer(queries, documents):
        with open(calls, "a") as f:
            f.writelines(f"{q}|{d}\n" for q, d in zip(queries, documents))
        return [float(len(q) + len(d)) if d else None for q, d in zip(queries, documents)]

    pairs = spark.createDataFrame([(1, "q", "doc"), (2, "q", "doc"), (3, "qq", "doc"), (4, None, ""), (5, "q", None)], "id long, query string, document string")
    table = ScoreTable(str(tmp_path / "scores"), scorer, batch=2)
    want = {1: 4.0, 2: 4.0, 3: 5.0, 4: None, 5: None}
    assert {r.id: r.score for r in table.scores(pairs).collect()} == want
    assert len(open(calls).readlines()) == 4  # distinct pairs
    more = pairs.union(spark.createDataFrame([(6, "new", "d")], pairs.schema))
    assert {r.id: r.score for r in ScoreTable(str(tmp_path / "scores"), scorer).scores(more).collect()} == want | {6: 4.0}
    assert len(open(calls).readlines()) == 5
