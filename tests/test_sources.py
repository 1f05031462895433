"""Files in, files out, the reading log, streams and the registry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriesloom.operators import sessions as S
from seriesloom.sources import reading_log, readings, sinks


def test_csv_readings(spark, tmp_path):
    (tmp_path / "vip.csv").write_text(
        "pid,datatime,measuretime,sbp,dbp,uf,extra\n1,2026-01-01 08:00:00,0,140,80,0.1,z\n1,2026-01-01 09:00:00,60,150,85,,z\n"
        "1,not a date,0,140,80,,z\n1,2026-01-01 10:00:00,0,300,80,,z\n1,2026-01-01 11:00:00,0,90,85,,z\n")
    good, counts = readings.read_readings(spark, str(tmp_path / "vip.csv"))
    assert good.count() == 2 and counts.first().asDict() == {"raw": 5, "undated": 1, "rejected": 2}
    s = S.collapse_days(S.reduce_runs(S.number_runs(good))).first()
    assert (s.sbp, s.sbp_post, s.n_meas, s.session_hours) == (140, 150, 2, 1.0)
    with pytest.raises(readings.MissingInput):
        readings.read_readings(spark, str(tmp_path / "nothing.csv"))
    (tmp_path / "bad.csv").write_text("pid,datatime\n1,2026-01-01\n")
    with pytest.raises(ValueError):
        readings.read_readings(spark, str(tmp_path / "bad.csv"))


def test_records_and_static(spark, tmp_path):
    (tmp_path / "d1.csv").write_text("pid,keyindate,weightstart,weightend,dryweight,temperature\n1,2026-01-01 08:00:00,70,68,67,36.5\n"
                                     "1,2026-01-01 08:00:00,71,68,67,36.5\n1,nope,1,1,1,1\n")
    (tmp_path / "idp.csv").write_text("pid,gender,birthday,DM,first_dialysis\n1,M,1960,,2015-03\n2,F,1950,1,bad\n")
    r = readings.read_records(spark, str(tmp_path / "d1.csv"))
    assert r.count() == 2
    one = S.first_per_key(r, ["patient_id", "day"], ["seq"]).first()
    assert one.weightstart == 70.0
    d = S.with_age(readings.read_demographics(spark, str(tmp_path / "idp.csv")), 2026).orderBy("patient_id").collect()
    assert [x.age for x in d] == [66.0, 76.0] and d[0].first_dialysis_ts.year == 2015 and d[1].first_dialysis_ts is None


def test_same_day_collapse(spark):
    t = dt.datetime
    rows = [("p", t(2026, 1, 1, 9), 0, 150.0, 80, 1.0), ("p", t(2026, 1, 1, 10), 1, 140.0, 78, 2.0), ("p", t(2026, 1, 1, 20), 2, 160.0, 90, None),
            ("p", t(2026, 1, 2, 2), 3, 130.0, 70, None), ("p", t(2026, 1, 2, 8), 4, 128.0, 70, None)]
    df = spark.createDataFrame(rows, "patient_id string, ts timestamp, seq int, sbp double, dbp int, uf double")
    runs = S.reduce_runs(S.number_runs(df)).orderBy("run").collect()
    # Exactly six hours stay in one run; more starts a new one.
    assert [r.n_meas for r in runs] == [2, 3] and runs[1].crosses_midnight
    day = S.collapse_days(S.reduce_runs(S.number_runs(df))).collect()
    assert len(day) == 1 and day[0].sbp == 150.0 and day[0].sbp_post == 128.0 and day[0].uf_total == 2.0 and day[0].session_hours == 13.0


def test_sinks(spark, tmp_path):
    df = spark.range(6).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    sinks.write_frame(df, str(tmp_path / "panel"), ("split",))
    back = sinks.read_frame(spark, str(tmp_path / "panel")).where("split = 'test'")
    assert back.count() == 3
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 6
    sinks.write_settings(spark, str(tmp_path / "settings"), {"a": [1, 2]})
    assert sinks.read_settings(spark, str(tmp_path / "settings")) == {"a": [1, 2]}


def test_reading_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("# mine\n2026-01-01, 120, 80\n\n2026-01-02; 130;85;72; w=70.5; meds=n; sym=sob+edema; pos=standing\n"
                                      "2026-01-03, 120\n2026-01-04, 120, 80, mood=bad\n2026-01-05, 120, 80, fast\n2026-01-06, 120, 80, meds=maybe\n"
                                      "2026-01-07, 120, 80, pos=flying\n2026-01-08, 120, 80, w=heavy\nsomeday, 120, 80\n")
    p = reading_log.parse(reading_log.numbered_lines(spark, str(tmp_path / "log.txt")))
    good = reading_log.good(p).orderBy("line").collect()
    assert [g.line for g in good] == [2, 4]
    g = good[1]
    assert (g.sbp, g.pulse, g.weight, g.took_all_meds, g.symptoms, g.position) == (130, 72.0, 70.5, False, ["sob", "edema"], "STANDING")
    bad = {b.line: b.error for b in reading_log.bad(p).collect()}
    assert set(bad) == {5, 6, 7, 8, 9, 10, 11} and bad[6] == "unknown field mood" and bad[5] == "expected date, sbp, dbp"


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


@pytest.mark.parametrize("name", ["alerts_per_tier", "streamed_sessions", "streamed_alerts", "key_sets", "threshold_search"])
def test_some_queries_run(spark, sf, name):
    assert len(entry.queries()[name](spark, sf).columns) > 2
