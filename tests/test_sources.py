import datetime as dt

import pytest

from panelworks.sources import tables as S
from panelworks.streaming.incremental import append_to, event_stream


def test_csv_and_history(spark, tmp_path):
    (tmp_path / "d.csv").write_text("ts,day,close,extra\n﻿a,20200102,1.5,x\nb,20200103,bad,y\n")
    raw = S.read_csv(spark, str(tmp_path / "d.csv"), ["ts", "day", "close"])
    bars = S.daily_bars(raw, "ts", "day", ["close"])
    assert [(r.ts, r.close) for r in bars.orderBy("ts").collect()] == [("a", 1.5), ("b", None)]
    codes = spark.createDataFrame([("a",)], "ts string")
    assert S.history(bars, codes, "ts", "2020-01-01", "2020-01-31").count() == 1


def test_years_are_written_once_and_pruned(spark, tmp_path):
    d = spark.createDataFrame([(1, dt.date(2019, 5, 1)), (1, dt.date(2020, 5, 1))], "k int, day date")
    path = str(tmp_path / "t")
    S.write_years(d, path, "day")
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_years(d, path, "day")
    assert S.read_years(spark, path, "day", "2020-01-01", "2020-12-31").count() == 1
    with pytest.raises(FileNotFoundError):
        S.read_years_strict(spark, path, "day", "2019-01-01", "2021-12-31", ["k", "day"])


def test_runs_and_optional_tables(spark, tmp_path):
    s, runs = spark.createDataFrame([(1.0,)], "x double"), str(tmp_path / "runs")
    tables = dict.fromkeys(S.RUN_TABLES, s)
    S.write_run(tables, runs, "f", "r1", "g")
    S.write_run(tables, runs, "f", "r2", "g")
    assert {r.run_id for r in S.run_index(spark, runs).collect()} == {"r1", "r2"}
    with pytest.raises(KeyError, match="without"):
        S.write_run({"summary": s}, runs, "f", "r3", "g")
    S.write_run({"raw": s}, runs, "f", "r4", "g", required=())
    with pytest.raises(Exception, match="no summary"):
        S.run_index(spark, runs).collect()
    assert S.read_any(spark, str(tmp_path / "none.parquet"), s.schema, optional=True).count() == 0
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND"):
        S.read_any(spark, str(tmp_path / "none.parquet"))
    assert [r.x for r in S.merge_events(s, s, spark.createDataFrame([(0.5,)], "x double")).collect()] == [0.5, 1.0]


def test_repeated_keys_are_errors_when_rows_are_made(spark):
    raw = spark.createDataFrame([("a", "20200101", "called", None, None, "1", None)] * 2, "k string, d string, s string, r string, p string, x string, t string")
    names = {"k": "code", "d": "effective_date", "s": "event_status", "r": "call_reg_date", "p": "payment_date", "x": "call_price", "t": "call_price_tax"}
    with pytest.raises(Exception, match="not unique"):
        S.redemption_events(raw, "code", names).collect()
    assert S.redemption_events(raw.limit(1), "code", names).first().call_price == 1.0


def test_incremental_intake(spark, tmp_path):
    kind = "k int, at timestamp, note string"
    one = spark.createDataFrame([(1, dt.datetime(2020, 1, 9), "x")] * 2 + [(2, dt.datetime(2020, 1, 9), None)], kind)
    two = spark.createDataFrame([(1, dt.datetime(2020, 1, 9), "y"), (2, dt.datetime(2020, 1, 9), None), (3, dt.datetime(2010, 1, 1), "late")], kind)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for d in (one, two):
        d.write.mode("append").parquet(source)
        append_to(event_stream(spark, source, d.schema), out, str(tmp_path / "cp")).awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 4 and got == {tuple(r) for r in S.merge_events(one, two).collect()}
