"""Audits of several tables, the event log, reads on a schedule and the normal tail."""

import datetime as dt
import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from panelworks.functions.stats import normal_p
from panelworks.operators.audits import input_audit, preprocessing_audit
from panelworks.sources import event_log
from panelworks.sources import tables as S

D = dt.date


def test_normal_tail(spark):
    x = [0.0, 1e-12, 0.5, -1.96, 2.60146, 2.999999, 3.0, 3.5, -6.0, 12.0, 40.0, math.inf, math.nan, None]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "t double").coalesce(1).select(normal_p("t").alias("p")).collect()]
    assert got[-2:] == [None, None]
    for v, p in zip(x[:-2], got[:-2], strict=True):
        want = math.erfc(abs(v) / math.sqrt(2))
        assert abs(p - want) <= 1e-14 + 1e-11 * want
    assert abs(got[4] - 0.0092828) < 1e-7


def inputs(spark):
    d = [D(2020, 1, k) for k in (1, 2, 3)]
    context = spark.createDataFrame([(c, d[0]) for c in "ab"], "code string, signal_date date")
    terms = spark.createDataFrame([("a",), ("b",)], "code string")
    market = spark.createDataFrame([(c, x, 1.0, 0.5, x == d[1], True) for c in "ab" for x in d], "code string, trade_date date, open double, pre_close double, one_price boolean, has_market_observation boolean")
    life = market.select("code", "trade_date")
    labels = spark.createDataFrame([(c, d[0], d[2], True, 0.1) for c in "ab"], "code string, signal_date date, exit_date date, label_usable boolean, forward_return double")
    return context, terms, market, life, labels


def test_input_audit_counts_each_fault(spark):
    context, terms, market, life, labels = inputs(spark)
    run = lambda c=context, t=terms, m=market, f=life, b=labels, end="2020-01-03": input_audit(c, t, m, f, b, "code", end).first().asDict()
    clean = run()
    assert clean["passed"] and (clean["n_context"], clean["n_dates"], clean["n_terms"], clean["n_market"], clean["n_labels"], clean["n_usable"], clean["one_price_up"], clean["one_price_down"]) == (2, 1, 2, 6, 2, 2, 2, 0)
    one = lambda df: df.where("code = 'a'")
    null = market.limit(1).withColumn("code", F.lit(None).cast("string"))
    cases = {
        "context_without_terms": run(t=one(terms)), "terms_repeats": run(t=terms.unionByName(one(terms))), "context_repeats": run(c=context.unionByName(one(context))),
        "market_repeats": run(m=market.unionByName(one(market).limit(1))), "lifecycle_only": run(m=one(market)), "market_only": run(f=one(life)), "lifecycle_repeats": run(f=life.unionByName(one(life).limit(1))),
        "context_without_label": run(b=one(labels)), "label_without_context": run(c=one(context)), "label_repeats": run(b=labels.unionByName(one(labels))),
        "usable_without_return": run(b=labels.withColumn("forward_return", F.when(F.col("code") == "a", math.inf).otherwise(0.1))), "usable_past_end": run(end="2020-01-02"),
        "unusable_with_return": run(b=labels.withColumn("label_usable", F.col("code") == "a")), "null_keys": run(m=market.unionByName(null)),
    }
    for fault, row in cases.items():
        assert row[fault] > 0 and not row["passed"], fault
    assert cases["usable_past_end"]["usable_past_end"] == 2 and cases["lifecycle_only"]["lifecycle_only"] == 3
    empty = [x.limit(0) for x in inputs(spark)]
    assert run(*empty)["passed"] and run(*empty)["n_context"] == 0
    wide = labels.withColumn("horizon_days", F.explode(F.array(F.lit(1), F.lit(5))))
    assert input_audit(context, terms, market, life, wide, "code", "2020-01-03", (1, 5)).first().passed
    lost = input_audit(context, terms, market, life, wide.where("code = 'a' or horizon_days = 1"), "code", "2020-01-03", (1, 5)).first()
    assert lost.context_without_label == 1 and not lost.passed


def test_preprocessing_audit(spark):
    rows = [(k, D(2020, 1, 1 + d), float(k), None if k == 1 else 2.0, None if k == 2 else "x", 5 * d) for k in range(4) for d in range(2)]
    p = spark.createDataFrame(rows, "code int, day date, f double, market_cap double, industry_control string, market_cap_age int")
    s = spark.createDataFrame([("f", 2.5, 3, 0.3, 0.9), ("f", 3.0, 2, 0.2, 0.95), ("f", 3.5, 4, 0.4, 0.9)], "factor string, multiplier double, n_clipped long, clip_rate double, mean_rank_correlation double")
    r = preprocessing_audit(p, "code", "day", ["f"], s, ["f"]).first()
    assert (r.n_rows, r.n_dates, r.n_entities, r.repeated_keys, r.coverage__f, r.cap_coverage, r.joint_coverage, r.oldest_cap, r.clip_rate__f, r.not_monotone, r.passed) == (8, 2, 4, 0, 1.0, 0.75, 0.5, 5, 0.2, 1, False)
    good = s.where("multiplier < 3.5")
    assert preprocessing_audit(p, "code", "day", ["f"], good, ["f"]).first().passed
    for faulty, outputs in ((p.unionByName(p.limit(1)), ["f"]), (p, ["f", "g"]), (p.withColumn("label_x", F.lit(1)), ["f"])):
        assert not preprocessing_audit(faulty, "code", "day", ["f"], good, outputs).first().passed
    none = preprocessing_audit(p.limit(0), "code", "day", ["f"], good, ["f"]).first()
    assert none.n_rows == 0 and none.coverage__f is None and none.passed


def files_of(path):
    return {str(f) for f in Path(path).rglob("*.parquet")}


def test_event_log_keeps_first_versions(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "log")
    schema = "k int, name string, x double"
    rows = [(rng.randrange(50) if rng.random() > 0.1 else None, rng.choice(["a", "b", None]), rng.choice([0.5, None])) for _ in range(300)]
    batches = [rows[:120], rows[60:200], [], rows]
    first = {}
    for version, b in enumerate(batches):
        event_log.add_events(spark.createDataFrame(b, schema), path, version)
        for r in b:
            first.setdefault(r, version)
        before = files_of(path)
        event_log.add_events(spark.createDataFrame(b, schema), path, version)  # run again: nothing new
        known = spark.createDataFrame([], schema).schema
        for v in range(version + 1):
            got = event_log.read_events(spark, path, known, v).collect()
            assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == {r for r, at in first.items() if at <= v}
        assert before <= files_of(path)  # nothing is rewritten
    assert event_log.read_events(spark, str(tmp_path / "none"), known).count() == 0


def test_event_log_reads_only_ranges_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    event_log.add_events(spark.range(5000).withColumn("y", F.col("id") * 2), path, 0)
    batch = spark.createDataFrame([(7, 14), (10**6, 1)], "id long, y long")
    ranges = {r["_range"] for r in event_log._hashed(batch, ["id", "y"]).collect()}
    for f in files_of(path):  # what the batch does not meet cannot be read any more
        if not any(f"_range={r}/" in f for r in ranges):
            Path(f).write_bytes(b"not parquet")
    event_log.add_events(batch, path, 1)
    kept = event_log.known_in_ranges(spark, path, batch.schema, sorted(ranges)).where("_version = 1").collect()
    assert [(r.id, r.y) for r in kept] == [(10**6, 1)]


def test_event_log_from_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    d = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string")
    d.write.parquet(source)
    for _ in range(2):
        event_log.stream_events(spark.readStream.schema(d.schema).parquet(source), path, str(tmp_path / "cp")).awaitTermination()
        d.unionByName(spark.createDataFrame([(3, "c")], d.schema)).write.mode("append").parquet(source)
    assert sorted(tuple(r) for r in event_log.read_events(spark, path, d.schema).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_schedule_prunes_years(spark, tmp_path):
    path = str(tmp_path / "years")
    d = spark.createDataFrame([(k, D(2010 + k % 6, 1 + k % 12, 1 + k % 28)) for k in range(600)], "k int, day date")
    S.write_years(d, path, "day")
    dates = spark.createDataFrame([(D(2012, 3, 15),), (D(2013, 4, 4),), (D(2012, 3, 15),), (None,), (D(2030, 1, 1),)], "signal_date date").where("signal_date is null or signal_date > '2000-01-01'")
    got = S.read_on_schedule(spark, path, "day", dates)
    assert "dynamicpruningexpression" in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(r.k for r in d.where("day in (date'2012-03-15', date'2013-04-04')").collect())
    for f in files_of(path):  # the plan is made: a scan that opened other years would now fail
        if "year=2012" not in f and "year=2013" not in f:
            Path(f).unlink()
    assert sorted(r.k for r in got.collect()) == want and want


def test_universe_moves_its_rows_once(spark):
    """A key becomes its signal dates after the shuffle, and no later window or join moves them; planted repeats do not make the panel twice."""
    from panelworks.plans.event_queries import faulty_universe, universe

    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    made = plan(universe(spark, "/root/testdata/sf0.001"))
    above = made.split("REPARTITION_BY_NUM")[0]
    assert made.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(" not in above.rsplit("Exchange", 1)[0] and "SortMergeJoin" not in above
    assert plan(faulty_universe(spark, "/root/testdata/sf0.001")[0]).count("REPARTITION_BY_NUM") == 1


def test_audits_of_the_universe_read_it_once(spark):
    """What is left to the plan of an audit reads stored counts, not customers and orders."""
    from panelworks.plans.event_queries import universe_audit, universe_enrichment

    for made in (universe_audit, universe_enrichment):
        files = made(spark, "/root/testdata/sf0.001").inputFiles()
        assert not [f for f in files if "customer" in f]


def test_universe_panel_without_signals_or_reference(spark):
    """A key without a reference row and a calendar without signals make no rows; a null rating of the latest event stays null."""
    import datetime as dt

    from panelworks.operators.universe import universe_panel

    day = lambda i: dt.date(2020, 1, 6) + dt.timedelta(7 * i)
    cal = spark.createDataFrame([(day(i), i) for i in range(6)], "trade_date date, cal_idx int")
    reference = spark.createDataFrame([("a", day(0), 100.0, 1.0), ("c", day(1), 50.0, None)], "code string, list_date date, issue_size double, first_price double")
    daily = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 2.0), ("b", day(1), 5.0)], "code string, trade_date date, vol double")
    rated = spark.createDataFrame([("a", day(1), "AA", 17), ("a", day(3), None, None)], "code string, effective_date date, rating string, rating_score int")
    shared = spark.createDataFrame([("a", day(2), 200.0, 3.0)], "code string, effective_date date, remain_size double, convert_price double")
    run = lambda s: universe_panel(spark.createDataFrame(s, "signal_date date"), reference, daily, cal, rated, shared, "code", minimum_age=1, minimum_size=1.0, volume_scale=1.0)
    assert run([]).count() == 0
    rows = {(r.code, r.signal_date): r for r in run([(day(1),), (day(4),)]).collect()}
    assert sorted(rows) == [("a", day(1)), ("a", day(4)), ("c", day(1)), ("c", day(4))]
    a = rows["a", day(4)]
    assert (a.rating, a.rating_date, a.remain_size, a.share_date, a.turnover_sum, a.observation_ratio) == (None, day(3), 200.0, day(2), 1 / 100 + 2 / 200, 0.1)
    assert (rows["a", day(1)].rating, rows["a", day(1)].remain_size, rows["c", day(4)].turnover_sum) == ("AA", None, 0.0)


def test_parts_are_valued_where_their_lines_are(spark):
    """No partial aggregate of order lines runs in a scan: the lines are moved by part once, and aggregated there."""
    from panelworks.plans.event_queries import valued

    made = valued(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert made.count("hashpartitioning(l_partkey") == 1 and "partial_max_by" in made.split("hashpartitioning(l_partkey")[0]


def test_studies_store_what_they_read_several_times_once(spark, monkeypatch):
    """One bundle for a frame and its context, one table of scores for a book and its audit; final plans read no order lines."""
    from panelworks.plans import evidence_queries as Q
    from panelworks.plans.factor_queries import trading_audit

    names, sf = [], "/root/testdata/sf0.001"
    kept = Q.stored
    monkeypatch.setattr(Q, "stored", lambda df, name: (names.append(name), kept(df, name))[1])
    Q.violations(Q.Study(spark, sf))
    assert names.count("valuation") == 1 and names.count("faulty-frame") == 1 and "bond-daily" not in names
    made = Q.buffer_audit(Q.Study(spark, sf)), trading_audit(spark, sf)
    assert names.count("barred") == 1
    for d in made:
        assert not [f for f in d.inputFiles() if "lineitem" in f or "/bars-" in f]


def test_counters_of_null_and_repeated_keys(spark):
    """A null key equals no other: it is outside the context, and both missing and beyond what is expected."""
    from panelworks.operators.registry import factor_violations
    from panelworks.operators.valuation import factor_audit

    frame = spark.createDataFrame([(1, "a", 1.0, 1), (1, "a", 1.0, 1), (None, "a", 1.0, 1), (2, "b", 1.0, 2)], "signal_date int, code string, raw_factor double, available_date int")
    context = spark.createDataFrame([(1, "a"), (None, "a")], "signal_date int, code string")
    r = factor_violations(frame, context).first()
    assert (r.null_keys, r.repeated_keys, r.outside_context) == (1, 1, 2)
    actual = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 1.0), ("c", 1.0)], "k string, f double")
    expected = spark.createDataFrame([("a", 1.0), (None, 1.0), ("d", 1.0)], "k string, f double")
    r = factor_audit(actual, expected, ["k"], ["f"]).first()
    assert (r.mismatches, r.missing_keys, r.extra_keys, r.repeated_keys) == (1, 2, 2, 1)
