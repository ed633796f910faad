"""Hand-computed cases of single operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelworks.functions.expressions import bucket, clean_date, exchange_suffix, log_size, number, rating_score, remaining_years, year_of
from panelworks.functions.ranks import exact_quantiles, global_rank
from panelworks.functions.stats import newey_west
from panelworks.operators import cross_section as X
from panelworks.operators import evaluation as E
from panelworks.operators import execution as M
from panelworks.operators import factors as T
from panelworks.operators import portfolio as P
from panelworks.operators import universe as U
from panelworks.operators import valuation as V
from panelworks.operators.asof import asof_backward
from panelworks.operators.calendar import calendar, listing_age, month_windows, next_open, rebalance_calendar
from panelworks.operators.checks import assert_unique, fingerprint, forbid_columns, holdout_guard, key_difference, require_columns, research_slice, run_identity
from panelworks.operators.registry import FactorBundle, FactorSpec, bundle_violations, default_registry

D = dt.date


def days(spark, *ds):
    return calendar(spark.createDataFrame([(d,) for d in ds], "trade_date date"))


def test_cleaning(spark):
    r = spark.createDataFrame([("20200102",), ("20200102.0",), ("2020-01-02T08:00:00",), ("x",)], "s string").select(clean_date("s").alias("d")).collect()
    assert [x.d for x in r] == [D(2020, 1, 2)] * 3 + [None]
    r = spark.createDataFrame([("1.5",), ("NaN",), ("a",), (None,)], "s string").select(number("s").alias("x")).collect()
    assert [x.x for x in r] == [1.5, None, None, None]
    r = spark.createDataFrame([(" aaa",), ("C",), ("zz",)], "s string").select(rating_score("s").alias("x")).collect()
    assert [x.x for x in r] == [19, 1, None]
    r = spark.createDataFrame([(-1.0,), (70.0,), (130.0,), (None,)], "x double").select(bucket("x").alias("b")).collect()
    assert [x.b for x in r] == [None, "70-90", ">=130", None]


def test_calendar(spark):
    cal = days(spark, D(2020, 1, 2), D(2020, 1, 3), D(2020, 1, 6))
    d = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 2),), (D(2020, 1, 4),), (D(2020, 1, 6),)], "d date")
    out = {r.d: (r.a, r.b) for r in next_open(next_open(d, "d", cal, "a"), "d", cal, "b", inclusive=True).collect()}
    assert out[D(2020, 1, 2)] == (D(2020, 1, 3), D(2020, 1, 2))
    assert out[D(2020, 1, 4)] == (D(2020, 1, 6), D(2020, 1, 6))
    assert out[D(2020, 1, 6)] == (None, D(2020, 1, 6))
    assert out[D(2020, 1, 1)] == (D(2020, 1, 2), D(2020, 1, 2))
    r = rebalance_calendar(cal, "2020-01-02", "2020-01-02", "2020-01-04", 2).orderBy("anchor_date").collect()
    assert [(x.anchor_date.day, x.signal_date.day) for x in r][:1] == [(2, 2)]
    with pytest.raises(Exception, match="two anchors"):
        rebalance_calendar(cal, "2020-01-02", "2020-01-02", "2020-01-06", 2).collect()
    ages = listing_age(spark.createDataFrame([(D(2020, 1, 6), D(2020, 1, 3)), (D(2020, 1, 6), D(2019, 1, 1))], "t date, l date"), "t", "l", cal).collect()
    assert sorted(x.listing_age for x in ages) == [2, 11]
    m = month_windows(spark, "2020-01-15", "2020-03-02").orderBy("window_start").collect()
    assert [(x.window_start, x.window_end) for x in m] == [(D(2020, 1, 15), D(2020, 1, 31)), (D(2020, 2, 1), D(2020, 2, 29)), (D(2020, 3, 1), D(2020, 3, 2))]


def test_asof_keeps_null_states_and_extra_columns(spark):
    panel = spark.createDataFrame([("a", D(2020, 1, 1), 1), ("a", D(2020, 1, 5), 2), ("b", D(2020, 1, 5), 3), (None, D(2020, 1, 5), 4)], "k string, d date, state int")
    events = spark.createDataFrame([("a", D(2020, 1, 2), "x"), ("a", D(2020, 1, 5), None)], "k string, e date, s string")
    got = {r.state: (r.s, r.on) for r in asof_backward(panel, events, "k", "d", "e", ["s"], "on").collect()}
    assert got == {1: (None, None), 2: (None, D(2020, 1, 5)), 3: (None, None), 4: (None, None)}


def test_events_are_seen_the_next_open_day(spark):
    cal = days(spark, D(2020, 1, 2), D(2020, 1, 3), D(2020, 1, 6))
    h = spark.createDataFrame([("a", D(2020, 1, 2), "AA"), ("a", D(2020, 1, 2), "A")], "k string, ann date, g string")
    r = U.rating_events(h, cal, "k", "ann", "g").collect()
    assert [(x.effective_date, x.rating) for x in r] == [(D(2020, 1, 3), "A")]
    s = spark.createDataFrame([("a", D(2020, 1, 2), D(2019, 9, 30), 1e8), ("a", D(2020, 1, 2), D(2019, 12, 31), 9e7)], "k string, p date, e date, remain_size double")
    assert [x.remain_size for x in U.share_events(s, cal, "k", "p", "e", ["remain_size"]).collect()] == [9e7]


def test_membership(spark):
    m = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "k int, industry string")
    r = {x.k: (x.industry, x.candidates) for x in U.resolve_membership(m, ["k"]).collect()}
    assert r == {1: ("x", "x"), 2: (None, "x|y")}


def test_valuation(spark):
    rows = [(D(2020, 1, 1), i, 110.0 + i, 10.0, 10.0) for i in range(5)] + [(D(2020, 1, 1), 9, 100.0, None, 10.0)]
    d = V.relative_premium(V.conversion_valuation(spark.createDataFrame(rows, "signal_date date, k int, close double, stock_close double, convert_price double")), ["signal_date"])
    r = {x.k: x for x in d.collect()}
    assert r[0].conversion_value == 100 and abs(r[0].conversion_premium - 0.10) < 1e-12
    assert abs(r[0].relative_premium + 0.02) < 1e-12 and abs(r[0].parity_score - 0.02) < 1e-12
    assert not r[9].valuation_available and r[9].relative_premium is None
    audit = lambda x: V.valuation_audit(x, d, ["k"], ["signal_date"]).first()
    assert audit(d).passed and audit(d).n_valued == 5
    assert audit(d.withColumn("double_low", F.col("double_low") + 1)).double_low_mismatches == 5
    assert audit(d.where("k <> 1").unionByName(d.where("k = 2"))).repeated_keys == 1
    assert audit(d.withColumn("k", F.col("k") + 1)).missing_keys == 2
    assert audit(d.withColumn("parity_score", -F.col("parity_score"))).score_sign_mismatches == 4


def test_window_factors_do_not_look_ahead(spark):
    rows = [("a", i, 100.0 + (i * 7) % 13, float(i % 3), 1.0) for i in range(60) if i % 11]
    d = spark.createDataFrame(rows, "code string, cal_idx int, close double, pct_chg double, adj_factor double")
    full = {r.cal_idx: r for r in T.volatility(T.momentum(d, "code"), "code").collect()}
    part = {r.cal_idx: r for r in T.volatility(T.momentum(d.where("cal_idx <= 40"), "code"), "code").collect()}
    assert all(full[i] == part[i] for i in part)
    assert full[5].stock_return_5d is None and full[6].stock_return_5d == full[6].close / full[1].close - 1
    assert full[16].stock_return_5d is None  # no row at 11


def test_abnormal_turnover_leaves_the_day_out(spark):
    rows = [("a", i, 10.0, 9.0, 9.5, 9.8, 100.0 + i, (100.0 + i) * 9.6 / 1000, 1e6) for i in range(40)]
    d = spark.createDataFrame(rows, "code string, cal_idx int, high double, low double, close double, open double, vol double, amount double, remain_size double").withColumn("bond_return", F.lit(0.01))
    r = {x.cal_idx: x for x in T.bond_trading(T.bond_trading_base(d), "code").collect()}
    t = lambda i: (100 + i) * 1000 / 1e6
    assert abs(r[30].cb_abnormal_turnover_20d - t(30) / (sum(t(i) for i in range(10, 30)) / 20)) < 1e-12
    assert r[30].vwap_unit_valid and r[10].cb_abnormal_turnover_20d is None


def test_cross_section(spark):
    d = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 100)] + [(1, None), (2, 5.0), (2, 5.0)], "d int, x double")
    r = X.winsorize_mad(d, "x", ["d"]).collect()
    assert max(v.winsorized__x for v in r if v.x == 100) == 3 + 3 * 1.4826
    z = X.standardize(d, "x", ["d"]).where("d = 2").collect()
    assert [v.standardized__x for v in z] == [0.0, 0.0]


def test_neutralize_equals_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(1, i, float(rng.normal()), float(rng.normal()), float(rng.normal()), "abc"[i % 3]) for i in range(30)]
    rows += [(2, i, float(i), 1.0, 2.0, "a") for i in range(10)] + [(3, i, float(rng.normal()), float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(10)] + [(3, 99, 1.0, None, 1.0, "z")]
    d = spark.createDataFrame(rows, "d int, i int, y double, p double, q double, c string")
    got = {(r.d, r.i): r.neutralized__y for r in X.neutralize(d, "y", ["d"], ["p", "q"], "c").collect()}
    a = np.array([[1, r[3], r[4], r[5] == "b", r[5] == "c"] for r in rows if r[0] == 1], float)
    y = np.array([r[2] for r in rows if r[0] == 1])
    res = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    assert max(abs(got[1, i] - res[i]) for i in range(30)) < 1e-10
    assert all(v is None for (k, _), v in got.items() if k in (2, 3))  # collinear; a lone category


def test_information_coefficient_and_newey_west(spark):
    rows = [(1, f"k{i}", float(i), float(i) * 2) for i in range(5)] + [(2, f"k{i}", 1.0, float(i)) for i in range(5)]
    r = {x.d: x for x in E.ic_series(spark.createDataFrame(rows, "d int, code string, processed_factor double, forward_return double"), ["d"]).collect()}
    assert abs(r[1].ic - 1) < 1e-12 and abs(r[1].rank_ic - 1) < 1e-12 and r[2].ic is None
    x = [0.1, 0.3, -0.1, 0.1]
    s = newey_west(spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "g int, t int, v double"), ["g"], "t", "v").first()
    u = [v - 0.1 for v in x]
    S = sum(a * a for a in u) + 2 * sum((1 - k / 4) * sum(u[i] * u[i - k] for i in range(k, 4)) for k in (1, 2, 3))
    assert s.positive_share == 0.75 and s.nw_lags == 3 and (S <= 0 or abs(s.nw_t - 0.1 / math.sqrt(S) * 4) < 1e-9)


def test_quantile_sizes(spark):
    d = spark.createDataFrame([(1, f"k{i}", float(-i), 0.1 * i) for i in range(7)], "d int, code string, processed_factor double, forward_return double")
    g = E.quantile_groups(d, ["d"], "code").groupBy("quantile").count().orderBy("quantile").collect()
    assert [x["count"] for x in g] == [2, 1, 2, 1, 1]
    with pytest.raises(Exception, match="too few assets"):
        E.quantile_groups(d.limit(3), ["d"], "code").collect()


def test_lifecycle_timeline(spark):
    ds = [D(2020, 1, i) for i in range(1, 13)]
    cal = days(spark, *ds)
    terms = spark.createDataFrame([("a", D(2019, 1, 1), None, None, None, None)], "code string, list_date date, delist_date date, maturity_date date, maturity_payment_date date, maturity_call_price double")
    ev = spark.createDataFrame([("a", D(2020, 1, 3), "w", None, None, None, None), ("a", D(2020, 1, 5), "c", D(2020, 1, 8), D(2020, 1, 9), D(2020, 1, 11), 100.8)], "code string, effective_date date, event_status string, last_trade_date date, call_reg_date date, payment_date date, call_price double")
    market = spark.createDataFrame([("a", d, True) for d in ds], "code string, trade_date date, is_tradable boolean")
    r = {x.trade_date.day: x for x in M.lifecycle_panel(terms, cal, M.prepare_redemptions(ev, "code", ["w"], ["c"], []), market, "code", seasoning=1).collect()}
    want = {2: "ACTIVE", 3: "REDEMPTION_WATCH", 5: "REDEMPTION_ANNOUNCED", 8: "LAST_TRADING_WINDOW", 9: "SETTLEMENT_RECEIVABLE", 11: "SETTLED"}
    assert {k: r[k].state for k in want} == want
    assert r[11].settlement_value == 100.8 and r[3].entry_allowed and r[5].exit_required
    with pytest.raises(Exception, match="two events"):
        M.prepare_redemptions(ev.unionByName(ev), "code", ["w"], ["c"], []).collect()


def test_listed_before_the_calendar_is_past_seasoning(spark):
    ds = [D(2020, 1, i) for i in range(1, 15)]
    terms = spark.createDataFrame([("old", D(2015, 6, 1)), ("new", D(2020, 1, 2)), ("later", D(2020, 1, 9))], "code string, list_date date")
    terms = terms.withColumns({c: F.lit(None).cast("date") for c in ("delist_date", "maturity_date", "maturity_payment_date")}).withColumn("maturity_call_price", F.lit(None).cast("double"))
    none = spark.createDataFrame([], "code string, effective_date date, event_kind string, last_trade_date date, call_reg_date date, payment_date date, call_price double")
    market = terms.select("code").crossJoin(days(spark, *ds).select("trade_date")).withColumn("is_tradable", F.lit(True))
    r = {(x.code, x.trade_date.day): x.state for x in M.lifecycle_panel(terms, days(spark, *ds), none, market, "code").collect()}
    assert r["old", 1] == "ACTIVE" and [r["new", d] for d in (1, 2, 11, 12)] == ["PRE_LISTED", "SEASONING", "SEASONING", "ACTIVE"] and r["later", 14] == "SEASONING"


def test_labels_must_exist(spark):
    f = spark.createDataFrame([("a", 1), ("b", 1)], "code string, d int")
    labels = spark.createDataFrame([("a", 1, True, float("inf")), ("b", 1, True, 0.5)], "code string, d int, label_usable boolean, forward_return double")
    assert {r.code: r.forward_return for r in M.attach_labels(f, labels, ["code", "d"]).collect()} == {"a": None, "b": 0.5}
    with pytest.raises(Exception, match="no label"):
        M.attach_labels(f, labels.where("code = 'a'"), ["code", "d"]).collect()


def test_execution_market(spark):
    rows = [("A", 11.0, 11.0, 11.0, 11.0, 10.0, 5.0, 5.0), ("B", 9.0, 9.0, 9.0, 9.0, 10.0, 5.0, 5.0), ("C", 10.0, 11.0, 9.0, 10.0, 10.0, 5.0, 5.0), ("D", 10.0, 11.0, 9.0, 10.0, 10.0, 0.0, 0.0)]
    d = spark.createDataFrame([(r[0], D(2020, 1, 1), *r[1:]) for r in rows], "code string, trade_date date, open double, high double, low double, close double, pre_close double, vol double, amount double")
    keys = spark.createDataFrame([(x,) for x in "ABCDE"], "code string")
    r = {x.code: (x.buy_allowed, x.sell_allowed) for x in M.execution_market(d, days(spark, D(2020, 1, 1)), keys, "code").collect()}
    assert r == {"A": (False, True), "B": (True, False), "C": (True, True), "D": (False, False), "E": (False, False)}


def _scores(spark, n_days=6, n=8):
    rows = [(D(2020, 1, 1 + t), f"k{i}", float((i * 5 + t * 3) % n) + i / 100, True, False) for t in range(n_days) for i in range(n)]
    return spark.createDataFrame(rows, "signal_date date, code string, processed_factor double, entry_allowed boolean, exit_required boolean"), rows


def test_buffer_fold_equals_plain_python(spark):
    s, rows = _scores(spark)
    got = {(r.exit_rank, r.signal_date, r.slot): (r.code, r.retained) for r in P.buffered(s, "code", n=3, exits=(3, 5)).collect()}
    want = {}
    for k in (3, 5):
        slots = [None] * 3
        for day in sorted({r[0] for r in rows}):
            order = [r[1] for r in sorted((r for r in rows if r[0] == day), key=lambda r: (-r[2], r[1]))]
            kept = [x if x in order[:k] else None for x in slots]
            rest = iter([x for x in order if x not in kept])
            slots = [x or next(rest) for x in kept]
            want |= {(k, day, i + 1): (slots[i], kept[i] is not None) for i in range(3)}
    assert got == want


def test_buffer_date_without_candidates_and_liquidation(spark):
    s, _ = _scores(spark, 3, 4)
    s = s.withColumn("entry_allowed", F.col("signal_date") != F.lit(D(2020, 1, 2))).unionByName(s.where("code = 'k0' and signal_date = date'2020-01-03'").withColumn("code", F.lit("inf")).withColumn("processed_factor", F.lit(float("inf"))))
    book = P.buffered(s, "code", n=2, exits=(3,))
    assert not book.where("signal_date = date'2020-01-02'").count() and not book.where("retained").count() and not book.where("code = 'inf'").count()
    a = {r.signal_date.day: (r.n_eligible, r.n_selected, r.n_entered, r.n_exited) for r in P.buffer_audit(book, s, "code").collect()}
    assert a == {1: (4, 2, 2, 0), 2: (0, 0, 0, 2), 3: (4, 2, 2, 0)}
    sched = spark.createDataFrame([(D(2020, 1, d), D(2020, 1, d + 1)) for d in (1, 2, 3)], "signal_date date, entry_date date")
    t = P.buffer_targets(book, sched, "code", "2020-01-09").collect()
    assert sorted(r.target_weight for r in t if r.execution_date == D(2020, 1, 9)) == [0.0, 0.0] and len(t) == 6
    with pytest.raises(Exception, match="not after"):
        P.buffer_targets(book, sched, "code", "2020-01-04").collect()


def test_cohort_capacity(spark):
    s, _ = _scores(spark, 4)
    sched = spark.createDataFrame([(D(2020, 1, 1 + t), D(2020, 1, 2 + t), D(2020, 1, 4 + t)) for t in range(4)], "signal_date date, entry_date date, exit_date date")
    headers, weights = P.cohorts(s, sched, "code", n=2, cash=0.1, cap=0.3)
    h = headers.orderBy("signal_date").collect()
    assert [round(x.given, 9) for x in h] == [0.6, 0.3, 0.6, 0.3] and [x.status for x in h] == ["allocated", "partially_allocated"] * 2
    last = weights.where("execution_date = date'2020-01-07'").collect()
    assert last and all(x.target_weight == 0 for x in last)


def test_ledger_residual_is_zero(spark):
    fills = spark.createDataFrame([("a", D(2020, 1, 1), 10.0, 5.0, 0.1), ("a", D(2020, 1, 2), -4.0, 6.0, 0.1)], "code string, trade_date date, quantity double, price double, fee double")
    pos = spark.createDataFrame([("a", D(2020, 1, 1), 10.0, 5.5), ("a", D(2020, 1, 2), 6.0, 6.5)], "code string, trade_date date, quantity double, mark double")
    r = P.reconcile(fills, pos, "code", 100.0).orderBy("trade_date").collect()
    assert all(abs(x.residual) < 1e-9 for x in r) and abs(r[1].cash - (100 - 50.1 + 23.9)) < 1e-9
    assert (r[0].entry_pnl, r[1].continuation_pnl, r[1].exit_pnl) == (5.0, 6.0, 2.0)


def test_ledger_with_settlement(spark):
    fills = spark.createDataFrame([("a", D(2020, 1, 1), 10.0, 5.0, 0.0), ("b", D(2020, 1, 1), 2.0, 8.0, 0.0)], "code string, trade_date date, quantity double, price double, fee double")
    pos = spark.createDataFrame([("a", D(2020, 1, 1), 10.0, 5.5), ("a", D(2020, 1, 2), 0.0, 5.5), ("b", D(2020, 1, 1), 2.0, 8.0), ("b", D(2020, 1, 2), 2.0, 8.5)], "code string, trade_date date, quantity double, mark double")
    paid = spark.createDataFrame([("a", D(2020, 1, 2), D(2020, 1, 4), 10.0, 60.0)], "code string, trade_date date, paid_date date, quantity double, amount double")
    r = P.reconcile(fills, pos, "code", 100.0, paid).orderBy("trade_date").collect()
    assert [(x.receivable, x.settlement_pnl) for x in r] == [(0.0, 0.0), (60.0, 5.0), (0.0, 0.0)] and all(abs(x.residual) < 1e-9 for x in r[:2])
    nav = P.reconcile(fills, pos, "code", 100.0, paid).where("trade_date < date'2020-01-04'").withColumn("traded", F.lit(10.0)).withColumn("b", F.lit(1))
    orders = spark.createDataFrame([(1, "buy", True), (1, "buy", False), (1, "sell", True)], "b int, side string, filled boolean")
    s = P.ledger_summary(nav, orders, ["b"], 100.0).first()
    assert (s.blocked_buys, s.filled_buys, s.filled_sells, s.blocked_sells) == (1, 1, 1, 0) and s.final_nav == 34.0 + 17.0 + 60.0


def test_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert {(r.k, r.side) for r in key_difference(a, b, ["k"]).collect()} == {(3, "missing"), (1, "extra")}
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(b, ["k"])
    with pytest.raises(KeyError):
        require_columns(a, ["x"])
    with pytest.raises(ValueError, match="future"):
        forbid_columns(a.withColumn("forward_return", F.lit(1.0)))
    assert fingerprint(b).collect() == fingerprint(b.orderBy(F.col("k").desc())).collect()
    x, y = run_identity("f", {"n": 1}, {"s": 1}), run_identity("g", {"n": 1}, {"s": 1})
    assert x[0] != y[0] and x[1] == y[1]


def test_registry(spark):
    r = default_registry()
    assert len(r.names()) == 7 and r.inventory(spark).count() == 7
    v = spark.createDataFrame([Row(signal_date=D(2020, 1, 1), code="a", close=110.0, conversion_premium=0.1)])
    key = v.select("signal_date", "code")
    out = r.calculate("double_low", FactorBundle(key, v)).first()
    assert out.raw_factor == 120.0 and out.available_date == D(2020, 1, 1)
    with pytest.raises(ValueError, match="registered"):
        r.register(FactorSpec("double_low", "x", 1, ()), lambda c, p: c)
    with pytest.raises(KeyError):
        r.spec("nothing")
    with pytest.raises(ValueError, match="unknown parameters"):
        r.calculate("double_low", FactorBundle(v, v), {"x": 1})
    with pytest.raises(KeyError, match="missing"):
        r.calculate("cb_return_20d", FactorBundle(key, v))
    with pytest.raises(KeyError, match="missing"):
        FactorBundle(v.select("code"), v)
    with pytest.raises(TypeError, match="not a date"):
        FactorBundle(key.withColumn("signal_date", F.lit("x")), v)
    assert {x.table: (x.null_keys, x.repeated_keys) for x in bundle_violations(FactorBundle(key.unionByName(key), v)).collect()} == {"signal": (0, 1), "valuation": (0, 0)}


def test_spread_factor_rules(spark):
    day = lambda i: D(2020, 1, 1) + dt.timedelta(i)
    bond = spark.createDataFrame([(day(i), c, 100.0 + i) for i in range(7) for c in ("a", "gap", "zero") if not (c == "gap" and i in (2, 3))] , "trade_date date, code string, close double")
    bond = bond.withColumn("close", F.when((F.col("code") == "zero") & (F.col("trade_date") == F.lit(day(1))), 0.0).otherwise(F.col("close")))
    stock = spark.createDataFrame([(day(i), "s", 10.0 + i, 2.0) for i in range(7)], "trade_date date, stock string, close double, adj_factor double")
    signal = spark.createDataFrame([(day(6), c, "s") for c in ("a", "gap", "zero", "none")] + [(day(3), "a", "s")], "signal_date date, code string, stock string")
    b = FactorBundle(signal, bond_daily=bond, stock_daily=stock)
    got = {(r.code, r.signal_date.day): r.raw_factor for r in default_registry().calculate("cb_stock_return_spread", b, {"window": 5}).collect()}
    assert abs(got["a", 7] - (106 / 101 - 16 / 11)) < 1e-12 and all(v is None for k, v in got.items() if k != ("a", 7)) and len(got) == 5
    long = default_registry().batch([("cb_stock_return_spread", {"window": 5}), ("cb_stock_return_spread", {})], b)
    assert {r.factor for r in long.collect()} == {"cb_stock_return_spread_window5", "cb_stock_return_spread"} and long.count() == 10


def test_large_group_ranks_and_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = [float(v) for v in np.concatenate([rng.normal(size=300).round(2), [0.0, -0.0, 1e-300, -1e300, 5e9], np.repeat(0.25, 50)])]
    d = spark.createDataFrame([("a", v) for v in x] + [("b", 1.0), ("b", None)], "g string, x double")
    order = np.argsort(x, kind="stable")
    rank = {v: np.mean([i + 1 for i, k in enumerate(order) if x[k] == v]) for v in x}
    r = global_rank(d, ["g"], "x", "r").collect()
    assert len(r) == len(x) + 1 and all(v.r == (rank[v.x] if v.g == "a" else 1.0) for v in r)
    points = (0.0, 0.1, 0.5, 0.777, 1.0)
    q = {(v.g, v.point): v.value for v in exact_quantiles(d, ["g"], "x", points).collect()}
    assert all(abs(q["a", p] - np.quantile(x, p)) <= 1e-12 * abs(np.quantile(x, p)) + 1e-12 for p in points) and q["b", 0.5] == 1.0
    assert exact_quantiles(d, [], "x", (0.5,)).first().value == np.median([*x, 1.0])


def test_merged_panels_need_equal_keys(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double"), spark.createDataFrame([(1, 5.0, 0.0), (2, 6.0, 0.0)], "k int, y double, x double")
    assert {tuple(r) for r in X.merge_panels([a, b], ["k"]).collect()} == {(1, 1.0, 5.0), (2, 2.0, 6.0)}
    with pytest.raises(Exception, match="different keys"):
        X.merge_panels([a, b.where("k = 1")], ["k"]).collect()
    with pytest.raises(Exception, match="repeats"):
        X.merge_panels([a, b.unionByName(b)], ["k"]).collect()


def test_controls_must_be_positive_and_past(spark):
    d = spark.createDataFrame([(1.0, D(2020, 1, 1), D(2021, 1, 1)), (0.0, D(2020, 1, 1), D(2019, 1, 1))], "x double, d date, m date")
    good = d.where("x > 0").select(log_size("x").alias("a"), remaining_years("m", "d").alias("b"), exchange_suffix(F.lit("123.SZ")).alias("c"), year_of("d").alias("y")).first()
    assert (good.a, good.b, good.c, good.y) == (0.0, 366 / 365.25, "SZ", 2020)
    for c in (log_size("x"), remaining_years("m", "d")):
        with pytest.raises(Exception, match="not positive|past"):
            d.select(c).collect()
    panel = spark.createDataFrame([("a", D(2020, 1, 5), "tech")], "k string, d date, industry string")
    caps = spark.createDataFrame([("a", D(2020, 1, 1), 10.0), ("a", D(2020, 1, 9), 20.0)], "k string, d date, market_cap double")
    r = X.attach_market_cap(panel, caps, "k", "d").first()
    assert abs(r.log_market_cap - math.log(10)) < 1e-12 and r.market_cap_age == 4 and r.industry_control == "tech"
    with pytest.raises(Exception, match="not positive"):
        X.attach_market_cap(panel, caps.withColumn("market_cap", F.lit(-1.0)), "k", "d").collect()


def test_slices_and_locks(spark):
    d = spark.createDataFrame([(D(2019, 1, 1),), (D(2020, 1, 1),), (D(2021, 1, 1),)], "d date")
    assert research_slice(d, "d", "2020-01-01", "2020-12-31").count() == 1
    assert research_slice(d, "d", "2020-01-01", "2020-12-31", history=True).count() == 2
    with pytest.raises(PermissionError):
        holdout_guard("holdout", False)
    holdout_guard("replication", False)


def test_scores_and_targets(spark):
    f = spark.createDataFrame([(D(2020, 1, 1), f"k{i}", float(i), D(2020, 1, 1)) for i in range(6)], "signal_date date, code string, raw_factor double, available_date date")
    c = f.select("signal_date", "code", (F.col("code") != "k0").alias("entry_allowed"), (F.col("code") == "k1").alias("exit_required"))
    t = P.top_targets(P.materialize_scores(c, f, -1), "code", n=2, cash=0.1, cap=0.3).orderBy("position").collect()
    assert [x.code for x in t] == ["k2", "k3"] and all(abs(x.target_weight - 0.3) < 1e-12 and abs(x.implied_cash - 0.4) < 1e-12 for x in t)
