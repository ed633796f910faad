"""Operators for hot keys, long windows and long histories, against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.functions.ranks import dealt_values, exact_quantiles, global_rank
from panelworks.operators import cross_section as X
from panelworks.operators import factors as T
from panelworks.operators import portfolio as P
from panelworks.operators.asof import asof_backward, asof_spread
from panelworks.operators.intervals import interval_join, interval_totals

DAY = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot", [None, 5])
def test_interval_join(spark, hot):
    rng = random.Random(2)
    points = [(i, rng.choice("ab"), rng.randrange(-40, 200)) for i in range(120)] + [(500, "a", None), (501, None, 3), (7, "a", 7), (7, "a", 7)] + [(600 + i, "a", 50) for i in range(30)]
    spans = [(i, rng.choice("ab"), s := rng.randrange(-50, 150), s + rng.randrange(-2, 90)) for i in range(60)] + [(900, "a", None, 5), (901, "b", 3, None), (902, None, 0, 9), (903, "a", -(10**9), 10**9), (904, "a", 5, 5)]
    p = spark.createDataFrame(points, "id int, k string, at int")
    s = spark.createDataFrame(spans, "id int, k string, start int, stop int")
    whole = interval_join(p, s, "at", "start", "stop", ["k"], hot)
    assert whole.columns == ["id", "k", "at", "id_interval", "start", "stop"]
    want = sorted((*a, b[0], b[2], b[3]) for a in points for b in spans if None not in (a[1], a[2], *b) and a[1] == b[1] and b[2] <= a[2] < b[3])
    assert sorted(tuple(r) for r in whole.collect()) == want
    free = interval_join(p.drop("k"), s.drop("k"), "at", "start", "stop", None, hot)
    assert free.count() == sum(1 for a in points for b in spans if None not in (a[2], b[2], b[3]) and b[2] <= a[2] < b[3])
    assert "NestedLoop" not in plan_of(whole) + plan_of(free) and "Cartesian" not in plan_of(free)
    assert interval_join(p, s.limit(0), "at", "start", "stop", ["k"], hot).count() == 0
    days = spark.createDataFrame([(DAY(i),) for i in range(0, 400, 7)], "d date")
    held = spark.createDataFrame([(DAY(3), DAY(150)), (DAY(100), DAY(101)), (dt.date(1960, 1, 1), DAY(8))], "a date, b date")
    assert interval_join(days, held, "d", "a", "b").count() == sum(1 for i in range(0, 400, 7) for a, b in ((3, 150), (100, 101), (-10**6, 8)) if a <= i < b)
    with pytest.raises(TypeError, match="dates or whole numbers"):
        interval_join(p.withColumn("at", F.lit("x")), s, "at", "start", "stop")


def most_rows(df):
    """The most rows that an operator of the plan made, when the rows have been taken."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = "plan" if kind.endswith("QueryStageExec") else {"AdaptiveSparkPlanExec": "executedPlan", "ReusedExchangeExec": "child"}.get(kind)
        rows = node.metrics().get("numOutputRows")
        yield rows.get().value() if rows.isDefined() else 0
        for child in [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]:
            yield from walk(child)

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_interval_totals(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randrange(-40, 200), rng.choice([None, 0.25, -3.5, 7.0])) for _ in range(300)] + [("a", None, 1.0), (None, 3, 1.0), ("c", 9, None), ("c", 9, None)]
    spans = [(i, rng.choice("ab"), s := rng.randrange(-50, 150), s + rng.randrange(-2, 90)) for i in range(60)] * 2 + [(900, "a", None, 5), (901, "b", 3, None), (902, None, 0, 9), (903, "a", -(10**9), 10**9), (904, "a", 5, 5), (905, "c", 8, 10), (906, "c", 500, 600)]
    p = spark.createDataFrame(points, "k string, at int, x double")
    s = spark.createDataFrame(spans, "id int, k string, start int, stop int")

    def want(keyed):
        for i, k, a, b in spans:
            x = [v for c, t, v in points if None not in (t, a, b) and (not keyed or (c is not None and c == k)) and a <= t < b]
            if x:
                y = [v for v in x if v is not None]
                yield (i, k, a, b, len(x), sum(y) if y else None)

    got = interval_totals(p, s, "at", "start", "stop", ["k"], "n", {"total": "x"})
    assert got.columns == ["id", "k", "start", "stop", "n", "total"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want(True), key=str)
    free = interval_totals(p.drop("k"), s, "at", "start", "stop", sums={"total": "x"})
    assert sorted(map(tuple, free.collect()), key=str) == sorted(want(False), key=str)
    assert interval_totals(p, s.limit(0), "at", "start", "stop", ["k"]).count() == interval_totals(p.limit(0), s, "at", "start", "stop", ["k"]).count() == 0
    with pytest.raises(TypeError, match="dates or whole numbers"):
        interval_totals(p.withColumn("at", F.lit("x")), s, "at", "start", "stop")


def test_orders_in_reach_makes_no_pairs(spark, tmp_path):
    """2,000 orders of a region in three days, a fifth of which start an interval: no step makes a row for each pair, and odd orders count as in the SQL."""
    import duckdb

    from panelworks.plans.event_queries import QUERIES

    day = lambda i: dt.datetime(2020, 2, 27) + dt.timedelta(i)
    rows = [(i, 10 * i, day(i % 3), i / 4) for i in range(2000)] + [(-5, 10, day(0), 1.0), (10, 10, day(2), 2.0), (10, 10, day(2), 2.0), (15, None, day(1), 1.0), (20, 3, None, 1.0), (25, 3, day(0), None), (None, 3, day(0), 5.0), (35, 4, day(0), None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    query, sql = QUERIES["orders_in_reach"]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = c.execute(sql).fetchall()
    d = query(spark, str(tmp_path))
    assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 400_000 and 400 <= most_rows(d) <= 2 * len(rows)


def test_ranks_of_any_distribution(spark):
    inf = math.inf
    x = [-inf, -inf, inf, 0.0, 1e300, -1e300, 5e-324, 2.0, 2.0]
    d = spark.createDataFrame([("a", v) for v in x] + [("a", math.nan), ("a", None), (None, 1.0), ("b", math.nan)], "g string, x double")
    r = global_rank(d, ["g"], "x", "r").collect()
    rank = pd.Series(x).rank()
    assert sorted((v.x, v.r) for v in r) == sorted(zip(x, rank, strict=True))
    q = {v.point: v.value for v in exact_quantiles(d, ["g"], "x", (0.0, 0.5, 1.0)).collect()}
    assert q == {0.0: -inf, 0.5: 5e-324, 1.0: inf}
    assert exact_quantiles(d.limit(0), ["g"], "x", (0.5,)).count() == 0
    near = spark.range(20000).select((F.col("id") / 20000 + 1e9).alias("x"), F.lit(1).alias("g"))
    pieces = dealt_values(near, ["g"], "x", {"_c": F.count("*")}, 16).groupBy("_piece").count().collect()
    assert len(pieces) >= 12 and max(p["count"] for p in pieces) < 4000
    assert abs(exact_quantiles(near, [], "x", (0.25,)).first().value - (1e9 + 0.25 * 19999 / 20000)) < 1e-6


def test_spearman_matrix_equals_pandas(spark):
    rng = np.random.default_rng(8)
    f = pd.DataFrame({"zz": rng.normal(size=300).round(1), "b": rng.normal(size=300).round(1), "c": rng.normal(size=300)})
    f["b"] += f["zz"]
    for c, share in (("zz", 0.2), ("b", 0.4), ("c", 0.1)):
        f.loc[rng.random(300) < share, c] = np.nan
    f["d"], f["e"] = 1.0, np.nan
    f.loc[0, "zz"], f.loc[1, "b"] = np.inf, -np.inf
    rows = [(i, *(None if v != v else float(v) for v in r)) for i, r in enumerate(f.itertuples(index=False))]
    d = spark.createDataFrame(rows, "k int, zz double, b double, c double, d double, e double").withColumn("c", F.coalesce("c", F.lit(math.nan)))
    matrix = X.spearman_matrix(d, ["k"], ["zz", "b", "c", "d", "e"])
    got = {(r.factor_a, r.factor_b): (r.n_pairs, r.correlation) for r in matrix.collect()}
    names = sorted(f.columns)
    for i, a in enumerate(names):
        for b in names[i:]:
            pair = f[[a, b]].dropna() if a != b else f[[a]].dropna()
            if len(pair) == 0:
                assert (a, b) not in got
                continue
            n, r = got[a, b]
            want = pair.iloc[:, 0].rank().corr(pair.iloc[:, -1].rank())
            assert n == len(pair) and (r is None) == (want != want) and (r is None or abs(r - want) < 1e-12)


def test_family_equals_least_squares(spark):
    """Three values with missing patterns of their own, on one set of controls; a control with a large offset."""
    rng = np.random.default_rng(5)
    rows = []
    for d in range(4):
        for i in range(60):
            y = [float(v) if rng.random() > 0.15 * k else None for k, v in enumerate(rng.normal(size=3))]
            rows.append((d, i, *y, float(rng.normal() + 1e6) if rng.random() > 0.1 else None, float(rng.normal()), "abcd"[i % 4] if rng.random() > 0.05 else None))
    rows += [(9, i, float(i), 1.0, None, 2.0, float(i), "a") for i in range(12)]  # a control that does not vary
    rows += [(8, i, float(rng.normal()), 1.0, 1.0, float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(12)] + [(8, 99, None, 1.0, 1.0, 0.5, 0.5, "z")]
    names = ["u", "v", "w"]
    d = spark.createDataFrame(rows, "d int, i int, winsorized__u double, winsorized__v double, winsorized__w double, p double, q double, c string")
    policies = [X.Policy("u", ("p", "q"), "c"), X.Policy("v", ("p", "q"), "c"), X.Policy("w", ("p",))]
    out = X.preprocess_family(d, "d", policies)
    got = {(r.d, r.i): r for r in out.collect()}
    assert len(got) == len(rows) and out.columns[: len(d.columns)] == d.columns
    for k, policy in enumerate(policies):
        for day in {r[0] for r in rows}:
            part = [r for r in rows if r[0] == day]
            used = [5, 6] if len(policy.numeric) == 2 else [5]
            ok = [r for r in part if r[2 + k] is not None and all(r[c] is not None for c in used) and (policy.category is None or r[7] is not None)]
            cats = sorted({r[7] for r in ok}) if policy.category else []
            lone = policy.category is not None and {r[7] for r in part if r[7] is not None} != set(cats)
            a = np.array([[1.0, *(r[c] - (1e6 if c == 5 else 0) for c in used), *(r[7] == x for x in cats[1:])] for r in ok], float).reshape(len(ok), 1 + len(used) + max(0, len(cats) - 1))
            y = np.array([r[2 + k] for r in ok])
            good = len(ok) > a.shape[1] and np.linalg.matrix_rank(a) == a.shape[1] and not lone
            residual = dict(zip([r[1] for r in ok], y - a @ np.linalg.lstsq(a, y, rcond=None)[0], strict=True)) if good else {}
            std = np.std(list(residual.values())) if residual else 0
            for r in part:
                n, z = got[day, r[1]][f"neutralized__{names[k]}"], got[day, r[1]][f"standardized__{names[k]}"]
                if r[1] in residual:
                    assert abs(n - residual[r[1]]) < 1e-8 and abs(z - (residual[r[1]] / std if std > 1e-8 else 0)) < 1e-6
                else:
                    assert n is None and z is None
    assert "Window" not in plan_of(out.select("standardized__u")).split("== Physical Plan ==")[1].split("Exchange")[0]


def test_family_matches_single_fits(spark):
    rng = np.random.default_rng(6)
    rows = [(d, i, *map(float, rng.normal(size=3)), "abc"[i % 3]) for d in range(3) for i in range(40)]
    d = spark.createDataFrame(rows, "d int, i int, winsorized__u double, p double, q double, c string")
    one = {(r.d, r.i): r.neutralized__winsorized__u for r in X.neutralize(d, "winsorized__u", ["d"], ["p", "q"], "c").collect()}
    family = {(r.d, r.i): r.neutralized__u for r in X.preprocess_family(d, "d", [X.Policy("u", ("p", "q"), "c")]).collect()}
    assert all(abs(one[k] - family[k]) < 1e-12 for k in one)


def test_asof_of_a_hot_key(spark):
    rng = random.Random(9)
    panel = [(i, "hot" if i % 2 else f"k{i % 7}", DAY(rng.randrange(300))) for i in range(600)] + [(1000, None, DAY(3)), (1001, "hot", None), (1002, "none", DAY(5)), (1003, "hot", DAY(0) - dt.timedelta(9))]
    events = [("hot", DAY(i), None if i % 5 == 0 else f"s{i}") for i in range(0, 300, 3)] + [(f"k{j}", DAY(40 * j), f"t{j}") for j in range(7)] + [("hot", None, "x"), (None, DAY(1), "y")]
    p, e = spark.createDataFrame(panel, "i int, k string, d date"), spark.createDataFrame(events, "k string, eff date, s string")
    want = sorted(asof_backward(p, e, "k", "d", "eff", ["s"], "since").collect(), key=str)
    got = asof_spread(p, e, "k", "d", "eff", ["s"], "since", pieces=12)
    assert sorted(got.collect(), key=str) == want and got.columns == ["i", "k", "d", "s", "since"]
    assert asof_spread(p.limit(0), e, "k", "d", "eff", ["s"]).count() == 0
    none = asof_spread(p, e.limit(0), "k", "d", "eff", ["s"])
    assert none.count() == len(panel) and none.where("s is not null").count() == 0


def test_beta_over_long_windows(spark):
    rng = np.random.default_rng(11)
    rows = []
    for code in ("a", "b"):
        for i in range(200):
            if rng.random() < 0.85:
                x = 0.01 if code == "b" and 60 < i < 150 else float(rng.normal() * 0.02)
                rows.append((code, i, None if rng.random() < 0.1 else 0.5 * x + float(rng.normal() * 0.01), x if rng.random() > 0.05 else None, 1))
    d = spark.createDataFrame(rows, "code string, cal_idx int, bond_return double, stock_return double, _block int").drop("_block")
    out = T.beta_correlation(d, "code")
    assert out.columns == [*d.columns, "beta_20d", "correlation_20d", "beta_60d", "correlation_60d"]
    got = {(r.code, r.cal_idx): r for r in out.collect()}
    assert len(got) == len(rows)
    for code, i, *_ in rows:
        for n in (20, 60):
            w = [(r[2], r[3]) for r in rows if r[0] == code and i - n < r[1] <= i and r[2] is not None and r[3] is not None]
            beta = got[code, i][f"beta_{n}d"]
            if len(w) < math.ceil(0.8 * n) or len({x for _, x in w}) == 1:
                assert beta is None
                continue
            y, x = np.array(w).T
            assert abs(beta - np.cov(x, y, ddof=0)[0, 1] / x.var()) < 1e-8
            assert abs(got[code, i][f"correlation_{n}d"] - np.corrcoef(x, y)[0, 1]) < 1e-8


def scores(spark, days, names=12, seed=3):
    rng = random.Random(seed)
    rows = [(DAY(7 * t), f"n{k:02}", rng.random(), rng.random() > 0.2, rng.random() > 0.9) for t in range(days) for k in range(names)]
    return [(d, c, s, a and t % 9 != 4, e) for t, (d, c, s, a, e) in ((((r[0] - DAY(0)).days // 7), r) for r in rows)]


def test_appended_dates_extend_a_buffer(spark):
    schema = "signal_date date, code string, processed_factor double, entry_allowed boolean, exit_required boolean"
    rows = scores(spark, 30)
    d = spark.createDataFrame(rows, schema)
    plain = lambda b: sorted(tuple(r) for r in b.collect())
    full = plain(P.buffered(d, "code", 3, (3, 5, 8)))
    held = {}
    for rank in (3, 5, 8):  # a plain version of the recursion
        slots = [None] * 3
        for day in sorted({r[0] for r in rows}):
            order = [r[1] for r in sorted((r for r in rows if r[0] == day and r[3] and not r[4]), key=lambda r: (-r[2], r[1]))][:rank]
            kept = [s if s in order else None for s in slots]
            rest = [c for c in order if c not in kept]
            slots = [s if s is not None else (rest.pop(0) if rest else None) for s in kept]
            held[rank, day] = [(i + 1, c, kept[i] is not None) for i, c in enumerate(slots) if c is not None]
    assert [(r[0], r[1], *r[2:5]) for r in full] == sorted((k[0], k[1], *x) for k, v in held.items() for x in v)
    for cut in (1, 4, 5, 13):  # date 4 has no candidates: the snapshot is empty
        old = P.buffered(d.where(F.col("signal_date") < DAY(7 * cut)), "code", 3, (3, 5, 8))
        start = P.book_snapshot(old, "code", str(DAY(7 * (cut - 1))))
        new = P.buffered(d.where(F.col("signal_date") >= DAY(7 * cut)), "code", 3, (3, 5, 8), start=start)
        assert sorted(plain(old) + plain(new)) == full
    assert P.buffered(d.limit(0), "code", 3, (3,)).count() == 0


def test_appended_signals_extend_cohorts(spark):
    schema = "signal_date date, code string, processed_factor double, entry_allowed boolean, exit_required boolean"
    d = spark.createDataFrame(scores(spark, 24), schema)
    plan = spark.createDataFrame([(DAY(7 * t), DAY(7 * t + 1), DAY(7 * t + 1 + 7 * (2 + t % 3))) for t in range(24)], "signal_date date, entry_date date, exit_date date")
    plain = lambda x: sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in x.collect())
    full = P.cohort_book(d, plan, "code", 4, 0.1, 0.1)
    first = P.cohort_book(d, plan.where(F.col("signal_date") < DAY(70)), "code", 4, 0.1, 0.1)
    then = P.cohort_book(d, plan.where(F.col("signal_date") >= DAY(70)), "code", 4, 0.1, 0.1, before=first)
    assert plain(first.headers) + plain(then.headers) == plain(full.headers)
    assert plain(first.parts.unionByName(then.parts)) == plain(full.parts)
    assert {r.status for r in full.headers.collect()} >= {"allocated", "skipped_no_candidates"}
    parts = [tuple(r) for r in full.parts.collect()]
    want = {}
    for day in {p[1] for p in parts} | {p[2] for p in parts}:
        active = [p for p in parts if p[1] <= day < p[2]]
        for c in {p[0] for p in active}:
            own = [p[3] for p in active if p[0] == c]
            want[day, c] = (len(own), sum(own))
        if not active:
            want |= {(day, p[0]): (0, 0.0) for p in parts if p[2] == day}
    got = {(r.execution_date, r.code): (r.n_cohorts, r.target_weight) for r in P.cohort_snapshots(full.parts, "code").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert any(v == (0, 0.0) for v in want.values())


def test_bars_take_the_first_of_tied_lines(spark, tmp_path):
    """Of lines that are equal in the SQL's order the first of the file counts; the aggregation is by hash, so nothing is sorted for it."""
    from panelworks.plans.panels import market

    day = dt.datetime(1998, 5, 18)
    rows = [(7, 1, 2, 1.0, 30.0, day), (7, 1, 2, 1.0, 10.0, day), (7, 1, 2, 1.0, 20.0, day), (5, 2, 1, 1.0, 6.0, day), (10**13 - 1, 2, 99, 1.0, 4.0, day), (4, 2, 0, 2.0, 10.0, day + dt.timedelta(microseconds=1)), (9, 2, 0, 0.0, 1.0, day)]
    names = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = market(spark, str(tmp_path))
    assert {r.code: (r.open, r.high, r.low, r.close, r.vol) for r in d.collect()} == {1: (30.0, 30.0, 10.0, 30.0, 3.0), 2: (6.0, 6.0, 4.0, 5.0, 4.0)}
    assert "SortAggregate" not in plan_of(d)
    spark.createDataFrame([(10**13, 1, 2, 1.0, 30.0, day)], names).write.parquet(f"{tmp_path}/far/lineitem.parquet")
    with pytest.raises(Exception, match="out of range"):
        market(spark, f"{tmp_path}/far").collect()


def test_tied_lines_of_several_files(spark, tmp_path):
    """Of tied lines in several files that of the first file counts, wherever it lies there, in the bars of suppliers and of nations."""
    from panelworks.plans.panels import market, stocks

    day = dt.datetime(1998, 5, 18)
    tied = lambda price, supplier=1: (7, supplier, 2, 1.0, price, day)
    files = [[(1, 9, 1, 1.0, 5.0, day)] * 3, [(1, 9, 1, 1.0, 5.0, day), (1, 9, 1, 0.0, 5.0, day), tied(30.0), tied(40.0)], [tied(10.0)], [tied(20.0, 2), tied(50.0)]]
    names = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/file {i}")
        (part,) = (tmp_path / f"file {i}").glob("*.parquet")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        part.rename(tmp_path / "lineitem.parquet" / f"{i} + %.parquet")
    spark.createDataFrame([(1, 3), (2, 3), (9, 4)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r.code: (r.open, r.close, r.vol) for r in market(spark, str(tmp_path)).collect()} == {1: (30.0, 30.0, 4.0), 2: (20.0, 20.0, 1.0), 9: (5.0, 5.0, 4.0)}
    assert {r.code: (r.open, r.close, r.vol) for r in stocks(spark, str(tmp_path)).collect()} == {3: (30.0, 30.0, 5.0), 4: (5.0, 5.0, 4.0)}


def test_return_spread_of_lines_tied_over_files(spark, tmp_path):
    """Each tenth line has a tied one at another price behind many rows of an earlier file: the spread is that of the SQL on one thread."""
    import duckdb

    from panelworks.plans.factor_queries import QUERIES

    c, sf = duckdb.connect(config={"threads": 1}), "/root/testdata/sf0.001"
    (tmp_path / "lineitem.parquet").mkdir()
    c.execute(f"CREATE VIEW given AS SELECT * FROM '{sf}/lineitem.parquet'")
    c.execute(f"COPY (SELECT * REPLACE (0.0 AS l_quantity) FROM given UNION ALL SELECT * REPLACE (l_extendedprice * 2 AS l_extendedprice) FROM given WHERE l_orderkey % 10 = 0) TO '{tmp_path}/lineitem.parquet/a.parquet' (FORMAT parquet)")
    c.execute(f"COPY given TO '{tmp_path}/lineitem.parquet/b.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * REPLACE (CAST(s_suppkey % 2 AS INTEGER) AS s_nationkey) FROM '{sf}/supplier.parquet') TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    query, sql = QUERIES["return_spread"]
    want = sorted(c.execute(sql).fetchall(), key=str)
    got = sorted((tuple(r) for r in query(spark, str(tmp_path)).collect()), key=str)
    assert got == want and sum(bool(r[2]) for r in want) > 100


def test_winsorized_panel_is_moved_once(spark):
    rng = random.Random(9)
    rows = [(i, DAY(i % 3), rng.choice([None, rng.gauss(0, 1), 50.0]), 1.0 if i % 3 else rng.random(), i % 4) for i in range(90)]
    d = spark.createDataFrame(rows, "code int, day date, a double, b double, g int")
    got = X.winsorize_panel(d, ["code", "day"], "day", ["a", "b"], keep=("g", "a"))
    assert got.columns == ["code", "day", "g", "a", "winsorized__a", "winsorized__b"]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = X.winsorize_mad(X.winsorize_mad(d, "a", ["day"]), "b", ["day"]).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_dealt_pieces_are_not_merged(spark):
    from panelworks.functions.stats import PIECES
    from panelworks.operators.evaluation import ic_series

    rows = [(h, DAY(i), float(k * i % 7), float(k)) for h in (1, 5) for i in range(40) for k in range(6)]
    d = ic_series(spark.createDataFrame(rows, "h int, day date, processed_factor double, forward_return double"), ["h", "day"])
    assert d.count() == 80 and d.rdd.getNumPartitions() == PIECES


def test_stored_tables_are_made_in_pieces_that_compressed_size_does_not_merge(spark):
    """Rows that compress to little are still many tasks' work, and the session keeps its settings."""
    from panelworks.sources.folders import MERGED, stored

    before = {k: spark.conf.get(k, None) for k in MERGED}
    d = spark.range(6_000_000).select((F.col("id") % 997).alias("g"), (F.xxhash64("id") % 1000).alias("x"))
    made = stored(d.repartition("g").withColumn("_task", F.spark_partition_id()), "pieces")
    assert made.select("_task").distinct().count() > 2 * spark.sparkContext.defaultParallelism
    assert {k: spark.conf.get(k, None) for k in MERGED} == before


def test_bars_of_a_supplier_are_made_where_its_lines_are(spark):
    """One shuffle of lines serves the bars and the changes, and no partial aggregate runs in a scan."""
    from panelworks.plans.panels import market

    plan = market(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    executed = market(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in plan and executed.count("Exchange hashpartitioning(l_suppkey") == 1 and "hashpartitioning(code" not in executed


def test_labels_from_bars_are_those_from_the_grid(spark):
    """No grid of all keys and days is made for labels, and they are the same."""
    from panelworks.operators import execution as M
    from panelworks.operators.calendar import horizon_schedules
    from panelworks.plans.evidence_queries import Study, grid, labels

    st = Study(spark, "/root/testdata/sf0.001")
    sig = st.cal.select(F.col("trade_date").alias("signal_date"))
    keys = st.bars.select("code", F.col("trade_date").alias("signal_date"))
    by_grid = M.forward_returns(keys, horizon_schedules(sig, st.cal, [1, 5, 10], "2001-06-30"), grid(st), "code")
    made = labels(st)
    assert made.count() == by_grid.count() and made.exceptAll(by_grid).isEmpty()
    loops = lambda d: d._jdf.queryExecution().executedPlan().toString().count("NestedLoopJoin")
    assert loops(made) < loops(by_grid)


def test_factors_of_the_valuation_join_it_once(spark):
    from panelworks.operators.registry import default_registry
    from panelworks.plans.evidence_queries import RUNS, Study, bundle

    b = bundle(Study(spark, "/root/testdata/sf0.001"))
    plan = default_registry().batch(RUNS[:6], b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


def test_rank_correlations_of_mad_sensitivity_are_stored(spark):
    """The report only reads them: no ranks of dates are left to its own plan, whose shuffles Spark merges."""
    d = spark.range(400).select(F.col("id").alias("code"), F.expr("date'2001-01-01' + cast(id % 4 as int)").alias("day"), F.rand(1).alias("f"))
    plan = X.mad_sensitivity(d, ["code", "day"], "day", ["f"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan


def test_horizon_summary_counts_labels_in_its_evidence(spark, monkeypatch):
    """Labels are made once, along with the scores, where a supplier's bars are; the plan that is left reads no bars."""
    from panelworks.plans import evidence_queries as Q

    names, kept = [], Q.stored
    monkeypatch.setattr(Q, "stored", lambda df, name: (names.append(name), kept(df, name))[1])
    st = Q.Study(spark, "/root/testdata/sf0.001")
    made = Q.scored_labels(st)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in made and made.count("hashpartitioning(code") == 1
    d = Q.horizon_summary(st)
    assert names.count("evidence") == 1 and not [f for f in d.inputFiles() if "lineitem" in f or "/bars-" in f]
    want = {r.horizon_days: (r["count(1)"], r.usable) for r in Q.labels(st).groupBy("horizon_days").agg(F.count("*"), F.count_if("label_usable").alias("usable")).collect()}
    assert {r.horizon_days: (r.label_rows, r.usable_rows) for r in d.collect()} == want and len(want) == 3


def test_labels_ahead_of_gaps_and_null_keys(spark):
    from panelworks.operators import execution as M
    from panelworks.operators.calendar import calendar, horizon_schedules

    rows = [(k, DAY(i), 10.0 + i, i != 4, i != 6, i) for k in ("a", "b", None) for i in range(9) if (k, i) not in (("b", 2), ("b", 6))] + [("c", DAY(0), 1.0, True, True, 0), ("c", DAY(1), 0.0, True, True, 1)]
    bars = spark.createDataFrame(rows, "code string, trade_date date, open double, buy_allowed boolean, sell_allowed boolean, cal_idx int")
    cal = calendar(bars)
    schedule = horizon_schedules(cal.select(F.col("trade_date").alias("signal_date")), cal, [1, 3], str(DAY(7)))
    want = M.forward_returns(bars.select("code", F.col("trade_date").alias("signal_date")), schedule, bars, "code")
    made = M.labels_ahead(M.priced_ahead(bars, "code", [1, 3]).select("code", F.col("trade_date").alias("signal_date"), *M.ahead_columns([1, 3])), schedule, [1, 3])
    assert made.columns == want.columns and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    assert {r.label_reason for r in made.collect()} == {"partition_boundary", "missing_entry", "invalid_entry", "entry_not_buyable", "missing_exit", "exit_not_sellable", "usable"}


def test_horizon_returns_read_their_groups_once(spark):
    from panelworks.operators import evaluation as E

    d = spark.createDataFrame([(h, i, float(i), i / 10) for h in (1, 2) for i in range(7)], "h int, code int, processed_factor double, forward_return double")
    r = E.horizon_ir(d, ["h"], "code")
    assert "Join" not in r._jdf.queryExecution().executedPlan().toString()
    assert [(v.h, round(v.G1, 9), round(v.universe, 9), round(v.active, 9)) for v in r.orderBy("h").collect()] == [(1, 0.55, 0.3, 0.25), (2, 0.55, 0.3, 0.25)]
    assert "universe" not in E.quantile_returns(E.quantile_groups(d, ["h"], "code"), ["h"]).columns


def test_stored_tables_read_files_in_small_splits(spark):
    from panelworks.sources.folders import small_pieces

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with small_pieces(spark):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
