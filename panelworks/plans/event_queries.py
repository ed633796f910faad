"""Calendars, events, universe and valuation over the test tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import universe as U
from ..operators import valuation as V
from ..operators.asof import asof_backward, asof_spread
from ..functions import expressions as X
from ..operators.calendar import execution_schedule, horizon_schedules, month_windows, next_open, partition_schedule
from ..operators.checks import fingerprint, forbid_columns, holdout_guard, key_difference, research_slice
from ..operators.intervals import interval_totals
from ..sources.folders import stored
from .panels import BARS, SIGNALS, line_pieces, lines, market, read, register, repeated, rounded, signals, tidy, week, weeks

QUERIES: dict = {}


query = partial(register, QUERIES)


GRADES = {"1-URGENT": "AAA", "2-HIGH": "AA", "3-MEDIUM": "A", "4-NOT SPECIFIED": "BBB", "5-LOW": "BB"}


@query("calendar_next_open", f"""WITH {BARS}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, (SELECT min(trade_date) FROM cal WHERE trade_date > day) AS next_open, (SELECT min(trade_date) FROM cal WHERE trade_date >= day) AS same_or_next FROM d""")
def calendar_next_open(spark: SparkSession, sf: str) -> DataFrame:
    cal = weeks(spark, sf)
    d = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return next_open(next_open(d, "day", cal, "next_open"), "day", cal, "same_or_next", inclusive=True)


@query("rebalance_calendar", f"WITH {BARS}, {SIGNALS} SELECT * FROM signals")
def rebalance(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(signals(spark, sf), "anchor_date", "signal_date", "entry_date", "holiday_shift_days", "next_signal_date", "next_entry_date")


@query("partition_schedule", f"""WITH {BARS}, {SIGNALS}
SELECT signal_date, entry_date, next_entry_date AS exit_date, coalesce(entry_date > signal_date AND next_entry_date <= DATE '1999-12-31', false) AS is_label_within_partition,
  CASE WHEN coalesce(entry_date > signal_date AND next_entry_date <= DATE '1999-12-31', false) THEN 'eligible' ELSE 'partition_boundary' END AS schedule_reason
FROM signals WHERE signal_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def partition(spark: SparkSession, sf: str) -> DataFrame:
    return partition_schedule(signals(spark, sf), "1996-01-01", "1999-12-31")


@query("execution_schedule", f"""WITH {BARS}, {SIGNALS}, s AS (SELECT signal_date, entry_date, lead(entry_date) OVER (ORDER BY signal_date) AS exit_date FROM signals)
SELECT * FROM s WHERE entry_date IS NOT NULL AND exit_date IS NOT NULL""")
def exec_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return execution_schedule(signals(spark, sf), weeks(spark, sf)).select("signal_date", "entry_date", "exit_date")


HORIZONS = [1, 5, 10]
HORIZON_SQL = """
hs AS (SELECT s.signal_date, CAST(h.h AS BIGINT) AS horizon_days, s.entry_date, c2.trade_date AS exit_date,
    coalesce(s.entry_date > s.signal_date AND c2.trade_date <= DATE '9999-12-31', false) AS is_label_within_partition
  FROM signals s CROSS JOIN (SELECT unnest([1, 5, 10]) AS h) h LEFT JOIN cal c1 ON c1.trade_date = s.entry_date LEFT JOIN cal c2 ON c2.cal_idx = c1.cal_idx + h.h)"""


@query("horizon_schedule", f"WITH {BARS}, {SIGNALS}, {HORIZON_SQL} SELECT * FROM hs")
def horizon_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(horizon_schedules(signals(spark, sf), weeks(spark, sf), HORIZONS))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    grade = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])[F.col("o_orderpriority")]
    h = read(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("announced"), grade.alias("grade"))
    return U.rating_events(h, weeks(spark, sf), "code", "announced", "grade")


def shares(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    h = read(spark, sf, "orders").select(F.col("o_custkey").alias("code"), day.alias("published"), day.alias("period_end"), F.col("o_totalprice").alias("remain_size"), (F.col("o_totalprice") / 1000).alias("convert_price"))
    return U.share_events(h, weeks(spark, sf), "code", "published", "period_end", ["remain_size", "convert_price"])


_GRADE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GRADES.items()) + " END"
_SCORE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 19 WHEN '2-HIGH' THEN 17 WHEN '3-MEDIUM' THEN 14 WHEN '4-NOT SPECIFIED' THEN 11 WHEN '5-LOW' THEN 8 END"
EVENTS_SQL = f"""
od AS (SELECT o.*, CAST(o_orderdate AS DATE) AS day FROM orders o),
eff AS (SELECT day, (SELECT min(trade_date) FROM cal WHERE trade_date > day) AS effective_date FROM (SELECT DISTINCT day FROM od)),
ratings AS (SELECT o_custkey AS code, effective_date, {_GRADE_SQL} AS rating, CAST({_SCORE_SQL} AS BIGINT) AS rating_score
  FROM od JOIN eff USING (day) WHERE effective_date IS NOT NULL AND {_SCORE_SQL} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o_custkey, effective_date ORDER BY {_SCORE_SQL}, day) = 1),
shares AS (SELECT o_custkey AS code, effective_date, o_totalprice AS remain_size, o_totalprice / 1000 AS convert_price
  FROM od JOIN eff USING (day) WHERE effective_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o_custkey, effective_date ORDER BY day DESC, o_totalprice DESC) = 1)"""


@query("rating_events", f"WITH {BARS}, {EVENTS_SQL} SELECT * FROM ratings")
def rating_query(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(ratings(spark, sf))


@query("share_events", f"WITH {BARS}, {EVENTS_SQL} SELECT code, effective_date, round(remain_size, 6) AS remain_size, round(convert_price, 6) AS convert_price FROM shares")
def share_query(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(shares(spark, sf))


@query("asof_event_state", f"""WITH {BARS}, {SIGNALS}, {EVENTS_SQL}
SELECT p.code, p.signal_date, r.rating, r.rating_score, r.effective_date AS rating_date
FROM (SELECT c_custkey AS code, signal_date FROM customer CROSS JOIN signals) p ASOF LEFT JOIN ratings r ON p.code = r.code AND p.signal_date >= r.effective_date""")
def asof_query(spark: SparkSession, sf: str) -> DataFrame:
    panel = read(spark, sf, "customer").select(F.col("c_custkey").alias("code")).crossJoin(F.broadcast(signals(spark, sf).select("signal_date")))
    return tidy(asof_backward(panel, ratings(spark, sf), "code", "signal_date", "effective_date", ["rating", "rating_score"], "rating_date"))


HOT_SQL = """
ev AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_custkey END AS code, CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_custkey END, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1),
ln AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_suppkey END AS code, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""


@query("asof_hot_key", f"WITH {HOT_SQL} SELECT l_orderkey, l_linenumber, ln.code, o_orderpriority AS state, round(o_totalprice, 6) AS size, ev.day AS state_date FROM ln ASOF LEFT JOIN ev ON ln.code = ev.code AND ln.day >= ev.day")
def asof_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """As-of states of shipments where one code has half of all orders and shipments."""
    merged = lambda c: F.when(F.col(c) % 2 == 0, F.lit(0)).otherwise(F.col(c)).alias("code")
    o = read(spark, sf, "orders").groupBy(merged("o_custkey"), F.col("o_orderdate").cast("date").alias("day")).agg(F.max_by(F.struct(F.col("o_orderpriority").alias("state"), F.col("o_totalprice").alias("size")), "o_orderkey").alias("s"))
    shipped = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", merged("l_suppkey"), F.col("l_shipdate").cast("date").alias("day"))
    d = asof_spread(shipped, o.select("code", F.col("day").alias("effective"), "s.state", "s.size"), "code", "day", "effective", ["state", "size"], "state_date")
    return tidy(d.drop("day"))


@query("orders_in_reach", """WITH o AS (SELECT o_orderkey, o_custkey % 10 AS region, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders),
i AS (SELECT o_orderkey AS anchor, region, day AS start, day + 1 + CAST(o_orderkey % 30 AS INTEGER) AS stop FROM o WHERE o_orderkey % 5 = 0)
SELECT anchor, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM i JOIN o ON o.region = i.region AND o.day >= i.start AND o.day < i.stop GROUP BY 1""")
def orders_in_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a group of customers within the 1 to 30 days that each fifth order starts: intervals that overlap, by key. No row is made for an order in
    an interval, of which there are as many as the square of the orders."""
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("region"), F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    i = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("anchor"), "region", F.col("day").alias("start"), F.date_add("day", (F.col("o_orderkey") % 30 + 1).cast("int")).alias("stop"))
    d = interval_totals(o, i, "day", "start", "stop", ["region"], "n_orders", {"total": "o_totalprice"}).groupBy("anchor").agg(F.sum("n_orders").alias("n_orders"), F.sum("total").alias("total"))
    return d.select("anchor", "n_orders", rounded("total", 2).alias("total"))


@query("attached_industry", f"""WITH {BARS}, {SIGNALS}, mb AS (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey AS code, c_mktsegment AS g FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT CAST(o_orderdate AS DATE), o_custkey, 'MIXED' FROM orders WHERE o_orderkey % 7 = 0),
rs AS (SELECT d, code, CASE WHEN count(*) = 1 THEN any_value(g) END AS industry, count(*) > 1 AS is_ambiguous, string_agg(g, '|' ORDER BY g) AS candidates FROM mb GROUP BY ALL)
SELECT c_custkey AS code, signal_date, industry, is_ambiguous, candidates FROM customer CROSS JOIN signals LEFT JOIN rs ON rs.code = c_custkey AND rs.d = signal_date""")
def attached_industry(spark: SparkSession, sf: str) -> DataFrame:
    """Industries of the exact signal date on a panel of all customers; a date without a membership stays empty."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("signal_date"), "o_orderkey")
    segments = read(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("industry"))
    named = o.join(segments, "code").select("signal_date", "code", "industry").unionByName(o.where("o_orderkey % 7 = 0").select("signal_date", "code", F.lit("MIXED").alias("industry")))
    panel = segments.select("code").crossJoin(F.broadcast(signals(spark, sf).select("signal_date")))
    return U.attach_snapshot(panel, U.resolve_membership(named, ["signal_date", "code"]), ["signal_date", "code"]).select("code", "signal_date", "industry", "is_ambiguous", "candidates")


#: Orders in a piece of the universe.
PIECE_ORDERS = 50_000


def universe(spark: SparkSession, sf: str, rated: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """The universe of customers; its events are made here unless they are given."""
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("day"))
    pieces = max(spark.sparkContext.defaultParallelism, orders.count() // PIECE_ORDERS)
    first = orders.groupBy("code").agg(F.min("day").alias("list_date"))
    reference = read(spark, sf, "customer").select(F.col("c_custkey").alias("code"), (F.col("c_acctbal") * 100).alias("issue_size"), F.col("c_acctbal").alias("first_price")).join(first, "code")
    daily = orders.groupBy("code", F.trunc("day", "week").alias("trade_date")).agg(F.count("*").cast("double").alias("vol"))
    events = rated if rated is not None else ratings(spark, sf), shared if shared is not None else shares(spark, sf)
    return U.universe_panel(signals(spark, sf), reference, daily, weeks(spark, sf), *events, "code", minimum_age=11, maximum_turnover=0.5, minimum_size=50_000.0, minimum_rating=11, volume_scale=10_000.0, pieces=pieces)


UNIVERSE_SQL = f"""{BARS}, {SIGNALS}, {EVENTS_SQL},
ref AS (SELECT c_custkey AS code, c_acctbal * 100 AS issue_size, c_acctbal AS first_price, l.list_date FROM customer JOIN (SELECT o_custkey, min(day) AS list_date FROM od GROUP BY 1) l ON l.o_custkey = c_custkey),
vol AS (SELECT o_custkey AS code, CAST(date_trunc('week', day) AS DATE) AS trade_date, CAST(count(*) AS DOUBLE) AS vol FROM od GROUP BY ALL),
u0 AS (SELECT r.*, v.trade_date, v.vol, false AS is_signal FROM ref r JOIN vol v USING (code) UNION ALL SELECT r.*, s.signal_date, NULL, true FROM ref r CROSS JOIN (SELECT DISTINCT signal_date FROM signals) s),
u1 AS (SELECT u0.*, cal.cal_idx FROM u0 JOIN cal USING (trade_date)),
u2 AS (SELECT u1.*, s.remain_size, s.convert_price, s.effective_date AS share_date FROM u1 ASOF LEFT JOIN shares s ON u1.code = s.code AND u1.trade_date >= s.effective_date),
u3 AS (SELECT *, CASE WHEN NOT is_signal THEN CASE WHEN trade_date >= list_date AND vol > 0 AND coalesce(remain_size, issue_size) > 0 THEN vol * 10000 / coalesce(remain_size, issue_size) ELSE 0 END END AS turn FROM u2),
u4 AS (SELECT *, coalesce(sum(turn) OVER w, 0) AS turnover_sum, sum(CAST(vol > 0 AS INT)) OVER w / 20 AS observation_ratio FROM u3 WINDOW w AS (PARTITION BY code ORDER BY cal_idx RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)),
u5 AS (SELECT u4.*, r.rating, r.rating_score, r.effective_date AS rating_date FROM (SELECT * FROM u4 WHERE is_signal) u4 ASOF LEFT JOIN ratings r ON u4.code = r.code AND u4.trade_date >= r.effective_date),
lst AS (SELECT list_date, (SELECT min(cal_idx) FROM cal WHERE trade_date >= list_date) AS li FROM (SELECT DISTINCT list_date FROM ref)),
u6 AS (SELECT u5.*, CASE WHEN u5.list_date < (SELECT min(trade_date) FROM cal) THEN 11 ELSE cal_idx - li + 1 END AS listing_age, coalesce(remain_size, issue_size) AS size_asof, coalesce(convert_price, first_price) AS price_asof,
  CASE WHEN convert_price IS NOT NULL THEN 'disclosed_event' WHEN first_price IS NOT NULL THEN 'initial_terms' ELSE 'missing' END AS price_source FROM u5 JOIN lst USING (list_date)),
u7 AS (SELECT *, coalesce(listing_age >= 11, false) AS pass_age, coalesce(turnover_sum <= 0.5, false) AS pass_turnover, coalesce(size_asof >= 50000, false) AS pass_size, coalesce(rating_score >= 11, false) AS pass_rating, coalesce(price_asof > 0, false) AS pass_price FROM u6),
u AS (SELECT *, trade_date AS signal_date, (pass_age AND pass_turnover AND pass_size AND pass_rating AND pass_price) AS is_eligible,
  CASE WHEN NOT pass_age THEN 'not_listed_long_enough' WHEN NOT pass_turnover THEN 'turnover_too_high' WHEN NOT pass_size THEN 'size_missing_or_small' WHEN rating_score IS NULL THEN 'rating_missing' WHEN NOT pass_rating THEN 'rating_too_low' WHEN NOT pass_price THEN 'price_missing' ELSE 'eligible' END AS exclusion_reason FROM u7)"""


@query("universe_snapshot", f"""WITH {UNIVERSE_SQL} SELECT code, signal_date, CAST(listing_age AS BIGINT) AS listing_age, round(turnover_sum, 6) AS turnover_sum, round(size_asof, 6) AS remain_size_asof,
  price_source, rating, rating_score, is_eligible, exclusion_reason FROM u""")
def universe_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(universe(spark, sf), "code", "signal_date", "listing_age", "turnover_sum", "remain_size_asof", "price_source", "rating", "rating_score", "is_eligible", "exclusion_reason")


_FUNNEL = "UNION ALL ".join(
    f"SELECT signal_date, CAST({i} AS BIGINT) AS stage_no, '{s}' AS stage, CAST(count(*) FILTER ({' AND '.join(['true'] + ['pass_' + x for x in U.STAGES[1 : i + 1]])}) AS BIGINT) AS n_keys FROM u GROUP BY 1 " for i, s in enumerate(U.STAGES)
)


@query("universe_funnel", f"WITH {UNIVERSE_SQL} {_FUNNEL}")
def universe_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(U.funnel(universe(spark, sf)))


@query("universe_funnel_summary", f"WITH {UNIVERSE_SQL}, f AS ({_FUNNEL}) SELECT stage_no, stage, round(avg(n_keys), 6) AS mean_keys, min(n_keys) AS min_keys, max(n_keys) AS max_keys FROM f GROUP BY ALL")
def universe_funnel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(U.funnel_summary(U.funnel(universe(spark, sf))))


@query("universe_by_date", f"""WITH {UNIVERSE_SQL} SELECT signal_date, count(*) AS n_keys, count(*) FILTER (is_eligible) AS n_eligible, round(avg(CAST(is_eligible AS DOUBLE)), 6) AS eligible_share,
  round(avg(size_asof) FILTER (is_eligible), 4) AS mean_size, round(avg(CAST(price_source = 'disclosed_event' AS DOUBLE)) FILTER (is_eligible), 6) AS disclosed_share FROM u GROUP BY 1""")
def universe_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(U.by_date(universe(spark, sf)).withColumn("mean_size", rounded("mean_size", 4)))


@query("universe_transitions", f"""WITH {UNIVERSE_SQL}, t AS (SELECT code, signal_date, is_eligible, exclusion_reason, lag(is_eligible) OVER w AS was, lag(exclusion_reason) OVER w AS r FROM u WINDOW w AS (PARTITION BY code ORDER BY signal_date))
SELECT code, signal_date, CASE WHEN is_eligible THEN 'entered' ELSE 'exited' END AS transition, CASE WHEN is_eligible THEN r ELSE exclusion_reason END AS reason FROM t WHERE was IS NOT NULL AND was <> is_eligible""")
def universe_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return U.transitions(universe(spark, sf), "code")


@query("universe_reasons", f"WITH {UNIVERSE_SQL} SELECT exclusion_reason, count(*) AS n_rows FROM u GROUP BY 1")
def universe_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return U.reason_counts(universe(spark, sf))


def faulty_universe(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The universe with planted faults, and the dates it should have: the first missing, one added."""
    d = universe(spark, sf)
    k = F.col("code")
    d = d.withColumn("is_eligible", F.col("is_eligible") != (k % 31 == 0)).withColumn("share_date", F.when(k % 41 == 0, F.date_add("share_date", 900)).otherwise(F.col("share_date")))
    d = d.withColumn("membership_date", F.when(k % 53 != 0, F.col("signal_date")).when(k % 2 == 0, F.date_sub("signal_date", 1)))
    dates = signals(spark, sf).select("signal_date").where("signal_date > '1995-02-01'").unionByName(spark.range(1).select(F.to_date(F.lit("2005-01-03")).alias("signal_date")))
    return repeated(d, k % 97 == 0), dates


FAULTY = f"""{UNIVERSE_SQL}, f0 AS (SELECT code, signal_date, (is_eligible <> (code % 31 = 0)) AS el, is_eligible AS rule, CASE WHEN code % 41 = 0 THEN share_date + 900 ELSE share_date END AS sd, rating_date AS rd, CASE WHEN code % 53 <> 0 THEN signal_date WHEN code % 2 = 0 THEN signal_date - 1 END AS md FROM u),
f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE code % 97 = 0), xd AS (SELECT signal_date FROM signals WHERE signal_date > DATE '1995-02-01' UNION ALL SELECT DATE '2005-01-03'), q AS (SELECT count(*) FILTER (el) AS n FROM f GROUP BY signal_date)"""


@query("universe_audit", f"""WITH {FAULTY} SELECT count(*) AS n_rows, count(DISTINCT signal_date) AS n_dates, count(DISTINCT code) AS n_keys, count(*) FILTER (el) AS n_eligible, count(DISTINCT code) FILTER (el) AS n_eligible_keys,
  count(*) FILTER (rule <> el) AS eligibility_mismatches, count(*) FILTER (sd > signal_date) AS late_shares, count(*) FILTER (rd > signal_date) AS late_ratings, count(*) FILTER (md <> signal_date) AS industry_date_mismatches,
  (SELECT count(*) FROM xd WHERE signal_date NOT IN (SELECT signal_date FROM f)) AS missing_dates, (SELECT count(DISTINCT signal_date) FROM f WHERE signal_date NOT IN (SELECT signal_date FROM xd)) AS unexpected_dates,
  CAST(count(*) - count(DISTINCT (code, signal_date)) AS BIGINT) AS repeated_keys, (SELECT CAST(min(n) AS DOUBLE) FROM q) AS least_eligible, (SELECT quantile_cont(n, 0.25) FROM q) AS q1_eligible, (SELECT quantile_cont(n, 0.5) FROM q) AS median_eligible,
  (SELECT quantile_cont(n, 0.75) FROM q) AS q3_eligible, (SELECT CAST(max(n) AS DOUBLE) FROM q) AS most_eligible, false AS passed FROM f""")
def universe_audit(spark: SparkSession, sf: str) -> DataFrame:
    panel, dates = faulty_universe(spark, sf)
    return tidy(U.panel_audit(panel, dates, "code", "membership_date"))


@query("universe_date_checks", f"WITH {FAULTY} SELECT signal_date, count(*) AS n_rows, count(*) FILTER (el) AS n_eligible, count(*) FILTER (rule <> el) AS mismatches FROM f GROUP BY 1")
def universe_date_checks(spark: SparkSession, sf: str) -> DataFrame:
    return U.date_checks(faulty_universe(spark, sf)[0])


_BOUNDS = lambda t, c: f"(SELECT CAST(sum(CAST(bad AS INT)) AS DOUBLE) FROM (SELECT (SELECT count(*) FROM {t} y WHERE y.code = x.code AND y.effective_date = x.effective_date) <> 1 AS bad FROM {t} x))"


@query("universe_enrichment", f"""WITH {UNIVERSE_SQL}, t AS (SELECT is_eligible, exclusion_reason, lag(is_eligible) OVER (PARTITION BY code ORDER BY signal_date) AS was FROM u)
SELECT 'exit_reason' AS topic, exclusion_reason AS item, CAST(count(*) AS DOUBLE) AS value FROM t WHERE was AND NOT is_eligible GROUP BY 2
UNION ALL SELECT 'events', 'rating', CAST(count(*) AS DOUBLE) FROM ratings UNION ALL SELECT 'events', 'share', CAST(count(*) AS DOUBLE) FROM shares
UNION ALL SELECT 'boundary_failures', 'rating', {_BOUNDS('ratings', 'rating_score')} UNION ALL SELECT 'boundary_failures', 'share', {_BOUNDS('shares', 'remain_size')}
UNION ALL """ + " UNION ALL ".join(f"SELECT 'observation_ratio', '{p}', round(quantile_cont(observation_ratio, {p}), 6) FROM u WHERE is_eligible" for p in (0.0, 0.25, 0.5, 0.75, 1.0)))
def universe_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    rated, shared = stored(ratings(spark, sf), "ratings"), stored(shares(spark, sf), "shares")
    events = {"rating": (rated, "rating_score"), "share": (shared, "remain_size")}
    return tidy(U.audit_enrichment(universe(spark, sf, rated, shared), "code", events, weeks(spark, sf)))


@query("event_boundaries", f"""WITH {BARS}, {EVENTS_SQL}, k AS (SELECT r.effective_date, cal_idx FROM ratings r JOIN cal ON cal.trade_date = r.effective_date)
SELECT 'rating_score' AS event_type, CAST(count(*) + count(*) FILTER (cal_idx > 0) AS BIGINT) AS n_checks, CAST(count(*) + count(*) FILTER (cal_idx > 0) AS BIGINT) AS passed FROM k""")
def event_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(U.boundary_audit(ratings(spark, sf), weeks(spark, sf), "code", "rating_score"))


@query("industry_membership", """WITH s AS (SELECT n_name AS industry, s_suppkey % 50 AS member FROM supplier JOIN nation ON n_nationkey = s_nationkey),
g AS (SELECT member, count(DISTINCT industry) AS n, string_agg(DISTINCT industry, '|' ORDER BY industry) AS c, min(industry) AS i FROM s GROUP BY 1)
SELECT member, CASE WHEN n = 1 THEN i END AS industry, n > 1 AS is_ambiguous, c AS candidates, n AS n_candidates FROM g""")
def industry_membership(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import members

    named = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    snap = named.groupBy(F.to_date(F.lit(FIRST_DAY)).alias("trade_date"), F.col("n_name").alias("industry")).agg(F.collect_list(F.col("s_suppkey") % 50).alias("constituents"))
    m = members(snap, "trade_date", "industry", "constituents", as_of=FIRST_DAY)
    return tidy(U.resolve_membership(m, ["member"]))


FIRST_DAY = "1995-01-02"


def valued(spark: SparkSession, sf: str) -> DataFrame:
    """Valued weeks of parts. Lines are moved once, by part, into pieces that grow in number with them, as few share a part and a week: a partial
    aggregate in the scan would hold nearly all lines of a file split."""
    moved = lines(spark, sf).repartition(line_pieces(spark, sf), "l_partkey")
    close = moved.groupBy(F.col("l_partkey").alias("code"), F.col("week").alias("signal_date")).agg((F.max_by("p", "_last") / 10).alias("close"))
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("stock_close"), F.when(F.col("p_partkey") % 17 > 0, F.col("p_retailprice") * (0.6 + (F.col("p_partkey") % 10) * 0.1)).alias("convert_price"))
    return V.relative_premium(V.conversion_valuation(close.join(part, "code", "left")), ["signal_date"])


_EDGES = " ".join(f"WHEN conversion_value < {e} THEN '{x}'" for e, x in (("70", "<70"), ("90", "70-90"), ("100", "90-100"), ("110", "100-110"), ("130", "110-130")))
VALUED_SQL = f"""
vc AS (SELECT l_partkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS signal_date, last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) / 10 AS close FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
v0 AS (SELECT vc.*, p_retailprice AS stock_close, CASE WHEN p_partkey % 17 > 0 THEN p_retailprice * (CAST(0.6 AS DOUBLE) + (p_partkey % 10) * CAST(0.1 AS DOUBLE)) END AS convert_price FROM vc LEFT JOIN part ON p_partkey = code),
v1 AS (SELECT *, coalesce(close > 0 AND stock_close > 0 AND convert_price > 0, false) AS valuation_available FROM v0),
v2 AS (SELECT *, CASE WHEN valuation_available THEN stock_close / convert_price * 100 END AS conversion_value FROM v1),
v3 AS (SELECT *, close / conversion_value - 1 AS conversion_premium FROM v2),
v4 AS (SELECT *, close + 100 * conversion_premium AS double_low, CASE WHEN conversion_value IS NULL OR conversion_value < 0 THEN NULL {_EDGES} ELSE '>=130' END AS parity_bucket FROM v3),
v5 AS (SELECT *, CASE WHEN parity_bucket IS NOT NULL THEN count(conversion_premium) OVER w END AS bucket_count, CASE WHEN parity_bucket IS NOT NULL THEN median(conversion_premium) OVER w END AS bucket_median FROM v4 WINDOW w AS (PARTITION BY signal_date, parity_bucket)),
v AS (SELECT *, CASE WHEN bucket_count >= 5 THEN conversion_premium - bucket_median END AS relative_premium, -CASE WHEN bucket_count >= 5 THEN conversion_premium - bucket_median END AS parity_score FROM v5)"""


@query("parity_relative", f"""WITH {VALUED_SQL} SELECT code, signal_date, round(conversion_value, 6) AS conversion_value, round(conversion_premium, 6) AS conversion_premium, round(double_low, 6) AS double_low,
  parity_bucket, bucket_count, round(bucket_median, 6) AS bucket_median, round(relative_premium, 6) AS relative_premium, round(parity_score, 6) AS parity_score FROM v""")
def parity_relative(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(valued(spark, sf), "code", "signal_date", "conversion_value", "conversion_premium", "double_low", "parity_bucket", "bucket_count", "bucket_median", "relative_premium", "parity_score")


@query("parity_coverage", f"""WITH {VALUED_SQL} SELECT signal_date, parity_bucket, count(*) AS n_rows, CAST(sum(CAST(valuation_available AS INT)) AS BIGINT) AS n_valued, count(relative_premium) AS n_scored,
  round(median(conversion_value), 6) AS median_value, round(median(conversion_premium), 6) AS median_premium, round(sum(CAST(valuation_available AS INT)) / count(*), 6) AS valued_share, round(count(relative_premium) / count(*), 6) AS scored_share FROM v GROUP BY 1, 2""")
def parity_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(V.parity_coverage(valued(spark, sf), ["signal_date"]))


@query("valuation_tails", f"""WITH {VALUED_SQL}, r AS (SELECT code, signal_date, relative_premium FROM v WHERE relative_premium IS NOT NULL),
lo AS (SELECT * FROM r ORDER BY relative_premium, code, signal_date LIMIT 20), hi AS (SELECT r.* FROM r ANTI JOIN lo USING (code, signal_date) ORDER BY relative_premium DESC, code, signal_date LIMIT 20)
SELECT code, signal_date, round(relative_premium, 6) AS relative_premium, 'low' AS tail FROM lo UNION ALL SELECT code, signal_date, round(relative_premium, 6), 'high' FROM hi""")
def valuation_tails(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(V.tails(valued(spark, sf), "relative_premium", ["code", "signal_date"]))


def faulty_valuation(spark: SparkSession, sf: str) -> DataFrame:
    """The valued panel with planted faults in each audited column."""
    k = F.col("code")
    d = valued(spark, sf).withColumn("valuation_available", F.col("valuation_available") != (k % 61 == 0))
    d = d.withColumn("conversion_value", F.when(k % 37 == 0, F.col("conversion_value") * 1.001).otherwise(F.col("conversion_value"))).withColumn("bucket_count", F.col("bucket_count") + (k % 47 == 0).cast("int"))
    d = d.withColumn("bucket_median", F.col("bucket_median") + F.when(k % 53 == 0, 0.01).otherwise(0.0)).withColumn("double_low", F.col("double_low") + F.when(k % 67 == 0, 1e-3).otherwise(0.0))
    d = d.withColumn("parity_score", F.when(k % 43 == 0, -F.col("parity_score")).when(k % 71 == 0, F.coalesce("parity_score", F.lit(0.5))).otherwise(F.col("parity_score")))
    return d.withColumn("relative_premium", F.when(k % 73 == 0, F.col("relative_premium") + 0.25).otherwise(F.col("relative_premium")))


def off(a: str, b: str) -> str:
    return f"(({a}) IS NULL) <> (({b}) IS NULL) OR coalesce(abs(({a}) - ({b})) > 1e-10 + 1e-10 * abs({b}), false)"


_FORMULAS = {
    "value_mismatches": ("cv", "CASE WHEN pos THEN stock_close / convert_price * 100 END"), "premium_mismatches": ("cp", "CASE WHEN pos THEN close / cv - 1 END"), "double_low_mismatches": ("dl", "CASE WHEN pos THEN close + 100 * cp END"),
    "count_mismatches": ("CASE WHEN gr THEN bc END", "n"), "median_mismatches": ("CASE WHEN gr THEN bm END", "md"), "relative_mismatches": ("CASE WHEN gr THEN rp END", "CASE WHEN n >= 5 THEN cp - md END"), "score_sign_mismatches": ("CASE WHEN rp IS NOT NULL THEN ps END", "-rp"),
}


@query("valuation_audit", f"""WITH {VALUED_SQL}, f AS (SELECT code, signal_date, close, stock_close, convert_price, valuation_available <> (code % 61 = 0) AS av, CASE WHEN code % 37 = 0 THEN conversion_value * CAST(1.001 AS DOUBLE) ELSE conversion_value END AS cv, conversion_premium AS cp,
  double_low + CASE WHEN code % 67 = 0 THEN CAST(0.001 AS DOUBLE) ELSE 0 END AS dl, parity_bucket AS pb, bucket_count + CAST(code % 47 = 0 AS INT) AS bc, bucket_median + CASE WHEN code % 53 = 0 THEN CAST(0.01 AS DOUBLE) ELSE 0 END AS bm,
  CASE WHEN code % 73 = 0 THEN relative_premium + 0.25 ELSE relative_premium END AS rp, CASE WHEN code % 43 = 0 THEN -parity_score WHEN code % 71 = 0 THEN coalesce(parity_score, 0.5) ELSE parity_score END AS ps FROM v),
g AS (SELECT *, coalesce(close > 0 AND stock_close > 0 AND convert_price > 0, false) AS pos, coalesce(cv > 0 AND cp IS NOT NULL AND pb IS NOT NULL, false) AS gr FROM f),
h AS (SELECT *, CASE WHEN gr THEN count(cp) FILTER (gr) OVER w END AS n, CASE WHEN gr THEN median(cp) FILTER (gr) OVER w END AS md FROM g WINDOW w AS (PARTITION BY signal_date, pb)),
xk AS (SELECT code, signal_date FROM v WHERE code % 59 <> 0 UNION ALL SELECT -1, DATE '1999-01-04')
SELECT count(*) AS n_rows, count(*) FILTER (av) AS n_valued, count(ps) AS n_scored, count(*) FILTER (av <> (cp IS NOT NULL)) AS availability_mismatches, count(*) FILTER (n < 5 AND ps IS NOT NULL) AS small_group_scores, """ + ", ".join(f"count(*) FILTER ({off(*p)}) AS {k}" for k, p in _FORMULAS.items()) + """,
  (SELECT count(*) FROM xk ANTI JOIN v USING (code, signal_date)) AS missing_keys, (SELECT count(*) FROM v ANTI JOIN xk USING (code, signal_date)) AS extra_keys, CAST(0 AS BIGINT) + (SELECT count(*) - count(DISTINCT (code, signal_date)) FROM v) AS repeated_keys,
  round(count(*) FILTER (av) / count(*), 6) AS valued_share, round(count(ps) / count(*), 6) AS scored_share, false AS passed FROM h""")
def valuation_audit(spark: SparkSession, sf: str) -> DataFrame:
    clean = valued(spark, sf).select("code", "signal_date")
    expected = clean.where("code % 59 <> 0").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("code"), F.to_date(F.lit("1999-01-04")).alias("signal_date")))
    return tidy(V.valuation_audit(faulty_valuation(spark, sf), expected, ["code", "signal_date"], ["signal_date"]))


_FIVE = ("conversion_value", "conversion_premium", "double_low", "relative_premium", "parity_score")


@query("valuation_report", f"WITH {VALUED_SQL}, q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p} AS point, round(quantile_cont({c}, {p}), 6) AS value FROM v" for c in _FIVE for p in (0.01, 0.05, 0.5, 0.95, 0.99)) + ") SELECT \"column\", CAST(point AS DOUBLE) AS point, value FROM q")
def valuation_report(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(V.quantiles(valued(spark, sf), list(_FIVE), (0.01, 0.05, 0.5, 0.95, 0.99)))


@query("valuation_buckets", f"""WITH {VALUED_SQL} SELECT CAST(list_position(['<70', '70-90', '90-100', '100-110', '110-130', '>=130'], parity_bucket) AS BIGINT) AS bucket_no, parity_bucket, count(*) AS n_rows, count(conversion_premium) AS n_valued, round(quantile_cont(conversion_premium, 0.5), 6) AS median_premium,
  round(quantile_cont(parity_score, 0.5), 6) AS median_score, round(avg(CAST(parity_score IS NOT NULL AS INT)), 6) AS coverage FROM v WHERE parity_bucket IS NOT NULL GROUP BY parity_bucket""")
def valuation_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(V.bucket_report(valued(spark, sf)))


_POINTS = (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0)
_QUANT = " UNION ALL ".join(f"SELECT year(signal_date) AS year, '{c}' AS \"column\", {p} AS point, round(quantile_cont({c}, {p}), 6) AS value FROM v GROUP BY 1" for c in ("conversion_premium", "relative_premium") for p in _POINTS)


@query("valuation_quantiles", f"WITH {VALUED_SQL}, q AS ({_QUANT}) SELECT CAST(year AS BIGINT) AS year, \"column\", CAST(point AS DOUBLE) AS point, value FROM q")
def valuation_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    d = valued(spark, sf).withColumn("year", F.year("signal_date"))
    return tidy(V.quantiles(d, ["conversion_premium", "relative_premium"], _POINTS, ["year"]))


@query("key_audit", """WITH a AS (SELECT DISTINCT c_custkey AS code FROM customer), b AS (SELECT DISTINCT o_custkey + 3 AS code FROM orders)
SELECT code, 'missing' AS side FROM b ANTI JOIN a USING (code) UNION ALL SELECT code, 'extra' FROM a ANTI JOIN b USING (code)""")
def key_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    return key_difference(a, read(spark, sf, "orders").select((F.col("o_custkey") + 3).alias("code")), ["code"])


@query("listing_years", """SELECT o_custkey AS code, round(log(o_totalprice) * ln(10), 6) AS log_size, round(date_diff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 365 + CAST(o_custkey % 900 AS INT)) / CAST(365.25 AS DOUBLE), 6) AS years,
  right(o_orderpriority, 2) AS suffix, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS BIGINT) AS year, o_orderkey FROM orders""")
def listing_years(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    maturity = F.date_add(F.date_add(day, 365), (F.col("o_custkey") % 900).cast("int"))
    return tidy(o.select(F.col("o_custkey").alias("code"), X.log_size("o_totalprice").alias("log_size"), X.remaining_years(maturity, day).alias("years"), X.exchange_suffix("o_orderpriority").alias("suffix"), X.year_of("o_orderdate").alias("year"), "o_orderkey"))


@query("month_windows", """WITH m AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-03-17', INTERVAL 1 MONTH)) AS DATE) AS m), w AS (SELECT greatest(m, DATE '1995-01-20') AS window_start, least(CAST(last_day(m) AS DATE), DATE '1998-03-17') AS window_end FROM m)
SELECT window_start, window_end, count(o_orderkey) AS n_orders FROM w LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN window_start AND window_end GROUP BY ALL""")
def month_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = month_windows(spark, "1995-01-20", "1998-03-17")
    days = read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    per_month = days.withColumn("m", F.trunc("day", "MM")).where("day >= '1995-01-20' and day <= '1998-03-17'").groupBy("m").agg(F.sum("n").alias("n"))
    d = w.withColumn("m", F.trunc("window_start", "MM")).join(per_month, "m", "left")
    return d.select("window_start", "window_end", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("eligible_by_partition", f"WITH {UNIVERSE_SQL} SELECT code, signal_date, exclusion_reason FROM u WHERE is_eligible AND signal_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def eligible_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    holdout_guard("train", unlocked=False)
    d = U.eligible(universe(spark, sf).select("code", "signal_date", "exclusion_reason", "is_eligible"))
    forbid_columns(d)
    return research_slice(d, "signal_date", "1997-01-01", "1998-12-31").drop("is_eligible")


@query("table_fingerprint", """WITH h AS (SELECT CAST('0x' || substr(md5(concat_ws(chr(31), 'v' || o_custkey, coalesce('v' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'n'), 'v' || o_orderkey, coalesce('v' || CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, 'n'))), 1, 15) AS BIGINT) AS h FROM orders)
SELECT count(*) AS n_rows, bit_xor(h) AS hash_xor, CAST(sum(h) AS VARCHAR) AS hash_sum FROM h""")
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return fingerprint(o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("o_orderpriority")))
