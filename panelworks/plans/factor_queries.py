"""Time-series factors and cross-sections over the weekly panels."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cross_section as X
from ..operators import factors as T
from ..operators.audits import preprocessing_audit as audit_of_panel
from ..operators.valuation import factor_audit, quantiles, tails_by_factor
from ..sources.folders import stored
from .panels import BARS, STOCKS, market, over, read, register, rounded, shifted, stocks, tidy, weeks

QUERIES: dict = {}
KEYS = ["code", "trade_date"]


query = partial(register, QUERIES)


def adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf).withColumn("adj_factor", F.lit(1.0))


def ret_sql(v: str, n: int, key: str = "code") -> str:
    need = -(-(n + 1) * 8 // 10)
    return f"CASE WHEN {over(n, v, 'count', key)} >= {need} THEN {v} / {shifted(n, v, key)} - 1 END"


def roll(agg: str, v: str, n: int = 20, need: int | None = None) -> str:
    return f"CASE WHEN {over(n - 1, v, 'count')} >= {need or -(-n * 8 // 10)} THEN {over(n - 1, v, agg)} END"


def prior(agg: str, v: str, n: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY cal_idx RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({v}) {w} >= {-(-n * 8 // 10)} THEN {agg}({v}) {w} END"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


@query("momentum", f"WITH {BARS} SELECT code, trade_date, " + ", ".join(r6(ret_sql("close", n), f"stock_return_{n}d") for n in (5, 10, 20)) + " FROM bars")
def momentum(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.momentum(adjusted(spark, sf), "code"), *KEYS, "stock_return_5d", "stock_return_10d", "stock_return_20d")


@query("volatility", f"WITH {BARS} SELECT code, trade_date, {r6('(' + roll('stddev_samp', 'pct_chg / 100') + ') * sqrt(252)', 'stock_volatility_20d')} FROM bars")
def volatility(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.volatility(adjusted(spark, sf), "code"), *KEYS, "stock_volatility_20d")


@query("rsi", f"""WITH {BARS}, m AS (SELECT *, close - pre_close AS mv FROM bars), s AS (SELECT code, trade_date, {roll('sum', 'CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END')} AS up, {roll('sum', 'abs(mv)')} AS al FROM m)
SELECT code, trade_date, round(CASE WHEN al = 0 THEN 50 ELSE up / al * 100 END, 6) AS stock_rsi_20d FROM s""")
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.rsi(adjusted(spark, sf), "code"), *KEYS, "stock_rsi_20d")


@query("price_to_high", f"WITH {BARS} SELECT code, trade_date, {r6('close / (' + roll('max', 'close') + ')', 'stock_price_to_high_20d')} FROM bars")
def price_to_high(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.price_to_high(adjusted(spark, sf), "code"), *KEYS, "stock_price_to_high_20d")


@query("percent_b", f"""WITH {BARS}, s AS (SELECT code, trade_date, close, {roll('avg', 'close')} AS m, {roll('stddev_pop', 'close')} AS d FROM bars)
SELECT code, trade_date, round(CASE WHEN d > 1e-12 THEN (close - (m - 2 * d)) / (4 * d) END, 6) AS stock_percent_b_20d FROM s""")
def percent_b(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.percent_b(adjusted(spark, sf), "code"), *KEYS, "stock_percent_b_20d")


@query("amihud", f"WITH {BARS} SELECT code, trade_date, {r6('(' + roll('avg', 'CASE WHEN amount > 0 THEN abs(pct_chg / 100) / (amount * 1000) END') + ') * 1e8', 'stock_amihud_20d')} FROM bars")
def amihud(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.amihud(adjusted(spark, sf), "code"), *KEYS, "stock_amihud_20d")


@query("money_flow", f"""WITH {BARS}, a AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), b AS (SELECT *, {shifted(1, 'tp')} AS bt FROM a),
c AS (SELECT *, CASE WHEN bt IS NOT NULL AND vol > 0 THEN CASE WHEN tp > bt THEN tp * vol ELSE 0 END END AS up, CASE WHEN bt IS NOT NULL AND vol > 0 THEN CASE WHEN tp < bt THEN tp * vol ELSE 0 END END AS dn FROM b),
s AS (SELECT code, trade_date, {roll('sum', 'up')} AS pos, {roll('sum', 'dn')} AS neg FROM c)
SELECT code, trade_date, round(CASE WHEN pos + neg = 0 THEN 50 ELSE 100 * pos / (pos + neg) END, 6) AS stock_mfi_20d FROM s""")
def money_flow(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.money_flow(adjusted(spark, sf), "code"), *KEYS, "stock_mfi_20d")


def linked(spark: SparkSession, sf: str) -> DataFrame:
    s = stocks(spark, sf).select(F.col("code").alias("stock"), "trade_date", F.col("close").alias("stock_adj"), (F.col("pct_chg") / 100).alias("stock_return"))
    m = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("stock"))
    b = T.bond_daily_return(market(spark, sf), "code").join(T.underlying_map(m, "code", "stock"), "code")
    return b.join(s, ["stock", "trade_date"], "left").withColumn("bond_close", F.col("close"))


LINKED = f"""{BARS}, {STOCKS},
lk AS (SELECT b.code, b.trade_date, b.cal_idx, b.close, b.close AS bond_close, coalesce(b.pct_chg / 100, b.close / lag(b.close) OVER (PARTITION BY b.code ORDER BY b.trade_date) - 1) AS bond_return, t.close AS stock_adj, t.pct_chg / 100 AS stock_return
  FROM bars b JOIN supplier s ON s.s_suppkey = b.code LEFT JOIN stocks t ON t.code = s.s_nationkey AND t.trade_date = b.trade_date)"""


@query("return_spread", f"WITH {LINKED} SELECT code, trade_date, " + ", ".join(r6(f"({ret_sql('bond_close', n)}) - ({ret_sql('stock_adj', n)})", f"return_spread_{n}d") for n in (5, 10, 20)) + " FROM lk")
def return_spread(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.return_spread(linked(spark, sf), "code"), *KEYS, "return_spread_5d", "return_spread_10d", "return_spread_20d")


def _beta(n: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY cal_idx RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    ok = f"count(x) {w} >= {-(-n * 8 // 10)}"
    cov, vx, vy = f"covar_pop(y, x) {w}", f"greatest(var_pop(x) {w}, 0)", f"greatest(var_pop(y) {w}, 0)"
    return f"""round(CASE WHEN {ok} AND {vx} > 1e-18 THEN {cov} / {vx} END, 6) AS beta_{n}d,
  round(CASE WHEN {ok} AND {vx} > 1e-18 AND {vy} > 1e-18 THEN greatest(-1, least(1, {cov} / (sqrt({vx}) * sqrt({vy})))) END, 6) AS correlation_{n}d"""


@query("beta_corr", f"""WITH {LINKED}, p AS (SELECT code, trade_date, cal_idx, CASE WHEN stock_return IS NOT NULL THEN bond_return END AS y, CASE WHEN bond_return IS NOT NULL THEN stock_return END AS x FROM lk)
SELECT code, trade_date, {_beta(20)}, {_beta(60)} FROM p""")
def beta_corr(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.beta_correlation(linked(spark, sf), "code"), *KEYS, "beta_20d", "correlation_20d", "beta_60d", "correlation_60d")


def traded(bars: DataFrame) -> DataFrame:
    d = T.bond_daily_return(bars.withColumn("remain_size", F.lit(1e6) + F.col("code") * 1000), "code")
    d = T.bond_trading_base(d, price_scale=1.0, volume_scale=1000.0, amount_scale=1.0)
    return T.bond_trading(d, "code")


TRADED = f"""{BARS},
t0 AS (SELECT *, 1000000 + code * 1000 AS remain_size, coalesce(pct_chg / 100, close / pre_close - 1) AS bond_return, CASE WHEN vol > 0 THEN amount / vol END AS vwap FROM bars),
t1 AS (SELECT *, coalesce(vwap >= low - 0.02 AND vwap <= high + 0.02 AND low > 0 AND high > 0, false) AS ok FROM t0),
t2 AS (SELECT *, CASE WHEN vol = 0 AND amount = 0 THEN 0 WHEN ok AND remain_size > 0 THEN vol * 1000 / remain_size END AS turnover, CASE WHEN ok AND amount > 0 THEN amount END AS notional FROM t1),
t3 AS (SELECT *, ln(notional) AS la, abs(bond_return) / notional AS il, CASE WHEN ok THEN close / vwap - 1 END AS cv FROM t2)"""


@query("abnormal_turnover", f"""WITH {TRADED}, a AS (SELECT code, trade_date, turnover, {prior('avg', 'turnover', 20)} AS m20, {prior('avg', 'turnover', 60)} AS m60 FROM t3)
SELECT code, trade_date, round(turnover, 6) AS turnover, round(CASE WHEN m20 > 0 THEN turnover / m20 END, 6) AS cb_abnormal_turnover_20d, round(CASE WHEN m60 > 0 THEN turnover / m60 END, 6) AS cb_abnormal_turnover_60d FROM a""")
def abnormal_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(traded(market(spark, sf)), *KEYS, "turnover", "cb_abnormal_turnover_20d", "cb_abnormal_turnover_60d")


@query("amount_zscore", f"""WITH {TRADED}, a AS (SELECT code, trade_date, la, {prior('avg', 'la', 20)} AS m, {prior('stddev_samp', 'la', 20)} AS s FROM t3)
SELECT code, trade_date, round(CASE WHEN s > 1e-12 THEN (la - m) / s END, 6) AS cb_log_amount_zscore_20d FROM a""")
def amount_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(traded(market(spark, sf)), *KEYS, "cb_log_amount_zscore_20d")


@query("bond_returns", f"WITH {TRADED}, a AS (SELECT code, trade_date, " + ", ".join(f"{ret_sql('close', n)} AS r{n}" for n in (5, 10, 20)) + " FROM t3) SELECT code, trade_date, round(r5, 6) AS cb_return_5d, round(r10, 6) AS cb_return_10d, round(r20, 6) AS cb_return_20d, round(r5 - r20, 6) AS cb_short_long_momentum_5_20d FROM a")
def bond_returns(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(traded(market(spark, sf)), *KEYS, "cb_return_5d", "cb_return_10d", "cb_return_20d", "cb_short_long_momentum_5_20d")


@query("vwap_check", f"""WITH {TRADED} SELECT code, trade_date, ok AS vwap_unit_valid, round(cv, 6) AS cb_close_to_vwap, round(CASE WHEN cv IS NOT NULL THEN {roll('avg', 'cv', 5)} END, 6) AS cb_close_to_vwap_mean_5d,
  round(CASE WHEN notional IS NOT NULL THEN ({roll('avg', 'il')}) * 1e8 END, 6) AS cb_amihud_20d FROM t3""")
def vwap_check(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(traded(market(spark, sf)), *KEYS, "vwap_unit_valid", "cb_close_to_vwap", "cb_close_to_vwap_mean_5d", "cb_amihud_20d")


@query("vwap_audit", f"""WITH {TRADED}, a AS (SELECT CAST(code % 4 AS VARCHAR) AS exchange, CAST(year(trade_date) AS BIGINT) AS year, CAST(ok AS INT) AS ok FROM t3 WHERE vwap IS NOT NULL)
SELECT exchange, year, count(*) AS n_rows, CAST(sum(ok) AS BIGINT) AS n_valid, round(sum(ok) / count(*), 6) AS valid_share FROM a GROUP BY CUBE (exchange, year) HAVING grouping(exchange, year) > 0""")
def vwap_audit(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.vwap_audit(traded(market(spark, sf)), (F.col("code") % 4).cast("string"), F.year("trade_date")))


FACTORS = ["mom", "flow", "turn"]


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """A small family of factors with controls: size and age as numbers, nation as category."""
    d = T.money_flow(T.momentum(adjusted(spark, sf), "code", (5,)), "code")
    c = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey", F.when(F.col("s_suppkey") % 13 > 0, F.col("s_acctbal")).alias("balance"))
    d = d.join(c, "code").select("code", "trade_date", F.col("stock_return_5d").alias("mom"), F.col("stock_mfi_20d").alias("flow"), F.col("vol").alias("turn"), "balance", (F.col("high") - F.col("low")).alias("span"), (F.col("s_nationkey") % 5).cast("string").alias("nation"))
    return d


PANEL = f"""{BARS}, a AS (SELECT *, (high + low + close) / 3 AS tp, {ret_sql('close', 5)} AS mom FROM bars), b AS (SELECT *, {shifted(1, 'tp')} AS bt FROM a),
c AS (SELECT *, CASE WHEN bt IS NOT NULL AND vol > 0 THEN CASE WHEN tp > bt THEN tp * vol ELSE 0 END END AS up, CASE WHEN bt IS NOT NULL AND vol > 0 THEN CASE WHEN tp < bt THEN tp * vol ELSE 0 END END AS dn FROM b),
s AS (SELECT *, {roll('sum', 'up')} AS pos, {roll('sum', 'dn')} AS neg FROM c),
panel AS (SELECT s.code, trade_date, mom, CASE WHEN pos + neg = 0 THEN 50 ELSE 100 * pos / (pos + neg) END AS flow, vol AS turn, CASE WHEN s_suppkey % 13 > 0 THEN s_acctbal END AS balance, high - low AS span, CAST(s_nationkey % 5 AS VARCHAR) AS nation
  FROM s JOIN supplier ON s_suppkey = s.code)"""


def wins(x: str, by: str, src: str, k: str = "3.0", extra: str = "") -> str:
    """CTEs m_<x> with the clipped value w of column x."""
    return f"""w1_{x} AS (SELECT *, median({x}) OVER (PARTITION BY {by}) AS med FROM {src}), w2_{x} AS (SELECT *, median(abs({x} - med)) OVER (PARTITION BY {by}) * 1.4826 AS mad FROM w1_{x}),
w_{x} AS (SELECT *, CASE WHEN {x} IS NULL THEN NULL WHEN mad / 1.4826 > 1e-8 THEN greatest(med - {k} * mad, least(med + {k} * mad, {x})) ELSE {x} END AS w FROM w2_{x})"""


@query("winsorize_mad", f"WITH {PANEL}, {wins('mom', 'trade_date', 'panel')}, {wins('flow', 'trade_date', 'panel')}, {wins('turn', 'trade_date', 'panel')} SELECT a.code, a.trade_date, round(a.w, 6) AS winsorized__mom, round(b.w, 6) AS winsorized__flow, round(c.w, 6) AS winsorized__turn FROM w_mom a JOIN w_flow b USING (code, trade_date) JOIN w_turn c USING (code, trade_date)")
def winsorize(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(X.winsorize_panel(panel(spark, sf), KEYS, "trade_date", FACTORS))


@query("zscore", f"""WITH {PANEL}, z AS (SELECT code, trade_date, mom, avg(mom) OVER w AS m, stddev_pop(mom) OVER w AS s FROM panel WINDOW w AS (PARTITION BY trade_date))
SELECT code, trade_date, round(CASE WHEN mom IS NULL THEN NULL WHEN s > 1e-8 THEN (mom - m) / s ELSE 0 END, 6) AS standardized__mom FROM z""")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(X.standardize(panel(spark, sf), "mom", ["trade_date"]), *KEYS, "standardized__mom")


NEUTRAL = f"""{PANEL}, n0 AS (SELECT *, (mom IS NOT NULL AND balance IS NOT NULL AND span IS NOT NULL AND nation IS NOT NULL) AS ok FROM panel),
n1 AS (SELECT *, CASE WHEN ok THEN mom - avg(mom) FILTER (ok) OVER c END AS y, CASE WHEN ok THEN balance - avg(balance) FILTER (ok) OVER c END AS p, CASE WHEN ok THEN span - avg(span) FILTER (ok) OVER c END AS q,
  nation IS NOT NULL AND coalesce(sum(CAST(ok AS INT)) OVER c, 0) = 0 AS lone FROM n0 WINDOW c AS (PARTITION BY trade_date, nation)),
g AS (SELECT trade_date, count(*) FILTER (ok) AS n, count(DISTINCT nation) FILTER (ok) AS k, bool_or(lone) AS lone_any, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(y * p) AS yp, sum(y * q) AS yq FROM n1 GROUP BY 1)"""


@query("neutralize", f"""WITH {NEUTRAL} SELECT code, n1.trade_date, round(CASE WHEN ok AND n > k + 2 AND NOT lone_any AND pp * qq - pq * pq > 1e-12 * pp * qq
  THEN y - p * ((yp * qq - yq * pq) / (pp * qq - pq * pq)) - q * ((yq * pp - yp * pq) / (pp * qq - pq * pq)) END, 6) AS neutralized__mom FROM n1 JOIN g USING (trade_date)""")
def neutralize(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(X.neutralize(panel(spark, sf), "mom", ["trade_date"], ["balance", "span"], "nation"), *KEYS, "neutralized__mom")


POLICIES = [X.Policy("mom", ("balance", "span"), "nation"), X.Policy("turn", ("balance", "span"), "nation"), X.Policy("flow")]


def family(spark: SparkSession, sf: str) -> DataFrame:
    w = stored(X.winsorize_panel(panel(spark, sf), KEYS, "trade_date", FACTORS, keep=("balance", "span", "nation")), "winsorized")
    return X.preprocess_family(w, "trade_date", POLICIES)


def _residual(x: str) -> str:
    """CTE r_<x> with the residual y of the winsorised x on two controls and the category."""
    return f"""o_{x} AS (SELECT *, (w IS NOT NULL AND balance IS NOT NULL AND span IS NOT NULL AND nation IS NOT NULL) AS ok FROM w_{x}),
c_{x} AS (SELECT *, CASE WHEN ok THEN w - avg(w) FILTER (ok) OVER c END AS y, CASE WHEN ok THEN balance - avg(balance) FILTER (ok) OVER c END AS p, CASE WHEN ok THEN span - avg(span) FILTER (ok) OVER c END AS q,
  nation IS NOT NULL AND coalesce(sum(CAST(ok AS INT)) OVER c, 0) = 0 AS lone FROM o_{x} WINDOW c AS (PARTITION BY trade_date, nation)),
g_{x} AS (SELECT trade_date, count(*) FILTER (ok) AS n, count(DISTINCT nation) FILTER (ok) AS k, bool_or(lone) AS lone_any, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(y * p) AS yp, sum(y * q) AS yq FROM c_{x} GROUP BY 1),
r_{x} AS (SELECT c.code, c.trade_date, w, balance, span, nation, CASE WHEN ok AND n > k + 2 AND NOT lone_any AND pp * qq - pq * pq > 1e-12 * pp * qq
  THEN y - p * ((yp * qq - yq * pq) / (pp * qq - pq * pq)) - q * ((yq * pp - yp * pq) / (pp * qq - pq * pq)) END AS y FROM c_{x} c JOIN g_{x} USING (trade_date))"""


def _z(x: str, src: str) -> str:
    return f"z_{x} AS (SELECT code, trade_date, CASE WHEN {src} IS NULL THEN NULL WHEN stddev_pop({src}) OVER d > 1e-8 THEN ({src} - avg({src}) OVER d) / stddev_pop({src}) OVER d ELSE 0 END AS z FROM {'r_' if src == 'y' else 'w_'}{x} WINDOW d AS (PARTITION BY trade_date))"


FAMILY = ", ".join([PANEL, *(wins(x, "trade_date", "panel") for x in FACTORS), _residual("mom"), _residual("turn"), _z("mom", "y"), _z("turn", "y"), _z("flow", "w")])


@query("preprocess_family", f"WITH {FAMILY} SELECT a.code, a.trade_date, round(a.z, 6) AS standardized__mom, round(b.z, 6) AS standardized__flow, round(c.z, 6) AS standardized__turn FROM z_mom a JOIN z_flow b USING (code, trade_date) JOIN z_turn c USING (code, trade_date)")
def preprocess_family(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(family(spark, sf), *KEYS, "standardized__mom", "standardized__flow", "standardized__turn")


_SENS_W = wins("value", "trade_date, factor, k", "sl", "k")
SPEARMAN = lambda src, by, x, y: f"""SELECT {by}, n, CASE WHEN vx > 0 AND vy > 0 THEN c / (sqrt(vx) * sqrt(vy)) END AS r FROM (SELECT {by}, count(*) AS n, covar_pop(rx, ry) AS c, var_pop(rx) AS vx, var_pop(ry) AS vy FROM
  (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2 AS rx, rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2 AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by})"""  # noqa: E731
LONG = "lg AS (SELECT code, trade_date, unnest(['mom', 'flow', 'turn']) AS factor, unnest([mom, flow, turn]) AS value FROM panel)"


@query("mad_sensitivity", f"""WITH {PANEL}, {LONG}, sl AS (SELECT lg.*, k FROM lg CROSS JOIN (SELECT unnest([CAST(2.5 AS DOUBLE), 3.0, 3.5]) AS k)), {_SENS_W},
x AS (SELECT *, abs(w - value) AS ch, abs(w - value) > 1e-8 + 1e-5 * abs(value) AS mv FROM w_value),
sp AS ({SPEARMAN('w_value', 'factor, k, trade_date', 'value', 'w')}), sm AS (SELECT factor, k, avg(CASE WHEN n >= 2 THEN r END) AS mr FROM sp GROUP BY ALL)
SELECT factor, k AS multiplier, count(value) AS n_observed, count(*) FILTER (mv) AS n_clipped, count(*) FILTER (mv AND w > value) AS n_lower, count(*) FILTER (mv AND w < value) AS n_upper, count(DISTINCT trade_date) FILTER (mv) AS n_dates,
  round(median(ch) FILTER (mv), 6) AS median_change, round(max(ch) FILTER (mv), 6) AS max_change, round(any_value(mr), 6) AS mean_rank_correlation, round(count(*) FILTER (mv) / count(value), 6) AS clip_rate FROM x JOIN sm USING (factor, k) GROUP BY ALL""")
def mad_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(X.mad_sensitivity(panel(spark, sf), KEYS, "trade_date", FACTORS))


MATRIX = f"""{PANEL}, {LONG}, pr AS (SELECT a.factor AS factor_a, b.factor AS factor_b, a.value AS x, b.value AS y FROM lg a JOIN lg b USING (code, trade_date) WHERE a.factor <= b.factor AND a.value IS NOT NULL AND b.value IS NOT NULL),
mx AS ({SPEARMAN('pr', 'factor_a, factor_b', 'x', 'y')})"""


@query("clipping_audit", f"""WITH {PANEL}, {LONG}, sl AS (SELECT lg.*, k FROM lg CROSS JOIN (SELECT unnest([CAST(2.5 AS DOUBLE), 3.0, 3.5]) AS k)), {_SENS_W},
n AS (SELECT factor, k, count(*) FILTER (abs(w - value) > 1e-8 + 1e-5 * abs(value)) AS c FROM w_value GROUP BY ALL), l AS (SELECT *, lag(c) OVER (PARTITION BY factor ORDER BY k) AS p FROM n)
SELECT factor, coalesce(bool_and(c <= p), true) AS is_monotone, max(c) AS most_clipped FROM l GROUP BY 1""")
def clipping_audit(spark: SparkSession, sf: str) -> DataFrame:
    return X.clipping_audit(X.mad_sensitivity(panel(spark, sf), KEYS, "trade_date", FACTORS))


_AUDITED = f"""WITH {PANEL}, {LONG}, sl AS (SELECT lg.*, k FROM lg CROSS JOIN (SELECT unnest([CAST(2.5 AS DOUBLE), 3.0, 3.5]) AS k)), {_SENS_W},
x AS (SELECT *, abs(w - value) > 1e-8 + 1e-5 * abs(value) AS mv FROM w_value), sp AS ({SPEARMAN('w_value', 'factor, k, trade_date', 'value', 'w')}), sm AS (SELECT factor, k, avg(CASE WHEN n >= 2 THEN r END) AS mr FROM sp GROUP BY ALL),
st AS (SELECT factor, k, count(*) FILTER (mv) / count(value) AS cr, count(*) FILTER (mv) AS c FROM x GROUP BY ALL), mo AS (SELECT *, lag(c) OVER (PARTITION BY factor ORDER BY k) AS p FROM st),
cp AS (SELECT s_suppkey AS code, trade_date AS cap_date, CASE WHEN (cal_idx + s_suppkey) % 8 > 0 THEN s_suppkey * 1000.0 + cal_idx END AS cap FROM supplier, cal WHERE cal_idx % 4 = 0),
p0 AS (SELECT p.*, cap, CAST(date_diff('day', cap_date, p.trade_date) AS BIGINT) AS age, nation AS ind FROM panel p ASOF LEFT JOIN cp ON cp.code = p.code AND p.trade_date >= cp.cap_date),
p1 AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE code % 41 = 0 AND year(trade_date) = 1996)"""


@query("preprocessing_audit", f"""{_AUDITED} SELECT count(*) AS n_rows, count(DISTINCT trade_date) AS n_dates, count(DISTINCT code) AS n_entities, count(*) - (SELECT count(*) FROM p0) AS repeated_keys,
  {", ".join(f"round(count({f}) / count(*), 6) AS coverage__{f}" for f in ("mom", "flow", "turn"))}, round(count(cap) / count(*), 6) AS cap_coverage, round(count(ind) / count(*), 6) AS industry_coverage, round(count(*) FILTER (cap IS NOT NULL AND ind IS NOT NULL) / count(*), 6) AS joint_coverage, max(age) AS oldest_cap,
  1::BIGINT AS missing_outputs, 1::BIGINT AS forbidden_columns, {", ".join(f"round((SELECT cr FROM st WHERE factor = '{f}' AND k = 3), 6) AS clip_rate__{f}, round((SELECT mr FROM sm WHERE factor = '{f}' AND k = 3), 6) AS rank_correlation__{f}" for f in ("mom", "flow", "turn"))},
  (SELECT count(*) FROM (SELECT factor FROM mo GROUP BY 1 HAVING bool_or(c > p))) AS not_monotone, false AS passed FROM p1""")
def preprocessing_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A panel with planted faults: repeated keys, an output that is missing, a column from the future."""
    p = stored(panel(spark, sf), "panel")
    cap = F.when((F.col("cal_idx") + F.col("code")) % 8 > 0, F.col("code") * 1000.0 + F.col("cal_idx"))
    caps = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("code")).crossJoin(F.broadcast(weeks(spark, sf).where("cal_idx % 4 = 0"))).select("code", "trade_date", cap.alias("market_cap"))
    d = X.attach_market_cap(p, caps, "code", "trade_date", industry="nation").withColumn("label_next", F.lit(None).cast("double"))
    d = d.unionByName(d.where("code % 41 = 0 and year(trade_date) = 1996")).withColumn("winsorized__mom", F.col("mom"))
    return tidy(audit_of_panel(d, "code", "trade_date", FACTORS, X.mad_sensitivity(p, KEYS, "trade_date", FACTORS), ["winsorized__mom", "standardized__mom"]))


@query("spearman_matrix", f"WITH {MATRIX} SELECT factor_a, factor_b, n AS n_pairs, round(r, 6) AS correlation FROM mx")
def spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(X.spearman_matrix(panel(spark, sf), KEYS, FACTORS))


@query("rank_overlap", f"WITH {MATRIX} SELECT factor_a, factor_b, n AS n_pairs, round(r, 6) AS correlation, round(abs(r), 6) AS strength FROM mx WHERE factor_a < factor_b ORDER BY abs(r) DESC, 1, 2 LIMIT 8")
def rank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(X.rank_overlap(X.spearman_matrix(panel(spark, sf), KEYS, FACTORS)))


_CORR = "CASE WHEN max(CASE WHEN mom IS NOT NULL THEN z END) > min(CASE WHEN mom IS NOT NULL THEN z END) AND max(CASE WHEN z IS NOT NULL THEN mom END) > min(CASE WHEN z IS NOT NULL THEN mom END) THEN covar_pop(mom, z) / (stddev_pop(CASE WHEN z IS NOT NULL THEN mom END) * stddev_pop(CASE WHEN mom IS NOT NULL THEN z END)) END"


@query("control_correlation", f"""WITH {PANEL}, cats AS (SELECT trade_date, nation AS c FROM (SELECT DISTINCT trade_date, nation FROM panel) QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY nation) > 1),
z AS (SELECT trade_date, mom, 'balance' AS control, balance AS z FROM panel UNION ALL SELECT p.trade_date, mom, c, CASE WHEN nation = c THEN 1.0 ELSE 0.0 END FROM panel p JOIN cats USING (trade_date)),
r AS (SELECT trade_date, control, {_CORR} AS r FROM z GROUP BY ALL) SELECT round(avg(abs(r)), 6) AS mean_abs_correlation FROM r""")
def control_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(X.control_correlation(panel(spark, sf), "mom", "trade_date", ["balance"], "nation"))


def _exposure(x: str, v: str) -> str:
    r = f"CASE WHEN max(CASE WHEN {v} IS NOT NULL THEN z END) > min(CASE WHEN {v} IS NOT NULL THEN z END) AND max(CASE WHEN z IS NOT NULL THEN {v} END) > min(CASE WHEN z IS NOT NULL THEN {v} END) THEN covar_pop({v}, z) / (stddev_pop(CASE WHEN z IS NOT NULL THEN {v} END) * stddev_pop(CASE WHEN {v} IS NOT NULL THEN z END)) END"
    return f"""(SELECT avg(abs(r)) FROM (SELECT {r} AS r FROM (SELECT trade_date, {v}, 'balance' AS control, balance AS z FROM r_{x} UNION ALL SELECT trade_date, {v}, 'span', span FROM r_{x} UNION ALL
  SELECT p.trade_date, {v}, c, CASE WHEN nation = c THEN 1.0 ELSE 0.0 END FROM r_{x} p JOIN cats USING (trade_date)) GROUP BY trade_date, control))"""


def _diagnosis(x: str, neutral: bool) -> str:
    pair = f"(SELECT trade_date, w, round(z, 9) AS z FROM w_{x} JOIN z_{x} USING (code, trade_date))"
    ranks = f"(SELECT avg(CASE WHEN n >= 2 THEN r END) FROM ({SPEARMAN(pair, 'trade_date', 'w', 'z')}))"
    before, after = (_exposure(x, "w"), _exposure(x, "y")) if neutral else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    return f"SELECT '{x}' AS factor, (SELECT count(w) FROM w_{x}) AS n_observed, count(z) AS n_processed, round(count(z) / count(*), 6) AS coverage, round({before}, 6) AS exposure_before, round({after}, 6) AS exposure_after, round({ranks}, 6) AS rank_correlation FROM z_{x}"


@query("family_diagnostics", f"WITH {FAMILY}, cats AS (SELECT trade_date, nation AS c FROM (SELECT DISTINCT trade_date, nation FROM panel) QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY nation) > 1) " + " UNION ALL ".join(_diagnosis(p.factor, bool(p.numeric)) for p in POLICIES))
def family_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    d = family(spark, sf)  # where a fit is perfect, only the noise of rounding is left, which must not be ranked
    d = stored(d.withColumns({f"standardized__{f}": rounded(f"standardized__{f}", 9) for f in FACTORS}), "family")
    return tidy(X.family_diagnostics(d, "trade_date", POLICIES))


@query("factor_tails", f"""WITH {PANEL}, {LONG}, v AS (SELECT * FROM lg WHERE value IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY value, code, trade_date) AS position, 'low' AS tail FROM v UNION ALL SELECT *, row_number() OVER (PARTITION BY factor ORDER BY value DESC, code, trade_date), 'high' FROM v)
SELECT code, trade_date, factor, round(value, 6) AS value, position, tail FROM t WHERE position <= 10""")
def factor_tails(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(tails_by_factor(panel(spark, sf), FACTORS, KEYS), "code", "trade_date", "factor", "value", "position", "tail")


@query("factor_coverage", f"""WITH {PANEL}, {LONG} SELECT trade_date, count(*) AS n_rows, factor, count(value) AS n_observed, round(count(value) / count(*), 6) AS coverage FROM lg GROUP BY trade_date, factor""")
def factor_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.coverage(panel(spark, sf), FACTORS, ["trade_date"]))


_FQ = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p} AS point, round(quantile_cont({c}, {p}), 6) AS value FROM panel" for c in FACTORS for p in (0.01, 0.25, 0.5, 0.75, 0.99))


@query("factor_quantiles", f"WITH {PANEL}, q AS ({_FQ}) SELECT \"column\", CAST(point AS DOUBLE) AS point, value FROM q")
def factor_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(quantiles(panel(spark, sf), FACTORS, (0.01, 0.25, 0.5, 0.75, 0.99)))


STOCK_FACTORS = ("stock_return_5d", "stock_return_10d", "stock_return_20d", "stock_price_to_high_20d")


def stock_factors(spark: SparkSession, sf: str) -> DataFrame:
    return T.price_to_high(T.momentum(adjusted(spark, sf), "code"), "code").select(*KEYS, *STOCK_FACTORS)


def faulty(d: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """A factor panel with faults: changed values, lost values, keys missing and repeated."""
    k = F.col("code")
    d = d.withColumn(factors[0], F.when(k % 7 == 0, F.col(factors[0]) + 0.01).otherwise(F.col(factors[0]))).withColumn(factors[1], F.when(k % 13 != 0, F.col(factors[1])))
    other = F.lit(-1).cast(d.schema["code"].dataType)
    return d.where("code % 11 <> 0").withColumn("code", F.explode(F.when(k == 1, F.array(k, other)).when(k % 19 == 0, F.array(k, k)).otherwise(F.array(k))))


def _faulty_sql(factors: tuple[str, ...], rest: str = "") -> str:
    """CTEs a (faulty) of ex (clean)."""
    return f"""a0 AS (SELECT code, trade_date, CASE WHEN code % 7 = 0 THEN {factors[0]} + 0.01 ELSE {factors[0]} END AS {factors[0]}, CASE WHEN code % 13 <> 0 THEN {factors[1]} END AS {factors[1]}, {', '.join(factors[2:])}{rest} FROM ex WHERE code % 11 <> 0),
a AS (SELECT * FROM a0 UNION ALL SELECT * FROM a0 WHERE code % 19 = 0 UNION ALL SELECT * REPLACE (-1 AS code) FROM a0 WHERE code = 1)"""


def _audit_sql(factors: tuple[str, ...], flags: tuple[str, ...] = ()) -> str:
    off = lambda c: f"CAST((a.{c} IS NULL) <> (ex.{c} IS NULL) OR coalesce(abs(a.{c} - ex.{c}) > 1e-10 + 1e-10 * abs(ex.{c}), false) AS INT)"
    wrong = " + ".join([off(c) for c in factors] + [f"CAST(a.{c} IS DISTINCT FROM ex.{c} AS INT)" for c in flags])
    return f"""SELECT (SELECT count(*) FROM a) AS n_rows, CAST((SELECT sum({wrong}) FROM a JOIN ex USING (code, trade_date)) AS BIGINT) AS mismatches, (SELECT count(*) FROM ex ANTI JOIN a USING (code, trade_date)) AS missing_keys, (SELECT count(*) FROM a ANTI JOIN ex USING (code, trade_date)) AS extra_keys,
  CAST((SELECT count(*) - count(DISTINCT (code, trade_date)) FROM a) AS BIGINT) AS repeated_keys, false AS passed, """ + ", ".join(f"round((SELECT count({c}) / count(*) FROM a), 6) AS coverage__{c}" for c in factors)


@query("formula_audit", f"WITH {BARS}, ex AS (SELECT code, trade_date, " + ", ".join(f"{ret_sql('close', n)} AS stock_return_{n}d" for n in (5, 10, 20)) + f", close / ({roll('max', 'close')}) AS stock_price_to_high_20d FROM bars), {_faulty_sql(STOCK_FACTORS)} {_audit_sql(STOCK_FACTORS)}")
def formula_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = stored(stock_factors(spark, sf), "stock-factors")
    return tidy(factor_audit(faulty(d, STOCK_FACTORS), d, KEYS, list(STOCK_FACTORS)))


BOND_FACTORS = ("cb_return_5d", "cb_return_20d", "turnover", "cb_close_to_vwap")


@query("trading_audit", f"""WITH {TRADED}, ex AS (SELECT code, trade_date, {ret_sql('close', 5)} AS cb_return_5d, {ret_sql('close', 20)} AS cb_return_20d, turnover, cv AS cb_close_to_vwap, ok AS vwap_unit_valid FROM t3), {_faulty_sql(BOND_FACTORS, ', vwap_unit_valid <> (code % 17 = 0) AS vwap_unit_valid')},
gt AS (SELECT count(*) FILTER (vol > 0 AND amount > 0 AND low > 0 AND high > 0) AS n_vwap, count(*) FILTER (vol > 0 AND amount > 0 AND low > 0 AND high > 0 AND amount / vol >= low - 0.02 AND amount / vol <= high + 0.02) AS n_inside FROM t3),
au AS ({_audit_sql(BOND_FACTORS, ('vwap_unit_valid',))}) SELECT au.*, n_vwap, n_inside, n_vwap - n_inside AS n_excluded, round(n_inside / n_vwap, 6) AS inside_share, n_inside / n_vwap >= 0.999 AS gate_passed FROM au, gt""")
def trading_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = stored(traded(market(spark, sf)).select(*KEYS, *BOND_FACTORS, "vwap_unit_valid", "vol", "amount", "low", "high"), "traded")
    e = d.select(*KEYS, *BOND_FACTORS, "vwap_unit_valid")
    wrong = faulty(e, BOND_FACTORS).withColumn("vwap_unit_valid", F.col("vwap_unit_valid") != (F.abs("code") % 17 == 0))
    return tidy(factor_audit(wrong, e, KEYS, list(BOND_FACTORS), ("vwap_unit_valid",)).crossJoin(T.trading_gate(d, price_scale=1.0)))
