"""Time-series factors of stocks, bonds and their linkage, on frames of calendar positions.

Panels hold a row for each key and open day with data, with `cal_idx`; a frame over n
positions of such sparse rows equals one over n rows of a dense grid, so no grid is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import frame, long_frames, min_periods, rolling, running, shift


def window_return(value: Column | str, n: int, key: str, idx: str = "cal_idx", ratio: float = 0.8) -> Column:
    """value / value n positions back - 1, with enough values among the n + 1 positions."""
    v = F.col(value) if isinstance(value, str) else value
    enough = F.count(v).over(frame(key, idx, -n, 0)) >= min_periods(n + 1, ratio)
    return F.when(enough, F.try_divide(v, shift(v, n, key, idx)) - 1)


def momentum(d: DataFrame, key: str, windows: tuple[int, ...] = (5, 10, 20), close: str = "close", adjust: str = "adj_factor") -> DataFrame:
    v = F.col(close) * F.col(adjust)
    return d.withColumns({f"stock_return_{n}d": window_return(v, n, key) for n in windows})


def volatility(d: DataFrame, key: str, n: int = 20, pct: str = "pct_chg", year: int = 252) -> DataFrame:
    return d.withColumn(f"stock_volatility_{n}d", rolling(F.stddev_samp, F.col(pct) / 100, n, key, "cal_idx") * math.sqrt(year))


def rsi(d: DataFrame, key: str, n: int = 20, close: str = "close", before: str = "pre_close", adjust: str = "adj_factor") -> DataFrame:
    """Gains over all moves, in percent; 50 where nothing moved."""
    move = (F.col(close) - F.col(before)) * F.col(adjust)
    up = rolling(F.sum, F.greatest(move, F.lit(0.0)) + move * 0, n, key, "cal_idx")
    all_ = rolling(F.sum, F.abs(move), n, key, "cal_idx")
    return d.withColumn(f"stock_rsi_{n}d", F.when(all_ == 0, 50.0).otherwise(F.try_divide(up, all_) * 100))


def price_to_high(d: DataFrame, key: str, n: int = 20, close: str = "close", adjust: str = "adj_factor") -> DataFrame:
    v = F.col(close) * F.col(adjust)
    return d.withColumn(f"stock_price_to_high_{n}d", F.try_divide(v, rolling(F.max, v, n, key, "cal_idx")))


def percent_b(d: DataFrame, key: str, n: int = 20, close: str = "close", adjust: str = "adj_factor") -> DataFrame:
    """Place in the band of two population deviations about the mean."""
    v = F.col(close) * F.col(adjust)
    mean, std = rolling(F.avg, v, n, key, "cal_idx"), rolling(F.stddev_pop, v, n, key, "cal_idx")
    return d.withColumn(f"stock_percent_b_{n}d", F.when(std > 1e-12, (v - (mean - 2 * std)) / (4 * std)))


def amihud(d: DataFrame, key: str, n: int = 20, pct: str = "pct_chg", amount: str = "amount", scale: float = 1000.0, name: str | None = None) -> DataFrame:
    x = F.when(F.col(amount) > 0, F.abs(F.col(pct) / 100) / (F.col(amount) * scale))
    return d.withColumn(name or f"stock_amihud_{n}d", rolling(F.avg, x, n, key, "cal_idx") * 1e8)


def money_flow(d: DataFrame, key: str, n: int = 20, adjust: str = "adj_factor") -> DataFrame:
    """Money-flow index: volume at typical prices above the previous position's, in percent
    of volume with a direction; 50 where there is none."""
    d = d.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col(adjust))
    d = d.withColumn("_before", shift("_tp", 1, key, "cal_idx"))
    flow = F.when(F.col("vol") > 0, F.col("_tp") * F.col("vol"))
    known = F.col("_before").isNotNull() & flow.isNotNull()
    up = F.when(known, F.when(F.col("_tp") > F.col("_before"), flow).otherwise(0.0))
    down = F.when(known, F.when(F.col("_tp") < F.col("_before"), flow).otherwise(0.0))
    pos, neg = rolling(F.sum, up, n, key, "cal_idx"), rolling(F.sum, down, n, key, "cal_idx")
    return d.withColumn(f"stock_mfi_{n}d", F.when(pos + neg == 0, 50.0).otherwise(F.try_divide(100 * pos, pos + neg))).drop("_tp", "_before")


def bond_daily_return(d: DataFrame, key: str, date: str = "trade_date", pct: str = "pct_chg", close: str = "close") -> DataFrame:
    """pct / 100, else the change since the previous observed row, however far back."""
    before = F.lag(close).over(Window.partitionBy(key).orderBy(date))
    return d.withColumn("bond_return", F.coalesce(F.col(pct) / 100, F.try_divide(F.col(close), before) - 1))


def return_spread(d: DataFrame, key: str, windows: tuple[int, ...] = (5, 10, 20), bond: str = "bond_close", stock: str = "stock_adj") -> DataFrame:
    return d.withColumns({f"return_spread_{n}d": window_return(bond, n, key) - window_return(stock, n, key) for n in windows})


def beta_correlation(d: DataFrame, key: str, windows: tuple[int, ...] = (20, 60), bond: str = "bond_return", stock: str = "stock_return") -> DataFrame:
    """Beta and correlation of paired returns; a variance of nearly nothing gives null.

    Moments are differences of running sums (`long_frames`) of returns centred in their block, so a row costs the same for any length
    of window. Whether a window is constant is decided exactly, by the length of the run of equal pairs' values that it ends in.
    """
    on = F.col(bond).isNotNull() & F.col(stock).isNotNull()
    d = d.withColumn("_y", F.when(on, F.col(bond))).withColumn("_x", F.when(on, F.col(stock)))
    order = Window.partitionBy(key).orderBy("cal_idx")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_pairs": F.count("_x").over(so_far)} | {f"{c}_last": F.last(c, ignorenulls=True).over(past) for c in ("_x", "_y")})
    for c in ("_x", "_y"):  # how many paired rows in a row have had this value
        begun = F.when(on & ~F.col(c).eqNullSafe(F.col(f"{c}_last")), F.col("_pairs"))
        d = d.withColumn(f"{c}_run", F.col("_pairs") - F.last(begun, ignorenulls=True).over(so_far) + 1)
    d, w = long_frames(d, key, "cal_idx", max(windows))
    block = Window.partitionBy(key, "_block")
    d = d.withColumn("_u", F.col("_x") - F.avg("_x").over(block)).withColumn("_v", F.col("_y") - F.avg("_y").over(block))
    out = {}
    for n in windows:
        total = lambda c, n=n: running(F.sum, c, w, n)
        count = running(F.count, F.col("_x"), w, n)
        mean = {c: F.try_divide(total(F.col(c)), count) for c in ("_u", "_v")}
        moment = lambda a, b, count=count, mean=mean, total=total: F.try_divide(total(F.col(a) * F.col(b)), count) - mean[a] * mean[b]
        vx, vy = (F.when(F.col(f"{r}_run") >= count, 0.0).otherwise(F.greatest(moment(c, c), F.lit(0.0))) for r, c in (("_x", "_u"), ("_y", "_v")))
        out |= {f"_n{n}": count, f"_c{n}": moment("_u", "_v"), f"_vx{n}": vx, f"_vy{n}": vy}
    d = d.withColumns(out).where("_block_own").drop("_block", "_block_own", "_u", "_v", *(f"{c}{end}" for c in ("_x", "_y") for end in ("", "_last", "_run")), "_pairs")
    last = {}
    for n in windows:
        enough, cov, vx, vy = F.col(f"_n{n}") >= min_periods(n), F.col(f"_c{n}"), F.col(f"_vx{n}"), F.col(f"_vy{n}")
        last[f"beta_{n}d"] = F.when(enough & (vx > 1e-18), cov / vx)
        last[f"correlation_{n}d"] = F.when(enough & (vx > 1e-18) & (vy > 1e-18), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / (F.sqrt(vx) * F.sqrt(vy)))))
    return d.withColumns(last).drop(*out)


def underlying_map(d: DataFrame, key: str, stock: str) -> DataFrame:
    """(key, stock), one row a key; a key with two stocks is an error."""
    m = d.where(F.col(stock).isNotNull()).groupBy(key).agg(F.min(stock).alias(stock), F.max(stock).alias("_other"))
    return m.select(key, F.when(F.col(stock) == F.col("_other"), F.col(stock)).otherwise(F.raise_error(F.lit("a key has two stocks"))).alias(stock))


def bond_trading_base(d: DataFrame, price_scale: float = 1000.0, volume_scale: float = 1000.0, amount_scale: float = 10_000.0, slack: float = 0.02) -> DataFrame:
    """Adds vwap, vwap_unit_valid, turnover and notional. A row with no volume and no amount
    is an observed zero; one whose VWAP leaves the day's range is inconsistent."""
    vwap = F.when(F.col("vol") > 0, F.try_divide(F.col("amount") * price_scale, F.col("vol")))
    d = d.withColumn("vwap", vwap)
    inside = (F.col("vwap") >= F.col("low") - slack) & (F.col("vwap") <= F.col("high") + slack) & (F.col("low") > 0) & (F.col("high") > 0)
    d = d.withColumn("vwap_unit_valid", F.coalesce(inside, F.lit(False)))
    zero = (F.col("vol") == 0) & (F.col("amount") == 0)
    turnover = F.when(zero, 0.0).when(F.col("vwap_unit_valid") & (F.col("remain_size") > 0), F.col("vol") * volume_scale / F.col("remain_size"))
    return d.withColumn("turnover", turnover).withColumn("notional", F.when(F.col("vwap_unit_valid") & (F.col("amount") > 0), F.col("amount") * amount_scale))


def bond_trading(d: DataFrame, key: str, windows: tuple[int, ...] = (5, 10, 20), close: str = "close") -> DataFrame:
    """Returns, short-long momentum, abnormal turnover, amount z-score, illiquidity and the
    close against VWAP, on the columns of `bond_trading_base` and bond_return."""
    d = d.withColumns({f"cb_return_{n}d": window_return(close, n, key) for n in windows})
    d = d.withColumn("cb_short_long_momentum_5_20d", F.col("cb_return_5d") - F.col("cb_return_20d"))
    d, w = long_frames(d, key, "cal_idx", 61)  # the 60 positions before this one
    for n in (20, 60):
        count = running(F.count, F.col("turnover"), w, n, prior=True)
        mean = F.when(count >= min_periods(n), running(F.sum, F.col("turnover"), w, n, prior=True) / count)
        d = d.withColumn(f"cb_abnormal_turnover_{n}d", F.when(mean > 1e-12 * F.max(F.abs("turnover")).over(Window.partitionBy(key, "_block")), F.col("turnover") / mean))
    d, out = d.where("_block_own").drop("_block", "_block_own"), {}
    log_a = F.when(F.col("notional").isNotNull(), F.log("notional"))
    mean, std = (rolling(f, log_a, 20, key, "cal_idx", prior=True) for f in (F.avg, F.stddev_samp))
    out["cb_log_amount_zscore_20d"] = F.when(std > 1e-12, (log_a - mean) / std)
    illiquid = F.abs(F.col("bond_return")) / F.col("notional")
    out["cb_amihud_20d"] = F.when(F.col("notional").isNotNull(), rolling(F.avg, illiquid, 20, key, "cal_idx") * 1e8)
    d = d.withColumns(out).withColumn("cb_close_to_vwap", F.when(F.col("vwap_unit_valid"), F.try_divide(F.col(close), F.col("vwap")) - 1))
    return d.withColumn("cb_close_to_vwap_mean_5d", F.when(F.col("cb_close_to_vwap").isNotNull(), rolling(F.avg, F.col("cb_close_to_vwap"), 5, key, "cal_idx")))


def vwap_audit(d: DataFrame, exchange: Column, year: Column) -> DataFrame:
    """(exchange, year, n_rows, n_valid, valid_share): by exchange, by year and in all, in one pass."""
    base = d.select(exchange.alias("exchange"), year.alias("year"), F.col("vwap_unit_valid").cast("long").alias("ok")).where(d["vwap"].isNotNull())
    out = base.cube("exchange", "year").agg(F.count("*").alias("n_rows"), F.sum("ok").alias("n_valid"), F.grouping_id().alias("g")).where("g <> 0")
    return out.select("exchange", "year", "n_rows", "n_valid", (F.col("n_valid") / F.col("n_rows")).alias("valid_share"))


def coverage(panel: DataFrame, factors: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, factor, n_rows, n_observed, coverage)."""
    d = panel.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), *(F.count(f).alias(f) for f in factors))
    rows = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("n_observed"), (F.col(f) / F.col("n_rows")).alias("coverage")) for f in factors))
    return d.select(*(by or []), "n_rows", F.inline(rows))


def trading_gate(d: DataFrame, price_scale: float = 1000.0, slack: float = 0.02, minimum: float = 0.999) -> DataFrame:
    """One row: rows with volume, amount and range, those whose VWAP lies in the day's range, the
    others, the share, and whether it reaches the minimum."""
    valid = (F.col("vol") > 0) & (F.col("amount") > 0) & (F.col("low") > 0) & (F.col("high") > 0)
    vwap = F.try_divide(F.col("amount") * price_scale, F.col("vol"))
    inside = valid & (vwap >= F.col("low") - slack) & (vwap <= F.col("high") + slack)
    a = d.agg(F.count_if(valid).alias("n_vwap"), F.count_if(inside).alias("n_inside"))
    a = a.withColumn("n_excluded", F.col("n_vwap") - F.col("n_inside")).withColumn("inside_share", F.coalesce(F.try_divide("n_inside", "n_vwap"), F.lit(0.0)))
    return a.withColumn("gate_passed", F.col("inside_share") >= minimum)
