"""Evidence for a score: rank correlation with later returns, quantiles, horizons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TINY, average_rank, dealt, newey_west, normal_p, pearson
from .checks import mismatch

SCORE, RETURN = "processed_factor", "forward_return"


def ic_series(panel: DataFrame, by: list[str], score: str = SCORE, ret: str = RETURN, min_assets: int = 5) -> DataFrame:
    """Per group: complete rows, Pearson ic and Spearman rank_ic; null under `min_assets` or
    where either side is constant. The panel is read once and moved once, by group."""
    on = F.col(score).isNotNull() & F.col(ret).isNotNull()
    d = dealt(panel.select(*by, on.alias("_on"), F.when(on, F.col(score)).alias("_x"), F.when(on, F.col(ret)).alias("_y")), *by)
    d = d.withColumn("_rx", F.when(F.col("_on"), average_rank("_x", [*by, "_on"]))).withColumn("_ry", F.when(F.col("_on"), average_rank("_y", [*by, "_on"])))
    d = d.groupBy(*by).agg(F.count_if("_on").alias("n_assets"), pearson("_x", "_y").alias("ic"), pearson("_rx", "_ry").alias("rank_ic"))
    enough = F.col("n_assets") >= min_assets
    return d.select(*by, "n_assets", F.when(enough, F.col("ic")).alias("ic"), F.when(enough, F.col("rank_ic")).alias("rank_ic"))


def summarize_ic(series: DataFrame, by: list[str], date: str = "signal_date", periods: int = 26, lags: int = 5) -> DataFrame:
    """(by, metric, n, mean, std, positive_share, icir, nw_lags, nw_t, nw_p) of ic and rank_ic."""
    long = series.unpivot([*by, date], ["ic", "rank_ic"], "metric", "value")
    d = newey_west(long, [*by, "metric"], date, "value", lags)
    d = d.withColumn("icir", F.when((F.col("n") > 1) & (F.col("std") > 0), F.col("mean") / F.col("std") * math.sqrt(periods)))
    return d.withColumn("nw_p", F.when(F.col("nw_t").isNotNull(), normal_p("nw_t")))


def quantile_groups(panel: DataFrame, by: list[str], key: str, groups: int = 5, score: str = SCORE, ret: str = RETURN) -> DataFrame:
    """Complete rows with their group 1 (best) to `groups`: floor(position * k / n) + 1 by
    score descending, then key. A group with fewer rows than `groups` is an error."""
    d = panel.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    pos, n = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), key)) - 1, F.count("*").over(Window.partitionBy(*by))
    g = (F.floor(pos * groups / n) + 1).cast("int")
    return d.withColumn("_n", n).withColumn("quantile", g).withColumn("quantile", F.when(F.col("_n") >= groups, F.col("quantile")).otherwise(F.raise_error(F.lit("a date has too few assets")).cast("int"))).drop("_n")


def quantile_returns(grouped: DataFrame, by: list[str], groups: int = 5, ret: str = RETURN) -> DataFrame:
    """Mean return of each group as G1..Gk, their spread and half of it."""
    return _means(grouped, by, groups, ret).drop("universe")


def _means(grouped: DataFrame, by: list[str], groups: int, ret: str) -> DataFrame:
    """The columns of `quantile_returns` and the mean of all assets, `universe`, in one aggregate."""
    d = grouped.groupBy(*by).agg(*(F.avg(F.when(F.col("quantile") == k, F.col(ret))).alias(f"G{k}") for k in range(1, groups + 1)), F.avg(ret).alias("universe"))
    d = d.withColumn("spread_raw", F.col("G1") - F.col(f"G{groups}"))
    return d.withColumn("long_short", F.col("spread_raw") / 2)


def nav(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Running products of 1 + r as nav__<column>; a null return keeps the product and is null itself."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"nav__{c}": F.when(F.col(c).isNotNull(), F.product(1 + F.col(c)).over(w)) for c in columns})


def horizon_ir(panel: DataFrame, by: list[str], key: str, groups: int = 5, score: str = SCORE, ret: str = RETURN) -> DataFrame:
    """Quantile returns with the mean of all assets and the active return of the best group."""
    d = _means(quantile_groups(panel, by, key, groups, score, ret), by, groups, ret)
    return d.withColumn("active", F.col("G1") - F.col("universe"))


def summarize_ir(series: DataFrame, by: list[str], periods: int = 26) -> DataFrame:
    """Mean, deviation, hit rate and information ratio of active and spread_raw."""
    long = series.unpivot([*by], ["active", "spread_raw"], "metric", "value").where("value is not null")
    d = long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg((F.col("value") > 0).cast("double")).alias("hit_rate"))
    return d.withColumn("ir", F.when((F.col("n") > 1) & (F.col("std") > 0), F.col("mean") / F.col("std") * math.sqrt(periods)))


def nav_summary(navs: DataFrame, by: list[str], order: str, columns: list[str], periods: int = 26) -> DataFrame:
    """(by, column, n, final_nav, annual_return, max_drawdown) with the peak at 1 or more."""
    long = navs.unpivot([*by, order], [f"nav__{c}" for c in columns], "column", "value").where("value is not null")
    w = Window.partitionBy(*by, "column").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = long.withColumn("_dd", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(w)) - 1)
    d = d.groupBy(*by, "column").agg(F.count("*").alias("n"), F.max_by("value", order).alias("final_nav"), F.min("_dd").alias("max_drawdown"))
    return d.withColumn("annual_return", F.when(F.col("final_nav") > 0, F.pow("final_nav", periods / F.col("n")) - 1))


def horizon_summary(ic: DataFrame, returns: DataFrame, labels: DataFrame, by: str = "horizon_days", date: str = "signal_date", periods: int = 26) -> DataFrame:
    """A row a horizon: statistics of ic and rank_ic side by side, hit rates of active and spread
    returns, label rows and the share excluded, and final value, annual return and largest fall of
    four running products (G1, universe, active, spread)."""
    stats = summarize_ic(ic, [by], date, periods)
    a = stats.groupBy(by).pivot("metric", ["ic", "rank_ic"]).agg(F.first("mean").alias("mean"), F.first("positive_share").alias("positive_share"), F.first("icir").alias("icir"), F.first("nw_t").alias("nw_t"))
    b = summarize_ir(returns, [by], periods).groupBy(by).pivot("metric", ["active", "spread_raw"]).agg(F.first("ir").alias("ir"), F.first("hit_rate").alias("hit_rate"))
    c = labels.groupBy(by).agg(F.count("*").alias("label_rows"), F.count_if("label_usable").alias("usable_rows")).withColumn("excluded_share", 1 - F.col("usable_rows") / F.col("label_rows"))
    names = {"g1": "G1", "universe": "universe", "active": "active", "spread": "long_short"}
    runs = nav(returns.select(by, date, *(F.col(v).alias(k) for k, v in names.items())), [by], date, list(names))
    n = nav_summary(runs, [by], date, list(names), periods).withColumn("column", F.regexp_replace("column", "nav__", ""))
    n = n.groupBy(by).pivot("column", list(names)).agg(F.first("final_nav").alias("nav"), F.first("annual_return").alias("annual_return"), F.first("max_drawdown").alias("max_drawdown"))
    return a.join(b, by).join(c, by).join(n, by)


def verify_materialized(context: DataFrame, raw: DataFrame, processed: DataFrame, keys: list[str], factor: str, direction: int) -> DataFrame:
    """(raw_mismatches, processed_mismatches) of values stored in a context table, as `factor` and
    standardized__<factor>, with raw_factor and processed_factor recomputed; where both exist."""
    z = f"standardized__{factor}"
    d = context.select(*keys, F.col(factor).alias("_f"), F.col(z).alias("_z")).join(raw.select(*keys, "raw_factor"), keys, "full_outer").join(processed.select(*keys, SCORE), keys, "full_outer")
    off = lambda a, b: F.count_if(a.isNotNull() & b.isNotNull() & mismatch(a, b))
    return d.agg(off(F.col("_f"), F.col("raw_factor")).alias("raw_mismatches"), off(direction * F.col("_z"), F.col(SCORE)).alias("processed_mismatches"))


def annual_stability(series: DataFrame, returns: DataFrame, date: str = "signal_date") -> DataFrame:
    """(year, mean_rank_ic, hit_rate, compounded): by calendar year."""
    a = series.groupBy(F.year(date).alias("year")).agg(F.avg("rank_ic").alias("mean_rank_ic"), F.avg((F.col("rank_ic") > TINY).cast("double")).alias("hit_rate"))
    b = returns.groupBy(F.year(date).alias("year")).agg((F.product(1 + F.col("long_short")) - 1).alias("compounded"))
    return a.join(b, "year", "left")


def coverage_by_date(panel: DataFrame, date: str, raw: str, score: str = SCORE, ret: str = RETURN) -> DataFrame:
    return panel.groupBy(date).agg(F.count("*").alias("n_rows"), F.count(raw).alias("n_raw"), F.count(score).alias("n_processed"), F.count_if(F.col(score).isNotNull() & F.col(ret).isNotNull()).alias("n_labelled"))


def factor_summary(coverage: DataFrame, ic: DataFrame, returns: DataFrame, stability: DataFrame) -> DataFrame:
    """One row: coverage, rank IC, compounded long-short and the worst year."""
    a = coverage.agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_processed") / F.sum("n_rows")).alias("coverage"), F.count("*").alias("n_dates"))
    b = ic.where("metric = 'rank_ic'").select(F.col("mean").alias("mean_rank_ic"), F.col("icir").alias("rank_icir"), "nw_t")
    c = returns.agg((F.product(1 + F.col("long_short")) - 1).alias("long_short_total"))
    y = stability.agg(F.min_by("year", "compounded").alias("worst_year"), F.min("compounded").alias("worst_return"))
    return a.crossJoin(b).crossJoin(c).crossJoin(y)
