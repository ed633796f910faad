"""Correlations, average ranks and Newey-West statistics as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Correlations this near to nothing are not positive; rounding alone makes them differ.
TINY = 1e-12


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows moved by group, before windows that sort and hold whole groups. Spark merges pieces by their compressed size, and a sort of rows that
    compress well is many times as large: store the result (`folders.stored`), which merges them to a few MB only."""
    return df.repartition(*by)


def pearson(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs as an aggregate; null if either is constant."""
    on = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(on, F.col(x)), F.when(on, F.col(y))
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(value: str, by: list[str]) -> Column:
    """Ascending rank within `by`, ties sharing their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman_by(df: DataFrame, by: list[str], x: str, y: str, min_count: int = 2, name: str = "rank_ic") -> DataFrame:
    """Spearman correlation of complete pairs within `by`, null under `min_count` pairs or
    where either is constant. One shuffle by `by`."""
    d = dealt(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), *by)
    d = d.select(*by, average_rank(x, by).alias("_rx"), average_rank(y, by).alias("_ry"))
    return d.groupBy(*by).agg(F.when(F.count("*") >= min_count, pearson("_rx", "_ry")).alias(name))


def normal_p(t: Column | str) -> Column:
    """Two-sided normal probability of a statistic, to about 15 digits: below 3 by the series of the central
    part, above by the continued fraction of the tail. Null and NaN give null."""
    x = F.abs(F.col(t) if isinstance(t, str) else t)
    density = F.exp(-x * x / 2) * (2 / math.sqrt(2 * math.pi))
    step = lambda a, k: F.struct((a["term"] * x * x / (2 * k + 1)).alias("term"), (a["total"] + a["term"] * x * x / (2 * k + 1)).alias("total"))
    central = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("total")), step, lambda a: a["total"])
    tail = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), x, lambda a, k: x + k / a)
    return F.when(x < 3, 1 - density * central).when(~F.isnan(x), density / tail)


def newey_west(df: DataFrame, by: list[str], order: str, value: str, lags: int = 5) -> DataFrame:
    """Per group: n, mean, std (ddof 1), share above 0, nw_lags, nw_t of the mean with a
    Bartlett kernel. Null values are left out; nw_t is null for n < 2 or no variance."""
    d = df.where(F.col(value).isNotNull())
    whole, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    d = d.withColumn("_u", F.col(value) - F.avg(value).over(whole)).withColumn("_n", F.count("*").over(whole))
    d = d.withColumn("_l", F.least(F.lit(lags), F.col("_n") - 1))
    terms = [F.when(F.col("_l") >= k, 2 * (1 - k / (F.col("_l") + 1.0)) * F.col("_u") * F.lag("_u", k).over(w)) for k in range(1, lags + 1)]
    s = F.col("_u") * F.col("_u")
    for t in terms:
        s = s + F.coalesce(t, F.lit(0.0))
    d = d.withColumn("_s", s)
    std = F.stddev_samp(value)
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        std.alias("std"),
        F.avg((F.col(value) > TINY).cast("double")).alias("positive_share"),
        F.max("_l").alias("nw_lags"),
        F.when((F.count("*") > 1) & (std > 0), F.avg(value) / F.sqrt(F.sum("_s")) * F.count("*")).alias("nw_t"),
    )
