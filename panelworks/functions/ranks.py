"""Ranks and exact quantiles of large groups without sorting a group in one task.

Distinct values with their counts are dealt by range into pieces of about equal size, whatever their distribution:
Spark's own range partitioning samples the bounds, and the number of the partition that a value is written
from is its piece. Only the values of one piece are sorted together; what lies in lower pieces comes
from the pieces' counts. Values that repeat are one row, so a hot value is no hot piece.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored


def clean(value: str) -> Column:
    """The value as a double; NaN is null, and infinities are the least and the greatest of values."""
    x = F.col(value).cast("double")
    return F.when(~F.isnan(x), x)


def dealt_values(df: DataFrame, by: list[str], value: str, counts: Mapping[str, Column], pieces: int | None = None) -> DataFrame:
    """(by, value, counts, _piece): a stored row for each distinct value of a group, with the aggregates `counts`, in pieces
    that rise with (by, value). Rows with a null or NaN value, or a null group, are left out. `df` is read once."""
    d = df.withColumn(value, clean(value)).where(" and ".join(f"`{c}` is not null" for c in [*by, value]))
    v = d.groupBy(*by, value).agg(*(c.alias(n) for n, c in counts.items()))
    ranged = v.repartitionByRange(*([pieces] if pieces else []), *by, value)
    return stored(ranged.withColumn("_piece", F.spark_partition_id()), "dealt-values")


def below(v: DataFrame, by: list[str], value: str, n: list[str]) -> DataFrame:
    """Rows of `dealt_values` with `<n>_below`, for each count n the sum over lower values of the group."""
    totals = v.groupBy(*by, "_piece").agg(*(F.sum(c).alias(f"{c}_t") for c in n))
    lower = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_piece", *(F.coalesce(F.sum(f"{c}_t").over(lower), F.lit(0)).alias(f"{c}_o") for c in n))
    inside = Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = v.select(*by, value, "_piece", *n, *(F.sum(c).over(inside).alias(f"{c}_i") for c in n)).join(offsets, [*by, "_piece"])
    return d.select(*by, value, *n, *((F.col(f"{c}_o") + F.col(f"{c}_i") - F.col(c)).alias(f"{c}_below") for c in n))


def global_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the ascending rank within `by`, ties sharing their mean rank. Infinities are ranked as
    the least and the greatest; rows with a null or NaN value, or a null group, go."""
    v = below(dealt_values(df, by, value, {"_c": F.count("*")}), by, value, ["_c"])
    ranks = v.select(*by, value, (F.col("_c_below") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.withColumn(value, clean(value)).join(ranks, [*by, value])


def exact_quantiles(df: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """(by, point, value): linear interpolation between the two nearest of the n sorted values, at
    point * (n - 1). Nulls and NaN are left out, infinities are the ends; a group
    without values has no row. `df` is read once."""
    keys = by or ["_all"]
    d = df if by else df.withColumn("_all", F.lit(0))
    v = dealt_values(d.select(*keys, F.col(value).alias("_x")), keys, "_x", {"_c": F.count("*")})
    whole, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    t = v.groupBy(*keys, "_piece").agg(F.sum("_c").alias("_t")).withColumn("_to", F.sum("_t").over(up_to)).withColumn("_n", F.sum("_t").over(whole))
    at = F.col("_point") * (F.col("_n") - 1)
    want = t.withColumn("_point", F.explode(F.array(*(F.lit(float(p)) for p in points)))).withColumn("_share", at - F.floor(at)).withColumn("_place", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    want = want.where("_place >= _to - _t and _place < _to").select(*keys, "_piece", "_point", "_place", "_share", (F.col("_to") - F.col("_t")).alias("_from"))
    inside = Window.partitionBy(*keys, "_piece").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    some = v.join(want.select(*keys, "_piece").distinct(), [*keys, "_piece"], "left_semi").withColumn("_end", F.sum("_c").over(inside))
    got = want.join(some, [*keys, "_piece"]).where("_place - _from >= _end - _c and _place - _from < _end")
    got = got.groupBy(*keys, "_point").agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.max("_share").alias("_s"))
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_s"))
    return got.select(*by, F.col("_point").alias("point"), between.alias("value"))
