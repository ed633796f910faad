"""Joins of points with the intervals that hold them, without comparing every point with every interval.

An interval [start, end) over whole numbers or days is split at the edges of bins of 1, 2, 4, ... positions
into the largest bins that it fills, at most two of each size. A point lies in one bin of each size. Point and
interval then meet in exactly one bin if the interval holds the point, and in none otherwise, so
the join is an equality of bins: no bounds are compared and nothing is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import stored

#: Bins of up to 2**LEVELS positions; days need no more than 22 in all of the calendar.
LEVELS = 40


def _position(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind in ("byte", "short", "integer", "long"):
        return F.col(c).cast("long")
    raise TypeError(f"{c} must hold dates or whole numbers, not {kind}")


def interval_bins(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """Array of structs (level, bin): the largest bins that [start, end) fills, in which it is split."""
    out = []
    for k in range(levels + 1):
        low, high = F.shiftright(start + F.lit((1 << k) - 1), k), F.shiftright(end, k)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        more = low < high
        if k == levels:  # what is longer still is filled by bins of the largest size
            every = F.when(more, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.concat(F.filter(F.array(*out), lambda x: x["bin"].isNotNull()), F.transform(every, lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"))))
        out.append(F.struct(F.lit(k).alias("level"), F.when(more & odd(low), low).alias("bin")))
        out.append(F.struct(F.lit(k).alias("level"), F.when(more & odd(high), high - 1).alias("bin")))
    raise ValueError("levels must not be negative")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Each point with each interval (of equal `keys`, if any are given) that has start <= at < end: all columns of the point,
    then those of the interval but for the keys; a name that both have ends in `_interval` there.

    Dates and whole numbers are positions. Points and intervals with a null bound or key, and intervals that do
    not end after they start, join nothing; repeated rows count each time. Of the bin sizes only those that
    intervals have are looked up (one small job reads them: a number for each size). With `hot_rows`, a bin that more points than
    that lie in is dealt over several tasks, and its intervals are sent to each; it costs a count of points by bin, and points in their bins are written once.
    """
    keys = keys or []
    clash = {c: f"{c}_interval" if c in points.columns else c for c in intervals.columns if c not in keys}
    own = [f"_k{i}" for i in range(len(keys))]
    live = lambda df, *cols: df.where(" and ".join(f"`{c}` is not null" for c in [*cols, *keys]))
    names = lambda: (F.col(k).alias(o) for k, o in zip(keys, own, strict=True))
    spans = live(intervals, start, end).where(_position(intervals, start) < _position(intervals, end))
    spans = spans.select(*names(), F.struct(*(F.col(c).alias(n) for c, n in clash.items())).alias("_span"), F.explode(interval_bins(_position(intervals, start), _position(intervals, end))).alias("_b"))
    spans = stored(spans.select(*own, "_span", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")), "interval-bins")
    used = sorted(r["_level"] for r in spans.select("_level").distinct().collect())  # LEVELS + 1 rows at most
    bins = F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright(_position(points, at), k).alias("_bin")) for k in used or [0]))
    dots = live(points, at).select(*names(), F.struct(*(F.col(c) for c in points.columns)).alias("_point"), F.inline(bins))
    on = [*own, "_level", "_bin"]
    if hot_rows is not None:
        dots = stored(dots.withColumn("_salt", F.rand(7)), "interval-points")  # drawn once, so that a task that is run again deals the same
        heavy = dots.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
        heavy = stored(heavy, "hot-bins")
        deal = F.floor(F.col("_salt") * F.coalesce("_parts", F.lit(1))).cast("int")
        dots = dots.join(heavy, on, "left").withColumn("_part", deal).drop("_parts", "_salt")
        spans = spans.join(heavy, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        on = [*on, "_part"]
    return dots.join(spans, on).select("_point.*", "_span.*")


def interval_totals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, count: str = "n", sums: dict[str, str] | None = None) -> DataFrame:
    """Each interval with the number `count` of the points (of equal `keys`, if any are given) that have start <= at < end, and their `sums` (name ->
    column of the points): all columns of the interval, then those. What `interval_join` and an aggregate give, without a row for each pair.

    Points are added up by position and then by bin; an interval adds up the bins in which it is split, at most two of each size, and
    equal intervals do so once. Work follows the rows of both sides, however many points an interval holds, and a hot bin is one row. Nothing is
    subtracted, so a sum of doubles is as exact as one over the points. Intervals that hold no point have no row; repeated rows each have theirs.
    """
    keys, sums = keys or [], sums or {}
    own, added = [f"_k{i}" for i in range(len(keys))], ["_n", *(f"_s{i}" for i in range(len(sums)))]
    live = lambda df, *cols: df.where(" and ".join(f"`{c}` is not null" for c in [*cols, *keys]))
    names = lambda: (F.col(k).alias(o) for k, o in zip(keys, own, strict=True))
    total = lambda d, by: d.groupBy(*by).agg(*(F.sum(c).alias(c) for c in added))
    bounds, on = [*own, "_from", "_to"], [*own, "_level", "_bin"]
    each = live(intervals, start, end).select("*", *names(), _position(intervals, start).alias("_from"), _position(intervals, end).alias("_to")).where("_from < _to")
    spans = each.select(*bounds).distinct().select(*bounds, F.explode(interval_bins(F.col("_from"), F.col("_to"))).alias("_b"))
    spans = stored(spans.select(*bounds, F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")), "interval-bins")
    used = sorted(r["_level"] for r in spans.select("_level").distinct().collect())  # LEVELS + 1 rows at most
    levels = F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright("_at", k).alias("_bin")) for k in used or [0]))
    dots = live(points, at).select(*names(), _position(points, at).alias("_at"), F.lit(1).alias("_n"), *(F.col(c).alias(s) for c, s in zip(sums.values(), added[1:], strict=True)))
    bins = total(total(dots, [*own, "_at"]).select(*own, *added, F.inline(levels)), on)
    found = total(spans.join(bins, on), bounds)
    return each.join(found, bounds).select(*intervals.columns, *(F.col(s).alias(n) for s, n in zip(added, [count, *sums], strict=True)))
