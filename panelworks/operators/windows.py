"""Frames over calendar positions: n steps back means n open days, whatever rows exist."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def frame(key: str | list[str], idx: str, start: int, end: int) -> WindowSpec:
    """Rows of the key whose calendar position lies start..end steps from the row's."""
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(idx).rangeBetween(start, end)


def shift(value: Column | str, steps: int, key: str | list[str], idx: str) -> Column:
    """The value exactly `steps` positions back; null if the key has no row there."""
    return F.max(value).over(frame(key, idx, -steps, -steps))


def min_periods(n: int, ratio: float = 0.8) -> int:
    return math.ceil(n * ratio)


def rolling(agg, value: Column, n: int, key: str | list[str], idx: str, need: int | None = None, prior: bool = False) -> Column:
    """`agg` over the last n positions (with `prior`, the n before this one), null with
    fewer than `need` values."""
    w = frame(key, idx, -n, -1) if prior else frame(key, idx, -(n - 1), 0)
    return F.when(F.count(value).over(w) >= (min_periods(n) if need is None else need), agg(value).over(w))


def long_frames(d: DataFrame, key: str, idx: str, steps: int, name: str = "_block") -> tuple[DataFrame, WindowSpec]:
    """Rows and a window for sums over up to `steps` positions that cost the same at any length.

    A key's positions are cut into blocks of `steps`; each row is in its own block and once more in the next one, where it only lends its
    values (`<name>_own` is false). A frame of at most `steps` positions lies in a block and the one before, so it is the
    difference of two sums that start at the edge of the block before (`running`): they grow row by row and are never
    added up anew, and they start afresh in every block, which bounds their rounding. Take the rows where
    `<name>_own` holds when all sums are made. A key's blocks are groups of their own, so a hot key is no hot task.
    """
    at = F.floor(F.col(idx) / steps)
    d = d.withColumn(f"{name}_at", at).withColumn(name, F.explode(F.array(F.col(f"{name}_at"), F.col(f"{name}_at") + 1)))
    d = d.withColumn(f"{name}_own", F.col(name) == F.col(f"{name}_at")).drop(f"{name}_at")
    return d, Window.partitionBy(key, name).orderBy(idx)


def running(agg, value: Column, w: WindowSpec, n: int, prior: bool = False) -> Column:
    """`agg` (a sum or a count) of the last n positions, with `prior` of the n before this one, in a window of `long_frames`; 0 without values."""
    up_to = lambda end: F.coalesce(agg(value).over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    return up_to(-1) - up_to(-n - 1) if prior else up_to(0) - up_to(-n)
