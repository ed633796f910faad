"""Backward as-of joins: by union and one window, a single shuffle that can spill; or, for hot keys, in pieces of
a key's history, with the state carried over their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored


def _timeline(panel: DataFrame, events: DataFrame, key: str, date: str, effective: str, state: list[str]) -> DataFrame:
    """(_key, _date, _side, _row, _event): events (side 0) and panel rows (side 1) in one table."""
    event = F.struct(*[F.col(s) for s in state], F.col(effective).alias("_eff"))
    kind = events.select(event.alias("e")).schema["e"].dataType
    row = panel.select(F.struct(*[F.col(f"`{c}`") for c in panel.columns]).alias("_row"), F.col(key).alias("_key"), F.col(date).alias("_date"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_event"))
    left = events.where(F.col(effective).isNotNull()).select(F.lit(None).cast(row.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), F.col(effective).alias("_date"), F.lit(0).alias("_side"), event.alias("_event"))
    return left.unionByName(row)


def _attached(d: DataFrame, state: list[str], keep_effective: str | None) -> DataFrame:
    """The panel's rows of a timeline with the columns of their event."""
    d = d.where("_side = 1").withColumn("_event", F.when(F.col("_key").isNotNull() & F.col("_date").isNotNull(), F.col("_event")))
    return d.select("_row.*", *(F.col(f"_event.{s}").alias(s) for s in state), *([F.col("_event._eff").alias(keep_effective)] if keep_effective else []))


def asof_backward(panel: DataFrame, events: DataFrame, key: str, date: str, effective: str, state: list[str], keep_effective: str | None = None) -> DataFrame:
    """Each panel row with the state of its key's latest event on or before the row's date.

    A null in the latest event's state stays null, as the event is carried whole. Events
    must be unique by (key, effective). Rows without an earlier event, and rows with a null
    key or date, get nulls. Extra columns pass through.
    """
    w = Window.partitionBy("_key").orderBy("_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    d = _timeline(panel, events, key, date, effective, state).withColumn("_event", F.last("_event", ignorenulls=True).over(w))
    return _attached(d, state, keep_effective)


def latest_states(line: DataFrame, key: str, states: dict[str, str]) -> DataFrame:
    """Rows of a timeline (key, _date, _side, ...) with, for each column of `states`, its last value that is not null up to the row, under the new name:
    several kinds of events in one window. At equal dates lower sides come first; rows without a date come before all others. The key stays a
    column of its own, so that later windows by it move nothing."""
    w = Window.partitionBy(key).orderBy("_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumns({new: F.last(c, ignorenulls=True).over(w) for c, new in states.items()})


def asof_spread(panel: DataFrame, events: DataFrame, key: str, date: str, effective: str, state: list[str], keep_effective: str | None = None, pieces: int | None = None) -> DataFrame:
    """The rows of `asof_backward`, for keys that hold a large share of all rows.

    The timeline of all keys is dealt by range of (key, date) into `pieces` (by default Spark's number of shuffle partitions) and
    stored, so that a hot key's history lies in several; what a row finds within its piece is a window, and the last event of
    earlier pieces, a row for each key and piece, is carried in where it finds none. Rows of one key and
    date stay together. The timeline is written when the plan is built.
    """
    line = _timeline(panel, events, key, date, effective, state)
    line = stored(line.repartitionByRange(*([pieces] if pieces else []), "_key", "_date").withColumn("_piece", F.spark_partition_id()), "timeline")
    ends = line.groupBy("_key", "_piece").agg(F.max_by("_event", F.when(F.col("_side") == 0, F.col("_date"))).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_piece", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    w = Window.partitionBy("_key", "_piece").orderBy("_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    d = line.withColumn("_event", F.last("_event", ignorenulls=True).over(w)).where("_side = 1").join(carried, ["_key", "_piece"], "left")
    return _attached(d.withColumn("_event", F.coalesce("_event", "_carried")), state, keep_effective)
