"""Trading calendars: positions, next open days, rebalance dates and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(dates: DataFrame, date: str = "trade_date") -> DataFrame:
    """(trade_date, cal_idx) of the distinct non-null dates; one row an open day, so small."""
    d = dates.select(F.col(date).cast("date").alias("trade_date")).where("trade_date is not null").distinct()
    return d.withColumn("cal_idx", F.row_number().over(Window.orderBy("trade_date")) - 1)


def open_dates(source: DataFrame, historical: DataFrame | None = None, date: str = "trade_date", is_open: str | None = "is_open") -> DataFrame:
    """Calendar of the open days of one source and all days of a second."""
    d = source.where(F.col(is_open) == 1) if is_open else source
    d = d.select(F.col(date).alias("trade_date"))
    return calendar(d.unionByName(historical.select(F.col(date).alias("trade_date"))) if historical is not None else d)


def day_table(cal: DataFrame, before: int = 40) -> DataFrame:
    """(day, next_open, same_or_next): a row for each day from `before` days ahead of the
    first open day up to the last. An equi-join on it replaces a search in the calendar."""
    ends = cal.agg(F.date_sub(F.min("trade_date"), before).alias("a"), F.max("trade_date").alias("b"))
    days = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    d = days.join(F.broadcast(cal.select("trade_date")), F.col("day") == F.col("trade_date"), "left")
    w = Window.orderBy("day")
    after = F.min("trade_date").over(w.rowsBetween(1, Window.unboundedFollowing))
    return d.select("day", after.alias("next_open"), F.coalesce("trade_date", after).alias("same_or_next"))


def next_open(df: DataFrame, date: str, cal: DataFrame, name: str, inclusive: bool = False) -> DataFrame:
    """Adds the first open day after the date (or on it, if `inclusive`); null past the end.
    Dates before the day table's start map to the first open day."""
    table, first = day_table(cal), cal.agg(F.min("trade_date").alias("_first"))
    t = table.select(F.col("day").alias("_day"), F.col("same_or_next" if inclusive else "next_open").alias("_open"))
    out = df.join(F.broadcast(t), F.col(date) == F.col("_day"), "left").crossJoin(F.broadcast(first))
    return out.withColumn(name, F.when(F.col(date) < F.col("_first"), F.col("_first")).otherwise(F.col("_open"))).drop("_day", "_open", "_first")


def rebalance_calendar(cal: DataFrame, anchor: str, start: str, end: str, interval: int = 14) -> DataFrame:
    """Anchors every `interval` days, moved to the same or next open day, with the entry on
    the open day after, and the next signal and entry."""
    days = cal.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(anchor)), F.to_date(F.lit(end)), F.expr(f"interval {interval} days"))).alias("anchor_date"))
    d = next_open(days.where(F.col("anchor_date") >= F.lit(start).cast("date")), "anchor_date", cal, "signal_date", inclusive=True)
    d = d.where(F.col("signal_date") <= F.lit(end).cast("date"))
    d = next_open(d, "signal_date", cal, "entry_date")
    w = Window.orderBy("signal_date")
    d = d.withColumn("holiday_shift_days", F.datediff("signal_date", "anchor_date"))
    d = d.withColumn("next_signal_date", F.lead("signal_date").over(w)).withColumn("next_entry_date", F.lead("entry_date").over(w))
    twice = F.count("*").over(Window.partitionBy("signal_date")) > 1
    return d.withColumn("signal_date", F.when(twice, F.raise_error(F.lit("two anchors fall on one signal date")).cast("date")).otherwise(F.col("signal_date")))


def execution_schedule(signals: DataFrame, cal: DataFrame) -> DataFrame:
    """(signal_date, entry_date, exit_date): in on the next open day, out on the next entry."""
    d = next_open(signals.select("signal_date").distinct(), "signal_date", cal, "entry_date")
    d = d.withColumn("exit_date", F.lead("entry_date").over(Window.orderBy("signal_date")))
    return d.where("entry_date is not null and exit_date is not null")


def partition_schedule(schedule: DataFrame, start: str, end: str) -> DataFrame:
    """The slice of a rebalance calendar with a flag for labels that stay inside it."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = schedule.where(F.col("signal_date").between(a, b)).select("signal_date", "entry_date", F.col("next_entry_date").alias("exit_date"))
    inside = F.coalesce((F.col("entry_date") > F.col("signal_date")) & (F.col("exit_date") <= b), F.lit(False))
    return d.withColumn("is_label_within_partition", inside).withColumn("schedule_reason", F.when(inside, "eligible").otherwise("partition_boundary"))


def horizon_schedules(signals: DataFrame, cal: DataFrame, horizons: list[int], end: str | None = None) -> DataFrame:
    """A row for each signal and horizon h: out h open days after the entry, null past the end."""
    d = next_open(signals.select("signal_date").distinct(), "signal_date", cal, "entry_date")
    pos = cal.select(F.col("trade_date").alias("entry_date"), F.col("cal_idx").alias("_i"))
    later = cal.select(F.col("trade_date").alias("exit_date"), F.col("cal_idx").alias("_j"))
    d = d.join(F.broadcast(pos), "entry_date", "left").select("signal_date", "entry_date", "_i", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_days"))
    d = d.join(F.broadcast(later), F.col("_i") + F.col("horizon_days") == F.col("_j"), "left")
    last = F.lit(end).cast("date") if end else F.to_date(F.lit("9999-12-31"))
    inside = F.coalesce((F.col("entry_date") > F.col("signal_date")) & (F.col("exit_date") <= last), F.lit(False))
    return d.select("signal_date", "horizon_days", "entry_date", "exit_date", inside.alias("is_label_within_partition"))


def listing_age(df: DataFrame, date: str, list_date: str, cal: DataFrame, minimum: int = 11, name: str = "listing_age") -> DataFrame:
    """Open days from listing to the date, both counted; a listing before the calendar
    starts counts as `minimum`."""
    at = cal.select(F.col("trade_date").alias(date), F.col("cal_idx").alias("_at"))
    d = next_open(df, list_date, cal, "_listed", inclusive=True)
    of = cal.select(F.col("trade_date").alias("_listed"), F.col("cal_idx").alias("_from"))
    first = cal.agg(F.min("trade_date").alias("_first"))
    d = d.join(F.broadcast(at), date, "left").join(F.broadcast(of), "_listed", "left").crossJoin(F.broadcast(first))
    age = F.when(F.col(list_date) < F.col("_first"), F.lit(minimum)).otherwise(F.col("_at") - F.col("_from") + 1)
    return d.withColumn(name, age).drop("_at", "_listed", "_from", "_first")


def month_windows(spark, start: str, end: str) -> DataFrame:
    """(window_start, window_end): calendar months of a range, clipped at both ends."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(a, "MM"), b, F.expr("interval 1 month"))).alias("m"))
    return months.select(F.greatest("m", a).alias("window_start"), F.least(F.last_day("m"), b).alias("window_end"))
