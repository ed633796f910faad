"""Portfolio weights from scores, and ledgers: targets, cohorts, buffers, returns, metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import first_match
from .intervals import interval_join

SCORE = "processed_factor"


def ranked(scores: DataFrame, key: str, date: str = "signal_date", score: str = SCORE, by: list[str] | None = None) -> DataFrame:
    """Candidates (entry allowed, no exit required, finite score) with `position` from 1 by
    score descending, then key."""
    d = scores.where(F.col("entry_allowed") & ~F.col("exit_required") & F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    return d.withColumn("position", F.row_number().over(Window.partitionBy(*(by or []), date).orderBy(F.col(score).desc(), key)))


def materialize_scores(context: DataFrame, factor: DataFrame, direction: int, n_mad: float = 3.0) -> DataFrame:
    """Signed scores of a factor frame (signal_date, code, raw_factor) with the context's flags."""
    from .cross_section import preprocess_registered

    d = preprocess_registered(factor, "raw_factor", "signal_date", direction, n_mad)
    flags = context.select("signal_date", "code", "entry_allowed", "exit_required")
    return d.select("signal_date", "code", SCORE).join(flags, ["signal_date", "code"])


def top_targets(scores: DataFrame, key: str, n: int = 20, cash: float = 0.1, cap: float = 0.1, date: str = "signal_date", score: str = SCORE) -> DataFrame:
    """Equal weights of the best n of each date, at most `cap`, and the cash that is left."""
    d = ranked(scores, key, date, score).where(F.col("position") <= n)
    w = Window.partitionBy(date)
    d = d.withColumn("target_weight", F.least(F.lit(cap), (1 - cash) / F.count("*").over(w)))
    return d.select(date, key, "position", "target_weight", (1 - F.sum("target_weight").over(w)).alias("implied_cash"))


class CohortBook(NamedTuple):
    """What a run of cohorts leaves for the next: stored, it lets new signals extend the book."""

    #: (date, entry_date, exit_date, n_names, asked, given, status), a row for each signal.
    headers: DataFrame
    #: (key, entry_date, exit_date, weight), a row for each name that a cohort bought.
    parts: DataFrame


def cohort_book(scores: DataFrame, schedule: DataFrame, key: str, n: int = 20, cash: float = 0.1, cap: float = 0.1, date: str = "signal_date", score: str = SCORE, before: CohortBook | None = None) -> CohortBook:
    """A book of cohorts that are bought at entry and sold at exit.

    Each signal's cohort asks for its best n at equal weight up to `cap` each; it gets what
    1 - cash leaves beside the cohorts still held, exits before entries. The recursion goes over signals
    in the order of their entries and keeps the cohorts that are active, so it takes time in proportion to the signals. With
    `before`, whose signals all entered earlier, only the new signals of `schedule` are gone through; the cohorts that are still
    active then, a few rows, come from its headers. The new book does not repeat the old one's rows.
    """
    days = schedule.select(F.col("signal_date").alias(date), "entry_date", "exit_date")
    best = ranked(scores, key, date, score).where(F.col("position") <= n).join(F.broadcast(days), date)
    asked = days.join(best.groupBy(date).agg(F.count("*").alias("n_names")), date, "left").na.fill(0, ["n_names"])
    asked = asked.select(date, "entry_date", "exit_date", "n_names", (F.col("n_names") * F.least(F.lit(cap), F.when(F.col("n_names") > 0, (1 - cash) / F.col("n_names")).otherwise(0.0))).alias("asked"))
    active: list[tuple] = []
    if before is not None:
        first = days.agg(F.min("entry_date").alias("_first"))
        held = before.headers.join(F.broadcast(first), F.col("exit_date") > F.col("_first")).where("given > 0")
        active = [(r["exit_date"], r["given"]) for r in held.select("exit_date", "given").collect()]
    fields = T.StructType([*asked.schema.fields, T.StructField("given", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(active)
        for batch in batches:
            given = []
            for entry, end, want in zip(*(batch[c].to_pylist() for c in ("entry_date", "exit_date", "asked")), strict=True):
                held = [c for c in held if c[0] > entry]
                given.append(max(0.0, min(want, 1 - cash - sum(g for _, g in held))))
                held.append((end, given[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(given, pa.float64())], names=fields.names)

    headers = asked.coalesce(1).sortWithinPartitions("entry_date", "exit_date", date).mapInArrow(fold, fields)
    status = first_match((F.col("n_names") == 0, "skipped_no_candidates"), (F.col("given") <= 1e-12, "skipped_no_capacity"), (F.col("given") < F.col("asked") - 1e-12, "partially_allocated"), default="allocated")
    headers = headers.withColumn("status", status)
    parts = best.join(headers.where("given > 1e-12").select(date, "given", F.col("n_names").alias("_names")), date)
    return CohortBook(headers, parts.select(key, "entry_date", "exit_date", (F.col("given") / F.col("_names")).alias("weight")))


def cohorts(scores: DataFrame, schedule: DataFrame, key: str, n: int = 20, cash: float = 0.1, cap: float = 0.1, date: str = "signal_date", score: str = SCORE) -> tuple[DataFrame, DataFrame]:
    """(headers, weights) of a `cohort_book`: weights (execution_date, key, target_weight) on the dates that change them."""
    headers, parts = cohort_book(scores, schedule, key, n, cash, cap, date, score)
    moves = parts.select(F.col("entry_date").alias("event_date"), key, "weight").unionByName(parts.select(F.col("exit_date").alias("event_date"), key, (-F.col("weight")).alias("weight")))
    net = moves.groupBy("event_date", key).agg(F.sum("weight").alias("_move"))
    total = F.sum("_move").over(Window.partitionBy(key).orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0))
    weight = F.when(F.abs(total) < 1e-12, 0.0).otherwise(total)
    return headers, net.select(F.col("event_date").alias("execution_date"), key, weight.alias("target_weight"))


def cohort_snapshots(parts: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """(execution_date, key, n_cohorts, target_weight): all that a book holds after each date on which a cohort is bought or sold,
    from the parts of a `cohort_book` (several books of one history may be put together). A name is held while entry_date <= date <
    exit_date. On a date that leaves nothing, what was sold that day has weight 0. The parts are
    joined with the dates by interval bins."""
    dates = parts.select(F.col("entry_date").alias("execution_date")).union(parts.select("exit_date")).distinct()
    held = interval_join(dates, parts, "execution_date", "entry_date", "exit_date", hot_rows=hot_rows)
    held = held.groupBy("execution_date", key).agg(F.count("*").alias("n_cohorts"), F.sum("weight").alias("target_weight"))
    flat = dates.join(held.select("execution_date").distinct(), "execution_date", "left_anti")
    sold = parts.select(F.col("exit_date").alias("execution_date"), key).join(flat, "execution_date").distinct()
    return held.unionByName(sold.select("execution_date", key, F.lit(0).cast("long").alias("n_cohorts"), F.lit(0.0).alias("target_weight")))


def buffered(scores: DataFrame, key: str, n: int = 20, exits: tuple[int, ...] = (20, 25, 30, 40), cash: float = 0.1, cap: float = 0.1, date: str = "signal_date", score: str = SCORE, start: DataFrame | None = None) -> DataFrame:
    """(exit_rank, date, slot, key, retained, target_weight): n slots; a holding stays while its
    position is at most the exit rank, vacant slots take the best others, lowest slot first. All
    dates of `scores` count; one without candidates empties the slots.

    Only names up to the exit rank matter, so the recursion, one portfolio after the other in the order of dates, reads a row with
    at most exit-rank names a date, and keeps n slots; it takes time in proportion to the dates. `start`, a `book_snapshot`, fills the
    slots before the first date: later dates extend a stored book without going through its history.
    """
    if min(exits) < n:
        raise ValueError("an exit rank is below the number of slots")
    kind = scores.schema[key]
    k = scores.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, exits))).alias("exit_rank"))
    d = ranked(scores, key, date, score).where(F.col("position") <= max(exits)).select(date, key, "position").join(F.broadcast(k), F.col("position") <= F.col("exit_rank"))
    lists = d.groupBy("exit_rank", date).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", key))), lambda x: x[key]).alias("names"))
    lists = scores.select(date).distinct().crossJoin(F.broadcast(k)).join(lists, ["exit_rank", date], "left").withColumn("names", F.coalesce("names", F.array().cast(T.ArrayType(kind.dataType))))
    held: dict[int, list] = {}
    for r in start.collect() if start is not None else ():  # n rows for each exit rank at most
        held.setdefault(r["exit_rank"], [None] * n)[r["slot"] - 1] = r[key]
    fields = T.StructType([lists.schema["exit_rank"], lists.schema[date], T.StructField("slot", T.IntegerType()), T.StructField(key, kind.dataType), T.StructField("retained", T.BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, slots = None, []
        for batch in batches:
            rows = []
            for r, day, names in zip(*(batch[c].to_pylist() for c in ("exit_rank", date, "names")), strict=True):
                if r != rank:
                    rank, slots = r, list(held.get(r, [None] * n))
                able, kept = set(names), {s for s in slots if s is not None}
                slots = [s if s in able else None for s in slots]
                others = (x for x in names if x not in kept)
                for i, s in enumerate(slots):
                    slots[i] = next(others, None) if s is None else s
                    if slots[i] is not None:
                        rows.append((r, day, i + 1, slots[i], s is not None))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((batch["exit_rank"].type, batch[date].type, pa.int32(), batch["names"].type.value_type, pa.bool_()))], names=fields.names)

    out = lists.repartition("exit_rank").sortWithinPartitions("exit_rank", date).mapInArrow(fold, fields)
    weight = F.least(F.lit(cap), (1 - cash) / F.count("*").over(Window.partitionBy("exit_rank", date)))
    return out.withColumn("target_weight", weight)


def book_snapshot(book: DataFrame, key: str, day: str | None = None, date: str = "signal_date") -> DataFrame:
    """(exit_rank, slot, key): what a book of `buffered` holds on a date, its last one if none is given; a date on which it holds nothing has
    no rows."""
    on = F.lit(day).cast("date") if day is not None else None
    last = book if on is not None else book.join(F.broadcast(book.agg(F.max(date).alias("_last"))), F.col(date) == F.col("_last"))
    return (last.where(F.col(date) == on) if on is not None else last).select("exit_rank", "slot", key)


def buffer_audit(book: DataFrame, scores: DataFrame, key: str, date: str = "signal_date", score: str = SCORE) -> DataFrame:
    """(exit_rank, date, n_eligible, n_selected, n_retained, n_entered, n_exited, gross_weight)
    of a book of `buffered`, for all dates of `scores`; retained, entered and exited compare
    with the holdings of the date before."""
    days = scores.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    able = ranked(scores, key, date, score).groupBy(date).agg(F.count("*").alias("n_eligible"))
    days = days.join(able, date, "left").na.fill(0, ["n_eligible"])
    held = book.join(F.broadcast(days.select(date, "_i")), date)
    before = F.lag("_i").over(Window.partitionBy("exit_rank", key).orderBy(date)) == F.col("_i") - 1
    d = held.withColumn("_kept", F.coalesce(before, F.lit(False))).groupBy("exit_rank", date).agg(F.count("*").alias("n_selected"), F.count_if("_kept").alias("n_retained"), F.sum("target_weight").alias("gross_weight"))
    grid = book.select("exit_rank").distinct().crossJoin(F.broadcast(days)).join(d, ["exit_rank", date], "left").na.fill(0, ["n_selected", "n_retained"]).na.fill(0.0, ["gross_weight"])
    last = F.coalesce(F.lag("n_selected").over(Window.partitionBy("exit_rank").orderBy(date)), F.lit(0))
    grid = grid.withColumn("n_entered", F.col("n_selected") - F.col("n_retained")).withColumn("n_exited", last - F.col("n_retained"))
    return grid.select("exit_rank", date, "n_eligible", "n_selected", "n_retained", "n_entered", "n_exited", "gross_weight")


def buffer_targets(book: DataFrame, schedule: DataFrame, key: str, liquidation_date: str | None = None, date: str = "signal_date") -> DataFrame:
    """(exit_rank, execution_date, key, target_weight) on entry dates; on a liquidation date, which
    must come after the last entry, zeros for what the last date held."""
    days = schedule.select(F.col("signal_date").alias(date), F.col("entry_date").alias("execution_date"))
    out = book.join(F.broadcast(days), date).select("exit_rank", "execution_date", key, "target_weight")
    if liquidation_date is None:
        return out
    end = F.lit(liquidation_date).cast("date")
    last = days.agg(F.max("execution_date").alias("_entry"), F.max(date).alias("_date"))
    late = F.when(F.col("_entry") < end, end).otherwise(F.raise_error(F.lit("the liquidation is not after the last entry")).cast("date"))
    final = book.join(F.broadcast(last), F.col(date) == F.col("_date")).select("exit_rank", late.alias("execution_date"), key, F.lit(0.0).alias("target_weight"))
    return out.unionByName(final)


def buffer_sensitivity(audit: DataFrame) -> DataFrame:
    """Means by exit rank of a `buffer_audit`: (exit_rank, n_dates, mean_held, mean_retained, mean_entered, mean_exited)."""
    means = {"mean_held": "n_selected", "mean_retained": "n_retained", "mean_entered": "n_entered", "mean_exited": "n_exited"}
    return audit.groupBy("exit_rank").agg(F.count("*").alias("n_dates"), *(F.avg(c).alias(n) for n, c in means.items()))


def order_feasibility(targets: DataFrame, market: DataFrame, key: str, date: str = "execution_date") -> DataFrame:
    """Planned weight changes against the day's flags: (side, outcome, n_orders, weight)."""
    before = F.coalesce(F.lag("target_weight").over(Window.partitionBy(key).orderBy(date)), F.lit(0.0))
    d = targets.withColumn("_change", F.col("target_weight") - before).where(F.abs("_change") > 1e-12)
    d = d.join(market.select(key, F.col("trade_date").alias(date), "buy_allowed", "sell_allowed", "has_market_observation", "has_positive_trade"), [key, date], "left")
    side = F.when(F.col("_change") > 0, "buy").otherwise("sell")
    ok = F.when(F.col("_change") > 0, F.col("buy_allowed")).otherwise(F.col("sell_allowed"))
    outcome = first_match((F.col("has_market_observation").isNull() | ~F.col("has_market_observation"), "no_quote"), (~F.col("has_positive_trade"), "no_trade"), (ok, "feasible"), default="one_price_block")
    return d.groupBy(side.alias("side"), outcome.alias("outcome")).agg(F.count("*").alias("n_orders"), F.sum(F.abs("_change")).alias("weight"))


def weight_returns(targets: DataFrame, market: DataFrame, key: str, cost_rate: float = 0.0015, date: str = "execution_date") -> DataFrame:
    """(trade_date, gross_return, turnover, cost, net_return, nav): the targets as of the
    day before earn the close return; costs on the sum of absolute weight changes. A key keeps
    its weight until its next target row, so exits need rows with weight 0."""
    from .asof import asof_backward

    w = Window.partitionBy(key).orderBy("trade_date")
    bars = market.select(key, "trade_date", "close").withColumn("_r", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("_prev", F.lag("trade_date").over(w))
    held = asof_backward(bars, targets.select(key, F.col(date).alias("_on"), "target_weight"), key, "_prev", "_on", ["target_weight"])
    gross = held.groupBy("trade_date").agg(F.coalesce(F.sum(F.col("target_weight") * F.col("_r")), F.lit(0.0)).alias("gross_return"))
    change = F.col("target_weight") - F.coalesce(F.lag("target_weight").over(Window.partitionBy(key).orderBy(date)), F.lit(0.0))
    turn = targets.withColumn("_c", F.abs(change)).groupBy(F.col(date).alias("trade_date")).agg(F.sum("_c").alias("turnover"))
    d = gross.join(turn, "trade_date", "left").na.fill(0.0, ["turnover"]).withColumn("cost", F.col("turnover") * cost_rate)
    d = d.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return d.withColumn("nav", F.product(1 + F.col("net_return")).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))


def _metrics(d: DataFrame, by: list[str], days: int) -> DataFrame:
    """Metrics of columns r (return, null at a base row) and wealth (starts at 1)."""
    w = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_dd", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1)
    g = d.groupBy(*by).agg(F.count("r").alias("n_returns"), (F.max_by("wealth", "trade_date") - 1).alias("total_return"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.min("_dd").alias("max_drawdown"))
    g = g.withColumn("annual_return", F.when(F.col("n_returns") > 0, F.pow(1 + F.col("total_return"), days / F.col("n_returns")) - 1))
    g = g.withColumn("annual_volatility", F.col("_s") * math.sqrt(days)).withColumn("sharpe", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * math.sqrt(days)))
    return g.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / -F.col("max_drawdown"))).drop("_m", "_s")


def ledger_metrics(nav: DataFrame, by: list[str], initial_cash: float, value: str = "nav", days: int = 252) -> DataFrame:
    """Metrics of a ledger whose wealth starts at 1 with the initial cash: n returns for n days."""
    w = Window.partitionBy(*by).orderBy("trade_date")
    d = nav.withColumn("wealth", F.col(value) / initial_cash)
    return _metrics(d.withColumn("r", F.col("wealth") / F.coalesce(F.lag("wealth").over(w), F.lit(1.0)) - 1), by, days)


def series_metrics(nav: DataFrame, by: list[str], value: str = "nav", days: int = 252) -> DataFrame:
    """Metrics with the first value as the base: n - 1 returns for n days."""
    w = Window.partitionBy(*by).orderBy("trade_date")
    d = nav.withColumn("wealth", F.col(value) / F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _metrics(d.withColumn("r", F.col("wealth") / F.lag("wealth").over(w) - 1), by, days)


def nav_series(nav: DataFrame, by: list[str], value: str = "nav", cash: str | None = None) -> DataFrame:
    """Normalised value, drawdown and cash weight of each day."""
    w = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    d = nav.withColumn("normalized", F.col(value) / F.first(value).over(w)).withColumn("drawdown", F.col(value) / F.max(value).over(w) - 1)
    return d.withColumn("cash_weight", F.col(cash) / F.col(value)) if cash else d


def ledger_summary(nav: DataFrame, orders: DataFrame, by: list[str], initial_cash: float, days: int = 252) -> DataFrame:
    """`ledger_metrics` with the dates, mean cash and exposure, turnover, costs, and counts of
    blocked and filled orders. nav: by, trade_date, nav, cash, market_value, traded, cost;
    orders: by, side (buy or sell), filled."""
    n, share = F.count("*"), lambda c: F.avg(F.col(c) / F.col("nav"))
    a = nav.groupBy(*by).agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.max_by("nav", "trade_date").alias("final_nav"), share("cash").alias("mean_cash_weight"), share("market_value").alias("mean_exposure"),
        F.sum("traded").alias("traded"), (F.sum("traded") / F.avg("nav")).alias("turnover"), (F.sum("traded") / F.avg("nav") * days / n).alias("annual_turnover"), F.sum("cost").alias("cost"), (F.sum("cost") / initial_cash).alias("cost_to_cash"),
    )
    on = lambda side, filled: F.count_if((F.col("side") == side) & (F.col("filled") == F.lit(filled)))
    o = orders.groupBy(*by).agg(on("buy", False).alias("blocked_buys"), on("sell", False).alias("blocked_sells"), on("buy", True).alias("filled_buys"), on("sell", True).alias("filled_sells"))
    out = ledger_metrics(nav, by, initial_cash, days=days).join(a, by).join(o, by, "left")
    return out.na.fill(0, ["blocked_buys", "blocked_sells", "filled_buys", "filled_sells"])


def reconcile(fills: DataFrame, positions: DataFrame, key: str, initial_cash: float, settlements: DataFrame | None = None) -> DataFrame:
    """Value by day and what it comes from: (trade_date, net_flow, cash, market_value,
    receivable, nav, nav_change, continuation_pnl, entry_pnl, exit_pnl, settlement_pnl, cost, residual).

    fills: key, trade_date, quantity (signed), price, fee. positions: key, trade_date,
    quantity, mark at the close. settlements: key, trade_date (booked), paid_date (null: not
    yet), quantity, amount; they end a position at its last mark. What was held overnight and is kept earns
    the change of its mark, what was bought the mark less its price, what was sold its price less
    the mark before, what was settled its amount less that mark; sales beyond the holding count as
    entries of the other sign. The change of value less all four plus the fees is the residual.
    """
    w = Window.partitionBy(key).orderBy("trade_date")
    before = positions.select(key, "trade_date", "quantity", "mark", F.coalesce(F.lag("quantity").over(w), F.lit(0.0)).alias("_q"), F.lag("mark").over(w).alias("_m"))
    sold = F.col("quantity") * F.col("_q") <= 0
    stays = F.when(sold, 0.0).otherwise(F.signum("_q") * F.least(F.abs("quantity"), F.abs("_q")))
    if settlements is not None:
        gone = settlements.groupBy(key, "trade_date").agg(F.sum("quantity").alias("_s"), F.sum("amount").alias("_a"))
        before = before.join(gone, [key, "trade_date"], "left")
    else:
        before = before.withColumn("_s", F.lit(0.0)).withColumn("_a", F.lit(0.0))
    before = before.na.fill(0.0, ["_s", "_a"]).withColumn("_stays", stays)
    traded = fills.groupBy(key, "trade_date").agg(F.sum("quantity").alias("_t"), F.sum(F.col("quantity") * F.col("price")).alias("_paid"))
    d = before.join(traded, [key, "trade_date"], "left").na.fill(0.0, ["_t", "_paid"])
    leaves = F.col("_q") - F.col("_stays") - F.col("_s")
    price = F.coalesce(F.try_divide("_paid", "_t"), F.col("_m"), F.col("mark"))
    by_day = d.groupBy("trade_date").agg(
        F.sum(F.col("quantity") * F.col("mark")).alias("market_value"),
        F.sum(F.coalesce(F.col("_stays") * (F.col("mark") - F.col("_m")), F.lit(0.0))).alias("continuation_pnl"),
        F.sum(F.coalesce((F.col("quantity") - F.col("_stays")) * F.col("mark") - F.col("_paid") - leaves * price, F.lit(0.0))).alias("entry_pnl"),
        F.sum(F.coalesce(leaves * (price - F.col("_m")), F.lit(0.0))).alias("exit_pnl"),
        F.sum(F.coalesce(F.col("_a") - F.col("_s") * F.col("_m"), F.lit(0.0))).alias("settlement_pnl"),
    )
    flows = fills.groupBy("trade_date").agg(F.sum(-F.col("quantity") * F.col("price") - F.col("fee")).alias("net_flow"), F.sum("fee").alias("cost"))
    d = by_day.join(flows, "trade_date", "full_outer")
    if settlements is not None:
        moves = settlements.select("trade_date", F.lit(0.0).alias("_paid_in"), F.col("amount").alias("_owed")).unionByName(settlements.where("paid_date is not null").select(F.col("paid_date").alias("trade_date"), F.col("amount").alias("_paid_in"), (-F.col("amount")).alias("_owed")))
        d = d.join(moves.groupBy("trade_date").agg(F.sum("_paid_in").alias("_paid_in"), F.sum("_owed").alias("_owed")), "trade_date", "full_outer")
    else:
        d = d.withColumn("_paid_in", F.lit(0.0)).withColumn("_owed", F.lit(0.0))
    d = d.na.fill(0.0)
    run = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("net_flow", F.col("net_flow") + F.col("_paid_in")).withColumn("cash", initial_cash + F.sum("net_flow").over(run)).withColumn("receivable", F.sum("_owed").over(run))
    d = d.withColumn("nav", F.col("cash") + F.col("market_value") + F.col("receivable"))
    d = d.withColumn("nav_change", F.col("nav") - F.coalesce(F.lag("nav").over(Window.orderBy("trade_date")), F.lit(initial_cash)))
    parts = sum((F.col(c) for c in ("continuation_pnl", "entry_pnl", "exit_pnl", "settlement_pnl")), -F.col("cost"))
    names = ["trade_date", "net_flow", "cash", "market_value", "receivable", "nav", "nav_change", "continuation_pnl", "entry_pnl", "exit_pnl", "settlement_pnl", "cost"]
    return d.select(*names, (F.col("nav_change") - parts).alias("residual"))


def receivables(settlements: DataFrame, cal: DataFrame, key: str) -> DataFrame:
    """(trade_date, n_open, outstanding): money due that is available the open day after its
    settlement. settlements: key, trade_date (booked), settlement_date, amount."""
    from .calendar import next_open

    d = next_open(settlements, "settlement_date", cal, "available_date")
    starts = d.select(F.col("trade_date").alias("on"), F.col("amount").alias("x"), F.lit(1).alias("n"))
    ends = d.where("available_date is not null").select(F.col("available_date").alias("on"), (-F.col("amount")).alias("x"), F.lit(-1).alias("n"))
    net = starts.unionByName(ends).groupBy("on").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    days = cal.select("trade_date").join(net.withColumnRenamed("on", "trade_date"), "trade_date", "left").na.fill(0, ["x", "n"])
    return days.select("trade_date", F.sum("n").over(w).cast("long").alias("n_open"), F.sum("x").over(w).alias("outstanding"))
