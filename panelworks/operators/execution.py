"""Execution market, lifecycle states and forward-return labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import first_match, valid_price
from .asof import asof_backward
from .calendar import listing_age
from .windows import shift


#: Pieces of a grid's keys, which are few rows before each becomes one for each open day.
GRID_PIECES = 128


def execution_market(daily: DataFrame, cal: DataFrame, keys: DataFrame, key: str, flat: float = 1e-8) -> DataFrame:
    """A row for each key and open day with the flags of `tradability`; a day without a row can be neither bought nor sold."""
    grid = keys.select(key).distinct().repartition(GRID_PIECES, key).crossJoin(F.broadcast(cal.select("trade_date")))
    d = grid.join(daily.select(key, "trade_date", "open", "high", "low", "close", "pre_close", "vol", "amount").withColumn("has_market_observation", F.lit(True)), [key, "trade_date"], "left")
    return tradability(d.withColumn("has_market_observation", F.coalesce("has_market_observation", F.lit(False))), flat)


def tradability(d: DataFrame, flat: float = 1e-8) -> DataFrame:
    """Flags of bars. A one-price day above the last close cannot be bought, one below it cannot be sold; a day without a
    positive trade neither."""
    d = d.withColumn("has_positive_trade", F.coalesce((F.col("vol") > 0) & (F.col("amount") > 0), F.lit(False)))
    d = d.withColumn("valid_open", valid_price("open")).withColumn("valid_close", valid_price("close"))
    one = F.coalesce((F.abs(F.col("open") - F.col("high")) <= flat) & (F.abs(F.col("open") - F.col("low")) <= flat), F.lit(False))
    up, down = F.coalesce(F.col("open") > F.col("pre_close") + flat, F.lit(False)), F.coalesce(F.col("open") < F.col("pre_close") - flat, F.lit(False))
    trade = F.col("has_positive_trade") & F.col("valid_open")
    d = d.withColumn("one_price", one).withColumn("buy_allowed", trade & ~(one & up)).withColumn("sell_allowed", trade & ~(one & down))
    return d.withColumn("is_tradable", F.col("has_positive_trade") & F.col("valid_close"))


def prepare_redemptions(events: DataFrame, key: str, watch: list[str], announced: list[str], waived: list[str]) -> DataFrame:
    """Statuses as watch, announced or waived; a waived event has no dates and no price; dates
    that are known must be in order, and a key has one event a date."""
    s = F.col("event_status")
    d = events.withColumn("event_kind", F.when(s.isin(*watch), "watch").when(s.isin(*announced), "announced").when(s.isin(*waived), "waived"))
    d = d.where(F.col("event_kind").isNotNull() & F.col(key).isNotNull() & F.col("effective_date").isNotNull())
    for c in ("last_trade_date", "call_reg_date", "payment_date", "call_price"):
        d = d.withColumn(c, F.when(F.col("event_kind") != "waived", F.col(c)))
    line = F.array_compact(F.array("effective_date", "last_trade_date", "call_reg_date", "payment_date"))
    twice = F.count("*").over(Window.partitionBy(key, "effective_date")) > 1
    fault = F.when(line != F.array_sort(line), "a redemption's dates are out of order").when(twice, "a key has two events on one date")
    return d.withColumn("event_kind", F.when(fault.isNull(), F.col("event_kind")).otherwise(F.raise_error(fault).cast("string")))


def lifecycle_panel(terms: DataFrame, cal: DataFrame, events: DataFrame, market: DataFrame, key: str, seasoning: int = 11) -> DataFrame:
    """The state of each key on each open day.

    terms: key, list_date, delist_date, maturity_date, maturity_payment_date,
    maturity_call_price. The first rule that holds gives the state; see the order below.
    A missing timeline or price leaves a settlement unresolved. A key that was listed before
    the calendar starts is past its seasoning from the first day.
    """
    d = terms.crossJoin(F.broadcast(cal))
    state = ["event_kind", "last_trade_date", "call_reg_date", "payment_date", "call_price"]
    d = asof_backward(d, events.select(key, F.col("effective_date").alias("_from"), *state), key, "trade_date", "_from", state)
    d = d.join(market.select(key, "trade_date", "is_tradable"), [key, "trade_date"], "left").withColumn("is_tradable", F.coalesce("is_tradable", F.lit(False)))
    d = listing_age(d.drop("cal_idx"), "trade_date", "list_date", cal, seasoning)
    t, kind = F.col("trade_date"), F.col("event_kind")
    announced, watch = F.coalesce(kind == "announced", F.lit(False)), F.coalesce(kind == "watch", F.lit(False))
    mature = ~announced & (t >= F.col("maturity_date"))
    paid_terms = F.col("maturity_call_price").isNotNull() & F.col("maturity_payment_date").isNotNull()
    call_terms = F.col("call_price").isNotNull() & F.col("payment_date").isNotNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    raw = first_match(
        (mature & paid_terms & (t >= F.col("maturity_payment_date")), "SETTLED"),
        (mature & no(paid_terms), "SETTLEMENT_UNRESOLVED"),
        (mature, "SETTLEMENT_RECEIVABLE"),
        (~announced & (t > F.col("delist_date")), "DELISTED_UNRESOLVED"),
        (announced & call_terms & (t >= F.col("payment_date")), "SETTLED"),
        (announced & (t >= F.col("call_reg_date")) & no(call_terms), "SETTLEMENT_UNRESOLVED"),
        (announced & (t >= F.col("call_reg_date")), "SETTLEMENT_RECEIVABLE"),
        (announced & (t > F.col("last_trade_date")), "SUSPENDED_OR_UNQUOTED"),
        (announced & (t == F.col("last_trade_date")), "LAST_TRADING_WINDOW"),
        (announced, "REDEMPTION_ANNOUNCED"),
        (watch, "REDEMPTION_WATCH"),
        (F.col("listing_age").between(1, seasoning - 1), "SEASONING"),
        (t < F.col("list_date"), "PRE_LISTED"),
        default="ACTIVE",
    )
    d = d.withColumn("_raw", raw)
    quiet = F.col("_raw").isin("ACTIVE", "REDEMPTION_WATCH") & ~F.col("is_tradable")
    d = d.withColumn("state", F.when(quiet, "SUSPENDED_OR_UNQUOTED").otherwise(F.col("_raw")))
    settles = F.col("state").isin("SETTLED", "SETTLEMENT_RECEIVABLE")
    d = d.withColumn("entry_allowed", F.col("state").isin("ACTIVE", "REDEMPTION_WATCH") & F.col("is_tradable"))
    d = d.withColumn("exit_required", F.col("state").isin("REDEMPTION_ANNOUNCED", "LAST_TRADING_WINDOW"))
    d = d.withColumn("settlement_value", F.when(settles, F.when(announced, F.col("call_price")).otherwise(F.col("maturity_call_price"))))
    d = d.withColumn("settlement_date", F.when(settles, F.when(announced, F.col("payment_date")).otherwise(F.col("maturity_payment_date"))))
    return d.select(key, "trade_date", "state", "entry_allowed", "exit_required", "settlement_value", "settlement_date")


def forward_returns(keys: DataFrame, schedule: DataFrame, market: DataFrame, key: str) -> DataFrame:
    """Open-to-open returns of each key and schedule row (one horizon or many), with the first
    reason that makes a label unusable. A signal without a schedule row is on the boundary. A day without a row in `market` is a day without
    prices, so bars with the flags of `tradability` do as well as the grid of `execution_market`."""
    extra = ["horizon_days"] if "horizon_days" in schedule.columns else []
    d = keys.select(key, "signal_date").join(F.broadcast(schedule.select("signal_date", *extra, "entry_date", "exit_date", "is_label_within_partition")), "signal_date", "left")
    side = lambda p, flag: market.select(key, F.col("trade_date").alias(f"{p}_date"), F.col("open").alias(f"{p}_open"), F.col(flag).alias(f"{p}_ok"))
    d = d.join(side("entry", "buy_allowed"), [key, "entry_date"], "left").join(side("exit", "sell_allowed"), [key, "exit_date"], "left")
    return _labelled(d).select(key, "signal_date", *extra, *LABEL)


#: What a label has beside its key, its signal date and its horizon.
LABEL = ("entry_date", "exit_date", "label_reason", "label_usable", "forward_return")


def _labelled(d: DataFrame) -> DataFrame:
    """Reason, flag and return of rows with the opens and flags of their entry and exit."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = first_match(
        (no(F.col("is_label_within_partition")), "partition_boundary"),
        (F.col("entry_open").isNull(), "missing_entry"),
        (no(valid_price("entry_open")), "invalid_entry"),
        (no(F.col("entry_ok")), "entry_not_buyable"),
        (F.col("exit_open").isNull(), "missing_exit"),
        (no(valid_price("exit_open")), "invalid_exit"),
        (no(F.col("exit_ok")), "exit_not_sellable"),
        default="usable",
    )
    d = d.withColumn("label_reason", reason).withColumn("label_usable", F.col("label_reason") == "usable")
    return d.withColumn("forward_return", F.when(F.col("label_usable"), F.col("exit_open") / F.col("entry_open") - 1))


def priced_ahead(bars: DataFrame, key: str, horizons: list[int], idx: str = "cal_idx") -> DataFrame:
    """Bars (with the flags of `tradability` and their calendar position) with what `labels_ahead` needs of the key's later bars: one window over the
    rows that exist, and no join. A null key has no later bars."""
    at = lambda c, n: F.when(F.col(key).isNotNull(), shift(c, -n, key, idx))
    entry = {"_entry_open": at("open", 1), "_entry_ok": at("buy_allowed", 1)}
    return bars.withColumns(entry | {f"_exit_open_{h}": at("open", 1 + h) for h in horizons} | {f"_exit_ok_{h}": at("sell_allowed", 1 + h) for h in horizons})


def ahead_columns(horizons: list[int]) -> list[str]:
    return ["_entry_open", "_entry_ok", *(f"_exit_{c}_{h}" for c in ("open", "ok") for h in horizons)]


def labels_ahead(d: DataFrame, schedule: DataFrame, horizons: list[int]) -> DataFrame:
    """The labels of `forward_returns` for rows of `priced_ahead`, one for each horizon of a schedule by `calendar.horizon_schedules`, beside the other columns."""
    own, h = [c for c in d.columns if c not in ahead_columns(horizons)], F.col("horizon_days")
    d = d.join(F.broadcast(schedule.where(h.isin(horizons))), "signal_date", "left")
    out = lambda c: F.coalesce(*(F.when(h == n, F.col(f"_exit_{c}_{n}")) for n in horizons))
    d = d.withColumns({"entry_open": F.col("_entry_open"), "entry_ok": F.col("_entry_ok"), "exit_open": out("open"), "exit_ok": out("ok")})
    return _labelled(d).select(*own, "horizon_days", *LABEL)


def open_to_open(factors: DataFrame, schedule: DataFrame, prices: DataFrame, key: str, drop_unusable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labelled factors, (reason, n_rows)): signals without a complete schedule drop out; a
    missing or invalid open is an error unless `drop_unusable`."""
    d = factors.join(F.broadcast(schedule), "signal_date")
    side = lambda p: prices.select(key, F.col("trade_date").alias(f"{p}_date"), F.col("open").alias(f"{p}_open"))
    d = d.join(side("entry"), [key, "entry_date"], "left").join(side("exit"), [key, "exit_date"], "left")
    reason = first_match((F.col("entry_open").isNull(), "missing_entry"), (~valid_price("entry_open"), "invalid_entry"), (F.col("exit_open").isNull(), "missing_exit"), (~valid_price("exit_open"), "invalid_exit"), default="usable")
    d = d.withColumn("label_reason", reason)
    counts = d.groupBy("label_reason").agg(F.count("*").alias("n_rows"))
    if not drop_unusable:
        d = d.withColumn("label_reason", F.when(F.col("label_reason") == "usable", F.col("label_reason")).otherwise(F.raise_error(F.lit("a label has no usable price"))))
    return d.where("label_reason = 'usable'").withColumn("forward_return", F.col("exit_open") / F.col("entry_open") - 1), counts


def attach_labels(processed: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of a factor panel; the return of an unusable or infinite label is null. A row
    without a label is an error, found when the rows are made."""
    return usable_returns(processed.join(labels.select(*keys, *(c for c in labels.columns if c not in processed.columns)), keys, "left"))


def usable_returns(d: DataFrame) -> DataFrame:
    """The return of an unusable or infinite label as null; a row without a label is an error."""
    r = F.col("forward_return")
    usable = F.when(F.col("label_usable").isNull(), F.raise_error(F.lit("a factor row has no label")).cast("boolean")).otherwise(F.col("label_usable") & ~F.isnan(r) & (F.abs(r) < float("inf")))
    return d.withColumn("forward_return", F.when(usable, r))


def label_counts(labels: DataFrame, by: list[str]) -> DataFrame:
    return labels.groupBy(*by, "label_reason").agg(F.count("*").alias("n_rows"))


def input_invariants(market: DataFrame, lifecycle: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row of counters that must all be 0: null and repeated keys of the market and the
    lifecycle, keys of one without the other, entries into a state or a day that does not allow
    them, settlements without value or date and values without a settlement, usable labels without
    a finite return, and unusable ones with a return."""
    keys = [key, "trade_date"]
    twice = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias(n))
    both = market.select(*keys, "buy_allowed", F.col("is_tradable"), F.lit(True).alias("_m")).join(lifecycle.withColumn("_l", F.lit(True)), keys, "full_outer")
    settled = F.col("state").isin("SETTLED", "SETTLEMENT_RECEIVABLE")
    entry = F.coalesce("entry_allowed", F.lit(False))
    a = both.agg(
        F.count_if(F.col(key).isNull() | F.col("trade_date").isNull()).alias("null_keys"),
        F.count_if(F.col("_l").isNull()).alias("market_only"),
        F.count_if(F.col("_m").isNull()).alias("lifecycle_only"),
        F.count_if(entry & ~F.coalesce("is_tradable", F.lit(False))).alias("entry_untradable"),
        F.count_if(entry & F.col("exit_required")).alias("entry_and_exit"),
        F.count_if(entry & ~F.col("state").isin("ACTIVE", "REDEMPTION_WATCH")).alias("entry_in_wrong_state"),
        F.count_if(settled & (F.col("settlement_value").isNull() | F.col("settlement_date").isNull())).alias("settled_without_terms"),
        F.count_if(~settled & (F.col("settlement_value").isNotNull() | F.col("settlement_date").isNotNull())).alias("terms_without_settlement"),
    )
    r = F.col("forward_return")
    finite = r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf"))
    bad = labels.agg(F.count_if(F.col("label_usable") & ~finite).alias("usable_without_return"), F.count_if(~F.col("label_usable") & r.isNotNull()).alias("unusable_with_return"))
    return a.crossJoin(twice(market, "market_repeats")).crossJoin(twice(lifecycle, "lifecycle_repeats")).crossJoin(bad)


def state_counts(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.groupBy("state").agg(F.count("*").alias("n_rows"), F.count_if("entry_allowed").alias("n_entry"), F.count_if("exit_required").alias("n_exit"))
