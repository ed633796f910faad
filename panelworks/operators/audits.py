"""Audits that reconcile several tables: rows of all tables are tagged and put together, one grouped pass brings equal
keys together, and one row of counters comes out. Sums are combined before the shuffle, so a hot key is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import future_columns
from .cross_section import clipping_audit


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def input_audit(context: DataFrame, terms: DataFrame, market: DataFrame, lifecycle: DataFrame, labels: DataFrame, key: str, end: str, horizons: tuple[int, ...] = (), flat: float = 1e-8) -> DataFrame:
    """One row: sizes and faults of the inputs of a study that ends at `end`.

    context: key, signal_date. terms: key. market and lifecycle: key, trade_date. labels: key, signal_date, exit_date,
    label_usable, forward_return, and with `horizons` horizon_days, of which each context row has one label each.
    Sizes: n_context, n_dates, n_terms, n_market, n_lifecycle, n_labels, n_usable, one_price_up, one_price_down, unobserved.
    Faults: null_keys; repeats of a key in each table; context_without_terms (keys); market_only and lifecycle_only (key
    and day); context_without_label and label_without_context; usable_without_return (null or not finite),
    usable_past_end, unusable_with_return. `passed` if all faults are 0. Empty tables count as they are.
    """
    flags = ("context", "terms", "market", "lifecycle", "labels", "usable", "usable_without_return", "usable_past_end", "unusable_with_return", "one_price_up", "one_price_down", "unobserved")

    def tagged(df: DataFrame, level: str, date: Column | None, horizon: Column | None = None, **on: Column) -> DataFrame:
        marks = (F.coalesce(on[f].cast("long"), F.lit(0)) if f in on else F.lit(0) for f in flags)
        day, h = (F.lit(None) if c is None else c for c in (date, horizon))
        return df.select(F.lit(level).alias("_level"), F.col(key).alias("_key"), day.cast("date").alias("_date"), h.cast("int").alias("_horizon"), *(m.cast("long").alias(f) for f, m in zip(flags, marks, strict=True)))

    one, r = F.lit(1), F.col("forward_return")
    wide = context.withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons)))) if horizons else context.withColumn("horizon_days", F.lit(None))
    usable = F.coalesce("label_usable", F.lit(False))
    up, down = F.col("one_price") & (F.col("open") > F.col("pre_close") + flat), F.col("one_price") & (F.col("open") < F.col("pre_close") - flat)
    rows = tagged(context, "key", None, context=one).unionByName(tagged(terms, "key", None, terms=one))
    rows = rows.unionByName(tagged(market, "day", F.col("trade_date"), market=one, one_price_up=up, one_price_down=down, unobserved=~F.col("has_market_observation")))
    rows = rows.unionByName(tagged(lifecycle, "day", F.col("trade_date"), lifecycle=one))
    rows = rows.unionByName(tagged(wide, "label", F.col("signal_date"), F.col("horizon_days"), context=one))
    past = usable & (F.col("exit_date") > F.lit(end).cast("date"))
    rows = rows.unionByName(tagged(labels, "label", F.col("signal_date"), F.col("horizon_days") if horizons else None, labels=one, usable=usable, usable_without_return=usable & ~_finite(r), usable_past_end=past, unusable_with_return=~usable & r.isNotNull()))
    g = rows.groupBy("_level", "_key", "_date", "_horizon").agg(*(F.sum(f).alias(f) for f in flags))
    at = lambda level, *tests: F.count_if(F.expr(" and ".join([f"_level = '{level}'", *tests])))
    total = lambda level, f: F.coalesce(F.sum(F.when(F.col("_level") == level, F.col(f))), F.lit(0))
    faults = {
        "null_keys": F.count_if(F.col("_key").isNull() | ((F.col("_level") != "key") & F.col("_date").isNull())),
        "context_repeats": at("label", "context > 1"), "terms_repeats": at("key", "terms > 1"), "market_repeats": at("day", "market > 1"), "lifecycle_repeats": at("day", "lifecycle > 1"), "label_repeats": at("label", "labels > 1"),
        "context_without_terms": at("key", "context > 0", "terms = 0"), "market_only": at("day", "market > 0", "lifecycle = 0"), "lifecycle_only": at("day", "market = 0", "lifecycle > 0"),
        "context_without_label": at("label", "context > 0", "labels = 0"), "label_without_context": at("label", "context = 0", "labels > 0"),
    } | {f: total("label", f) for f in ("usable_without_return", "usable_past_end", "unusable_with_return")}
    sizes = {"n_context": total("key", "context"), "n_dates": F.countDistinct(F.when((F.col("_level") == "label") & (F.col("context") > 0), F.col("_date"))), "n_terms": total("key", "terms"), "n_market": total("day", "market"), "n_lifecycle": total("day", "lifecycle"), "n_labels": total("label", "labels"), "n_usable": total("label", "usable")}
    sizes |= {f: total("day", f) for f in ("one_price_up", "one_price_down", "unobserved")}
    out = g.agg(*(c.alias(n) for n, c in (sizes | faults).items()))
    return out.withColumn("passed", sum((F.col(f) for f in faults), F.lit(0)) == 0)


def preprocessing_audit(panel: DataFrame, entity: str, date: str, factors: list[str], sensitivity: DataFrame, outputs: list[str], primary: float = 3.0, cap: str = "market_cap", industry: str = "industry_control", age: str = "market_cap_age") -> DataFrame:
    """One row about a preprocessed panel: rows, dates and entities; repeated keys; how many of `outputs` and of the columns
    that look into the future are missing and present; `coverage__<factor>`; from a `mad_sensitivity` report clip_rate__ and
    rank_correlation__<factor> at the primary multiplier and how many factors clip more under a wider bound; the
    shares of rows with a cap, with an industry, with both, and the oldest cap in days. `passed` if there are no repeats, missing or
    forbidden columns, and clipping is monotone. The panel is read once, grouped by its keys; shares of an empty panel are null."""
    both = F.col(cap).isNotNull() & F.col(industry).isNotNull()
    seen = {f"coverage__{f}": F.count(f) for f in factors} | {"cap_coverage": F.count(cap), "industry_coverage": F.count(industry), "joint_coverage": F.count_if(both)}
    g = panel.groupBy(entity, date).agg(F.count("*").alias("_n"), F.max(age).alias("_age"), *(c.alias(n) for n, c in seen.items()))
    shares = (F.try_divide(F.sum(n), F.sum("_n")).alias(n) for n in seen)
    a = g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.countDistinct(date).alias("n_dates"), F.countDistinct(entity).alias("n_entities"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_keys"), *shares, F.max("_age").alias("oldest_cap"))
    a = a.withColumn("missing_outputs", F.lit(len(set(outputs) - set(panel.columns))).cast("long")).withColumn("forbidden_columns", F.lit(len(future_columns(panel))).cast("long"))
    main = lambda f, c: F.max(F.when((F.col("factor") == f) & (F.col("multiplier") == primary), F.col(c)))
    s = sensitivity.agg(*(main(f, c).alias(f"{n}__{f}") for f in factors for c, n in (("clip_rate", "clip_rate"), ("mean_rank_correlation", "rank_correlation"))))
    m = clipping_audit(sensitivity).agg(F.count_if(~F.col("is_monotone")).alias("not_monotone"))
    out = a.crossJoin(s).crossJoin(m)
    return out.withColumn("passed", F.col("repeated_keys") + F.col("missing_outputs") + F.col("forbidden_columns") + F.col("not_monotone") == 0)
