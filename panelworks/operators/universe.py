"""Point-in-time universe: effective-dated events, eligibility, funnels, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import first_match, rating_score
from ..functions.ranks import exact_quantiles
from ..sources.folders import stored
from .asof import asof_backward, latest_states
from .calendar import listing_age, next_open
from .checks import key_difference
from .windows import frame

REASONS = ("not_listed_long_enough", "turnover_too_high", "size_missing_or_small", "rating_missing", "rating_too_low", "price_missing")


def rating_events(history: DataFrame, cal: DataFrame, key: str, announced: str, rating: str) -> DataFrame:
    """(key, effective_date, rating, rating_score): visible on the open day after the
    announcement; of several on one day the lowest grade holds, then the earliest."""
    d = next_open(history.select(key, announced, rating), announced, cal, "effective_date").withColumn("rating_score", rating_score(rating))
    d = d.where(F.col(key).isNotNull() & F.col("effective_date").isNotNull() & F.col("rating_score").isNotNull())
    w = Window.partitionBy(key, "effective_date").orderBy("rating_score", announced, rating)
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "effective_date", F.col(rating).alias("rating"), "rating_score")


def share_events(history: DataFrame, cal: DataFrame, key: str, published: str, period_end: str, state: list[str]) -> DataFrame:
    """(key, effective_date, *state): the last report by (period end, publication) of each
    effective date."""
    d = next_open(history.select(key, published, period_end, *state), published, cal, "effective_date")
    d = d.where(F.col(key).isNotNull() & F.col("effective_date").isNotNull())
    w = Window.partitionBy(key, "effective_date").orderBy(F.col(period_end).desc(), F.col(published).desc(), *[F.col(s).desc() for s in state])
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "effective_date", *state)


def universe_panel(
    signals: DataFrame,
    reference: DataFrame,
    daily: DataFrame,
    cal: DataFrame,
    ratings: DataFrame,
    shares: DataFrame,
    key: str,
    minimum_age: int = 11,
    turnover_window: int = 20,
    maximum_turnover: float = 1.0,
    minimum_size: float = 2e8,
    minimum_rating: int = 14,
    volume_scale: float = 1000.0,
    pieces: int | None = None,
) -> DataFrame:
    """Every reference key on every signal date with its five filters, in one set-based job.

    reference: key, list_date, issue_size, first_price, a row a key. daily: key, trade_date, vol.
    ratings and shares are effective-dated (rating, rating_score; remain_size,
    convert_price). Turnover of a day is volume over the size as of that day, falling back to the issue
    size; its sum runs over `turnover_window` calendar positions. A null filter is false.

    Reference, days and events are moved once, by key, into `pieces` (by default Spark's own number); a key becomes its signal dates only there,
    and all states and sums are made where its rows are.
    """
    pos = cal.select("trade_date", "cal_idx")
    dates = signals.select(F.col("signal_date").alias("trade_date")).distinct().where("trade_date is not null").withColumn("_i", F.row_number().over(Window.orderBy("trade_date")))
    kinds = {
        "_ref": reference.select(key, F.lit(None).cast("date").alias("_date"), F.struct("list_date", "issue_size", "first_price").alias("_ref")),
        "_share": shares.where("effective_date is not null").select(key, F.col("effective_date").alias("_date"), F.struct("remain_size", "convert_price", F.col("effective_date").alias("share_date")).alias("_share")),
        "_rating": ratings.where("effective_date is not null").select(key, F.col("effective_date").alias("_date"), F.struct("rating", "rating_score", F.col("effective_date").alias("rating_date")).alias("_rating")),
    }
    d = daily.select(key, F.col("trade_date").alias("_date"), F.lit(1).alias("_side"), "vol")
    for kind in kinds.values():
        d = d.unionByName(kind.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    d = d.where(F.col(key).isNotNull()).repartition(*([pieces] if pieces else []), key).crossJoin(F.broadcast(dates.agg(F.count("*").cast("int").alias("_n"))))
    d = d.withColumn("_i", F.explode(F.when(F.col("_ref").isNotNull() & (F.col("_n") > 0), F.sequence(F.lit(0), F.col("_n"))).otherwise(F.array(F.lit(0))))).drop("_n")
    d = d.join(F.broadcast(dates.withColumnRenamed("trade_date", "_signal")), "_i", "left").withColumn("is_signal", F.col("_i") > 0)
    d = d.withColumn("_side", F.when(F.col("is_signal"), 1).otherwise(F.col("_side"))).withColumn("_date", F.coalesce("_signal", "_date")).drop("_signal", "_i")
    d = latest_states(d, key, {"_ref": "_r", "_share": "_s", "_rating": "_t"}).where("_side = 1 and _r is not null")
    d = d.select(key, F.col("_date").alias("trade_date"), "is_signal", "vol", F.coalesce(F.when(F.col("is_signal"), F.col("_ref")), F.col("_r")).alias("_r"), "_s", "_t").select(key, "trade_date", "is_signal", "vol", "_r.*", "_s.*", "_t.*")
    d = d.join(F.broadcast(pos), "trade_date")
    size = F.coalesce("remain_size", "issue_size")
    live = (F.col("trade_date") >= F.col("list_date")) & (F.col("vol") > 0) & (size > 0)
    d = d.withColumn("_turnover", F.when(~F.col("is_signal"), F.when(live, F.col("vol") * volume_scale / size).otherwise(0.0)))
    w = frame(key, "cal_idx", -(turnover_window - 1), 0)
    d = d.withColumn("turnover_sum", F.coalesce(F.sum("_turnover").over(w), F.lit(0.0))).withColumn("observation_ratio", F.sum(((F.col("vol") > 0)).cast("int")).over(w) / turnover_window)
    d = d.where("is_signal").drop("vol", "_turnover", "is_signal")
    d = listing_age(d, "trade_date", "list_date", cal, minimum_age)
    d = d.withColumn("remain_size_asof", size).withColumn("price_asof", F.coalesce("convert_price", "first_price"))
    d = d.withColumn("price_source", first_match((F.col("convert_price").isNotNull(), "disclosed_event"), (F.col("first_price").isNotNull(), "initial_terms"), default="missing"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumns(
        {
            "pass_age": yes(F.col("listing_age") >= minimum_age),
            "pass_turnover": yes(F.col("turnover_sum") <= maximum_turnover),
            "pass_size": yes(F.col("remain_size_asof") >= minimum_size),
            "pass_rating": yes(F.col("rating_score") >= minimum_rating),
            "pass_price": yes(F.col("price_asof") > 0),
        }
    )
    d = d.withColumn("is_eligible", F.col("pass_age") & F.col("pass_turnover") & F.col("pass_size") & F.col("pass_rating") & F.col("pass_price"))
    tests = [~F.col("pass_age"), ~F.col("pass_turnover"), ~F.col("pass_size"), F.col("rating_score").isNull(), ~F.col("pass_rating"), ~F.col("pass_price")]
    return d.withColumn("exclusion_reason", first_match(*zip(tests, REASONS, strict=True), default="eligible")).withColumnRenamed("trade_date", "signal_date")


STAGES = ("reference", "age", "turnover", "size", "rating", "price")


def funnel(panel: DataFrame) -> DataFrame:
    """(signal_date, stage, n_keys): how many pass all rules up to each stage."""
    test, sums = F.lit(True), []
    for s in STAGES:
        test = test if s == "reference" else test & F.col(f"pass_{s}")
        sums.append(F.sum(test.cast("long")).alias(s))
    d = panel.groupBy("signal_date").agg(*sums)
    rows = [F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(s).alias("n_keys")) for i, s in enumerate(STAGES)]
    return d.select("signal_date", F.inline(F.array(*rows)))


def by_date(panel: DataFrame, industry: str | None = None) -> DataFrame:
    """Counts and shares of each signal date."""
    on = F.col("is_eligible")
    aggs = [F.count("*").alias("n_keys"), F.count_if(on).alias("n_eligible"), F.avg(on.cast("double")).alias("eligible_share"), F.avg(F.when(on, F.col("remain_size_asof"))).alias("mean_size"), F.avg(F.when(on, (F.col("price_source") == "disclosed_event").cast("double"))).alias("disclosed_share")]
    if industry:
        aggs.append(F.countDistinct(F.when(on, F.col(industry))).alias("n_industries"))
    return panel.groupBy("signal_date").agg(*aggs)


def transitions(panel: DataFrame, key: str) -> DataFrame:
    """Keys that enter or leave between a signal date and the one before, with the reason
    that held before an entry or holds after an exit."""
    w = Window.partitionBy(key).orderBy("signal_date")
    d = panel.select(key, "signal_date", "is_eligible", "exclusion_reason", F.lag("is_eligible").over(w).alias("_was"), F.lag("exclusion_reason").over(w).alias("_reason"))
    d = d.where(F.col("_was").isNotNull() & (F.col("_was") != F.col("is_eligible")))
    return d.select(key, "signal_date", F.when(F.col("is_eligible"), "entered").otherwise("exited").alias("transition"), F.when(F.col("is_eligible"), F.col("_reason")).otherwise(F.col("exclusion_reason")).alias("reason"))


def resolve_membership(members: DataFrame, keys: list[str], name: str = "industry") -> DataFrame:
    """A row a key: its industry if there is one, else null, with the sorted candidates."""
    d = members.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("_all"))
    n = F.size("_all")
    return d.select(*keys, F.when(n == 1, F.col("_all")[0]).alias(name), (n > 1).alias("is_ambiguous"), F.array_join("_all", "|").alias("candidates"), n.alias("n_candidates"))


def attach_snapshot(panel: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Exact-date join, nothing filled."""
    return panel.join(snapshot, keys, "left")


def _rules():
    return F.col("pass_age") & F.col("pass_turnover") & F.col("pass_size") & F.col("pass_rating") & F.col("pass_price")


def date_checks(panel: DataFrame) -> DataFrame:
    """(signal_date, n_rows, n_eligible, mismatches): the eligibility formula on every date."""
    return panel.groupBy("signal_date").agg(F.count("*").alias("n_rows"), F.count_if("is_eligible").alias("n_eligible"), F.count_if(_rules() != F.col("is_eligible")).alias("mismatches"))


def panel_audit(panel: DataFrame, dates: DataFrame, key: str, membership_date: str | None = None) -> DataFrame:
    """One row: counts of rows, dates, keys and eligible ones, keys that repeat, eligibility that its
    filters do not give, dates missing from or not in `dates`, events from the future, industries of another
    date, and least, quartiles and most of eligible keys by date. `passed` if no fault is found. The panel is read once and stored as counts by key
    and date, without a shuffle if its rows lie by key."""
    late = lambda c: F.count_if(F.col(c) > F.col("signal_date"))
    other = F.count_if(F.col(membership_date) != F.col("signal_date")) if membership_date else F.lit(0).cast("long")
    sums = {"n_eligible": F.count_if("is_eligible"), "eligibility_mismatches": F.count_if(_rules() != F.col("is_eligible")), "late_shares": late("share_date"), "late_ratings": late("rating_date"), "industry_date_mismatches": other}
    g = stored(panel.groupBy(key, "signal_date").agg(F.count("*").alias("n_rows"), *(c.alias(n) for n, c in sums.items())), "panel-keys")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    a = g.agg(*map(total, ("n_rows", *sums)), F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("repeated_keys"))
    k = g.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("n_eligible") > 0).alias("on")).agg(F.count("*").alias("n_keys"), F.count_if("on").alias("n_eligible_keys"))
    days = stored(g.groupBy("signal_date").agg(F.sum("n_eligible").alias("n")), "panel-dates")
    apart = key_difference(days, dates, ["signal_date"]).agg(F.count_if(F.col("side") == "missing").alias("missing_dates"), F.count_if(F.col("side") == "extra").alias("unexpected_dates"))
    q = days.agg(F.count("signal_date").alias("n_dates"), F.percentile("n", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"))
    out = a.crossJoin(k).crossJoin(apart).crossJoin(q).select("n_rows", "n_dates", "n_keys", "n_eligible", "n_eligible_keys", "eligibility_mismatches", "late_shares", "late_ratings", "industry_date_mismatches", "missing_dates", "unexpected_dates", "repeated_keys", "q")
    out = out.withColumns({n: F.col("q")[k] for k, n in enumerate(("least_eligible", "q1_eligible", "median_eligible", "q3_eligible", "most_eligible"))}).drop("q")
    faults = ("eligibility_mismatches", "late_shares", "late_ratings", "industry_date_mismatches", "missing_dates", "unexpected_dates", "repeated_keys")
    return out.withColumn("passed", sum((F.col(c) for c in faults), F.lit(0)) == 0)


def boundary_audit(events: DataFrame, cal: DataFrame, key: str, state: str) -> DataFrame:
    """(event_type, n_events, passed): each event is unseen on the open day before it takes
    effect and seen on that day."""
    pos = cal.select(F.col("trade_date").alias("effective_date"), "cal_idx")
    before = cal.select(F.col("trade_date").alias("_before"), (F.col("cal_idx") + 1).alias("cal_idx"))
    e = events.select(key, "effective_date").join(F.broadcast(pos), "effective_date").join(F.broadcast(before), "cal_idx", "left")
    both = F.array(F.struct(F.col("effective_date").alias("day"), F.lit(True).alias("on")), F.struct(F.col("_before").alias("day"), F.lit(False).alias("on")))
    days = e.select(key, "effective_date", F.inline(both)).where("day is not null")
    seen = asof_backward(days, events.select(key, F.col("effective_date").alias("_eff_date"), state), key, "day", "_eff_date", [state], "_seen")
    ok = F.coalesce(F.col("_seen") == F.col("effective_date"), F.lit(False)) == F.col("on")
    return seen.groupBy(F.lit(state).alias("event_type")).agg(F.count("*").alias("n_checks"), F.count_if(ok).alias("passed"))


def audit_enrichment(panel: DataFrame, key: str, events: dict[str, tuple[DataFrame, str]], cal: DataFrame) -> DataFrame:
    """(topic, item, value): keys that left by reason, events and failed boundary checks by type,
    and least, quartiles and most of the observation ratio among eligible rows. The panel is read once, and moved only if its rows do not lie by key;
    tables of events are read several times, so give stored ones."""
    was = F.lag("is_eligible").over(Window.partitionBy(key).orderBy("signal_date"))
    d = panel.select(was.alias("_was"), "is_eligible", "exclusion_reason", "observation_ratio")
    d = stored(d.select(F.when(F.col("_was") & ~F.col("is_eligible"), F.col("exclusion_reason")).alias("item"), F.when(F.col("is_eligible"), F.col("observation_ratio")).alias("observation_ratio")), "enriched")
    left = d.where("item is not null").groupBy("item").agg(F.count("*").cast("double").alias("value")).select(F.lit("exit_reason").alias("topic"), "item", "value")
    for name, (table, state) in events.items():
        counted = table.agg(F.count("*").cast("double").alias("value")).select(F.lit("events").alias("topic"), F.lit(name).alias("item"), "value")
        failed = stored(boundary_audit(table, cal, key, state), "boundaries").select(F.lit("boundary_failures").alias("topic"), F.lit(name).alias("item"), (F.col("n_checks") - F.col("passed")).cast("double").alias("value"))
        left = left.unionByName(counted).unionByName(failed)
    ratio = exact_quantiles(d, [], "observation_ratio", (0.0, 0.25, 0.5, 0.75, 1.0))
    return left.unionByName(ratio.select(F.lit("observation_ratio").alias("topic"), F.col("point").cast("string").alias("item"), "value"))


def reason_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("exclusion_reason").agg(F.count("*").alias("n_rows"))


def funnel_summary(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage_no", "stage").agg(F.avg("n_keys").alias("mean_keys"), F.min("n_keys").alias("min_keys"), F.max("n_keys").alias("max_keys"))


def eligible(panel: DataFrame, flag: Column | str = "is_eligible") -> DataFrame:
    return panel.where(flag)
