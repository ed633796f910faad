"""Cross-sections of a date: winsorising, z-scores, neutralising, factor correlations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import below, clean, dealt_values, exact_quantiles
from ..functions.stats import dealt, pearson, spearman_by
from ..sources.folders import stored
from .checks import forbid_columns

MAD_SCALE = 1.4826
FLAT = 1e-8


def winsorize_mad(df: DataFrame, value: str, by: list[str], n_mad: float | Column = 3.0, name: str | None = None) -> DataFrame:
    """Clips to the median and n scaled median deviations of the group; unchanged where the
    deviation is nearly nothing; null stays null."""
    w, x = Window.partitionBy(*by), F.col(value)
    d = df.withColumn("_med", F.median(x).over(w)).withColumn("_mad", F.median(F.abs(x - F.col("_med"))).over(w) * MAD_SCALE)
    k = F.lit(n_mad) if isinstance(n_mad, (int, float)) else n_mad
    low, high = F.col("_med") - k * F.col("_mad"), F.col("_med") + k * F.col("_mad")
    out = F.when(x.isNull(), None).when(F.col("_mad") / MAD_SCALE > FLAT, F.greatest(low, F.least(high, x))).otherwise(x)
    return d.withColumn(name or f"winsorized__{value}", out).drop("_med", "_mad")


def standardize(df: DataFrame, value: str, by: list[str], name: str | None = None) -> DataFrame:
    """(x - mean) / population deviation of the group; 0 where the group is flat."""
    w, x = Window.partitionBy(*by), F.col(value)
    std = F.stddev_pop(x).over(w)
    return df.withColumn(name or f"standardized__{value}", F.when(x.isNull(), None).when(std > FLAT, (x - F.avg(x).over(w)) / std).otherwise(0.0))


def neutralize(df: DataFrame, value: str, by: list[str], numeric: list[str], category: str | None = None, name: str | None = None) -> DataFrame:
    """Residual of a least-squares fit on an intercept, up to two numeric controls and the
    dummies of one category, by group, over complete rows.

    Values and controls are centred within (group, category) and the 1 or 2 normal equations
    are solved from window sums. A group is null if it has too few complete rows, if a
    category occurs only in incomplete rows, or if the controls are collinear.
    """
    if len(numeric) > 2:
        raise ValueError("two numeric controls at most")
    cats = [*by, category] if category else list(by)
    parts = [F.col(value), *map(F.col, numeric), *([F.col(category)] if category else [])]
    ok = parts[0].isNotNull()
    for p in parts[1:]:
        ok = ok & p.isNotNull()
    wc, wg = Window.partitionBy(*cats), Window.partitionBy(*by)
    d = df.withColumn("_ok", ok)
    centred = {f"_{i}": F.when(F.col("_ok"), F.col(c) - F.avg(F.when(F.col("_ok"), F.col(c))).over(wc)) for i, c in enumerate([value, *numeric])}
    d = d.withColumns(centred).withColumn("_lone", (F.sum(F.col("_ok").cast("int")).over(wc) == 0) if category is None else F.col(category).isNotNull() & (F.sum(F.col("_ok").cast("int")).over(wc) == 0))
    d = d.withColumn("_first", F.when(F.col("_ok"), F.row_number().over(Window.partitionBy(*cats, "_ok").orderBy(*cats))))
    n, k = F.sum(F.col("_ok").cast("int")).over(wg), F.sum((F.col("_first") == 1).cast("int")).over(wg)
    usable = F.col("_ok") & (n > k + len(numeric)) & ~F.coalesce(F.max("_lone").over(wg), F.lit(False))
    s = lambda a, b: F.sum(F.col(a) * F.col(b)).over(wg)
    if not numeric:
        fit = F.lit(0.0)
    elif len(numeric) == 1:
        raw = F.var_pop(F.when(F.col("_ok"), F.col(numeric[0]))).over(wg) * n
        usable = usable & (s("_1", "_1") > 1e-12 * raw)
        fit = F.col("_1") * F.try_divide(s("_0", "_1"), s("_1", "_1"))
    else:
        a, b, c, p, q = s("_1", "_1"), s("_1", "_2"), s("_2", "_2"), s("_0", "_1"), s("_0", "_2")
        det = a * c - b * b
        usable = usable & (det > 1e-12 * a * c)
        fit = F.col("_1") * F.try_divide(p * c - q * b, det) + F.col("_2") * F.try_divide(q * a - p * b, det)
    return d.withColumn(name or f"neutralized__{value}", F.when(usable, F.col("_0") - fit)).drop("_ok", "_lone", "_first", *centred)


def merge_panels(panels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Join of panels whose key sets must be equal; columns of earlier ones win. A key that is in
    only some, or repeats in one, is an error when the rows are made."""
    out = None
    for n, p in enumerate(panels):
        taken = set(keys) if out is None else set(out.columns)
        p = p.select(*keys, *(c for c in p.columns if c not in taken), F.lit(True).alias(f"_in_{n}"))
        out = p if out is None else out.join(p, keys, "full_outer")
    marks = [f"_in_{n}" for n in range(len(panels))]
    everywhere = F.lit(True)
    for m in marks:
        everywhere = everywhere & F.col(m).isNotNull()
    fault = F.when(~everywhere, "panels have different keys").when(F.count("*").over(Window.partitionBy(*keys)) > 1, "a key repeats in a panel")
    kind = out.schema[keys[0]].dataType
    return out.withColumn("_fault", fault).withColumn(keys[0], F.when(F.col("_fault").isNull(), F.col(keys[0])).otherwise(F.raise_error(F.col("_fault")).cast(kind))).drop("_fault", *marks)


def to_long(panel: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    return panel.unpivot(keys, factors, "factor", "value")


def winsorize_panel(panel: DataFrame, keys: list[str], date: str, factors: list[str], n_mad: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """`winsorize_mad` of all factors by date as winsorized__<factor>, beside the keys and the columns to `keep`: rows stay wide, are moved and
    sorted once, by date, and all medians are made there."""
    w, d = Window.partitionBy(date), panel.select(*keys, *(c for c in keep if c not in keys), *(c for c in factors if c not in (*keys, *keep)))
    d = d.withColumns({f"_med_{f}": F.median(f).over(w) for f in factors})
    d = d.withColumns({f"_mad_{f}": F.median(F.abs(F.col(f) - F.col(f"_med_{f}"))).over(w) * MAD_SCALE for f in factors})

    def clipped(f: str) -> Column:
        x, med, reach = F.col(f), F.col(f"_med_{f}"), n_mad * F.col(f"_mad_{f}")
        return F.when(x.isNull(), None).when(F.col(f"_mad_{f}") / MAD_SCALE > FLAT, F.greatest(med - reach, F.least(med + reach, x))).otherwise(x)

    return d.select(*keys, *(c for c in keep if c not in keys), *(clipped(f).alias(f"winsorized__{f}") for f in factors))


def mad_sensitivity(panel: DataFrame, keys: list[str], date: str, factors: list[str], multipliers: tuple[float, ...] = (2.5, 3.0, 3.5)) -> DataFrame:
    """Per factor and multiplier: observations, clipped rows and rate, affected dates, median
    and largest change, and mean rank correlation by date of raw and clipped values. Medians and deviations are made
    once for all multipliers; the clipped rows are stored and the parts of the report read them there."""
    forbid_columns(panel)
    w, x = Window.partitionBy(date, "factor"), F.col("value")
    d = dealt(to_long(panel.select(*keys, *factors), keys, factors), date, "factor").withColumn("_med", F.median(x).over(w)).withColumn("_mad", F.median(F.abs(x - F.col("_med"))).over(w))
    d = d.withColumn("multiplier", F.explode(F.array(*map(F.lit, multipliers))))
    reach = F.col("multiplier") * F.col("_mad") * MAD_SCALE
    clipped = F.when(x.isNotNull() & (F.col("_mad") > FLAT), F.greatest(F.col("_med") - reach, F.least(F.col("_med") + reach, x))).otherwise(x)
    d = stored(d.select(date, "factor", "multiplier", "value", clipped.alias("clipped")), "clipped-panel")
    change = F.abs(F.col("clipped") - F.col("value"))
    moved = change > 1e-8 + 1e-5 * F.abs(F.col("value"))
    a = d.groupBy("factor", "multiplier").agg(
        F.count("value").alias("n_observed"),
        F.count_if(moved).alias("n_clipped"),
        F.count_if(moved & (F.col("clipped") > F.col("value"))).alias("n_lower"),
        F.count_if(moved & (F.col("clipped") < F.col("value"))).alias("n_upper"),
        F.countDistinct(F.when(moved, F.col(date))).alias("n_dates"),
        F.max(F.when(moved, change)).alias("max_change"),
    )
    r = stored(spearman_by(d, ["factor", "multiplier", date], "value", "clipped"), "clipped-correlations").groupBy("factor", "multiplier").agg(F.avg("rank_ic").alias("mean_rank_correlation"))
    m = exact_quantiles(d.withColumn("_change", F.when(moved, change)), ["factor", "multiplier"], "_change", (0.5,)).select("factor", "multiplier", F.col("value").alias("median_change"))
    return a.join(m, ["factor", "multiplier"], "left").join(r, ["factor", "multiplier"]).withColumn("clip_rate", F.try_divide("n_clipped", "n_observed"))


def clipping_audit(sensitivity: DataFrame) -> DataFrame:
    """(factor, is_monotone, most_clipped): a wider bound must not clip more rows."""
    before = F.lag("n_clipped").over(Window.partitionBy("factor").orderBy("multiplier"))
    d = sensitivity.withColumn("_ok", F.coalesce(F.col("n_clipped") <= before, F.lit(True)))
    return d.groupBy("factor").agg(F.bool_and("_ok").alias("is_monotone"), F.max("n_clipped").alias("most_clipped"))


def spearman_matrix(panel: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """(factor_a, factor_b, n_pairs, correlation) for a <= b, on pairwise complete rows. Keys are unique in the panel.

    The rank of a value of a among the rows that also have b is what the rows with b count below it, so one pass over
    the distinct values of each factor, with a count for each other factor, gives the ranks for all pairs. A row's ranks
    then meet by its keys, and only sums by pair are shuffled. The panel is read once and stored in long form.
    NaN is null; infinities are the ends.
    """
    there = {f: clean(f).isNotNull() for f in factors}
    rows = F.array(*(F.struct(F.lit(k).alias("_f"), clean(f).alias("_x")) for k, f in enumerate(factors)))
    wide = panel.select(*keys, *(on.alias(f"_has{k}") for k, on in enumerate(there.values())), rows.alias("_rows"))
    has, counts = [f"_has{k}" for k in range(len(factors))], [f"_n{k}" for k in range(len(factors))]
    long = stored(wide.select(*keys, *has, F.inline("_rows")).where("_x is not null"), "long-panel")
    v = below(dealt_values(long, ["_f"], "_x", {n: F.count_if(h) for n, h in zip(counts, has, strict=True)}), ["_f"], "_x", counts)
    rank = F.array(*(F.col(f"{n}_below") + (F.col(n) + 1) / 2.0 for n in counts))
    ranked = long.select(*keys, "_f", "_x").join(v.select("_f", "_x", rank.alias("_r")), ["_f", "_x"])
    met = ranked.groupBy(*keys).agg(*(F.first(F.when(F.col("_f") == k, F.col("_r")), ignorenulls=True).alias(f"_r{k}") for k in range(len(factors))))
    pair = lambda a, b: F.struct(F.lit(min(factors[a], factors[b])).alias("factor_a"), F.lit(max(factors[a], factors[b])).alias("factor_b"), F.get(f"_r{a}", F.lit(b)).alias("rx"), F.get(f"_r{b}", F.lit(a)).alias("ry"))
    pairs = met.select(F.inline(F.array(*(pair(a, b) for a in range(len(factors)) for b in range(a, len(factors))))))
    return pairs.where("rx is not null and ry is not null").groupBy("factor_a", "factor_b").agg(F.count("*").alias("n_pairs"), pearson("rx", "ry").alias("correlation"))


def rank_overlap(matrix: DataFrame, k: int = 8) -> DataFrame:
    """The k pairs of different factors with the largest absolute correlation."""
    d = matrix.where("factor_a < factor_b").withColumn("strength", F.abs("correlation"))
    return d.orderBy(F.col("strength").desc_nulls_last(), "factor_a", "factor_b").limit(k)


def control_correlation(df: DataFrame, value: str, date: str, numeric: list[str], category: str | None = None) -> DataFrame:
    """One row: the mean absolute correlation by date and control; dummies of all but the first
    category of a date count as controls, a missing category as 0."""
    rows = [F.struct(F.lit(c).alias("control"), F.col(c).cast("double").alias("z")) for c in numeric]
    d = df.select(date, value, F.inline(F.array(*rows))) if numeric else None
    if category:
        cats = df.where(F.col(category).isNotNull()).select(date, F.col(category).alias("_c")).distinct()
        cats = cats.withColumn("_n", F.row_number().over(Window.partitionBy(date).orderBy("_c"))).where("_n > 1")
        dummies = df.join(cats, date).select(date, value, F.col("_c").cast("string").alias("control"), F.coalesce((F.col(category) == F.col("_c")).cast("double"), F.lit(0.0)).alias("z"))
        d = dummies if d is None else d.unionByName(dummies)
    return d.groupBy(date, "control").agg(pearson(value, "z").alias("r")).agg(F.avg(F.abs("r")).alias("mean_abs_correlation"))


@dataclass(frozen=True)
class Policy:
    """How one factor is neutralised; no controls leave it as it is."""

    factor: str
    numeric: tuple[str, ...] = ()
    category: str | None = None


def family_fits(panel: DataFrame, date: str, values: list[str], numeric: list[str], category: str | None = None) -> DataFrame:
    """(date, _cat, _fits): for each date and category, by number of the value, the means, slopes and residual deviation of least-squares
    fits of all `values` on the same controls (an intercept, up to two numeric ones, the dummies of the category).

    Rows are summed by date, category and missing pattern of the values: the centred products of the controls are made once
    for a pattern, whatever the number of values, and those with each value beside them. The
    patterns that a value occurs in are merged by their means, so nothing cancels, and the 1 or 2 normal
    equations are solved on a row for each date and value. Only such sums are shuffled; a hot date is combined before.
    """
    if len(numeric) > 2 or len(values) > 62:
        raise ValueError("two numeric controls and 62 values at most")
    x, k = [F.col(c).cast("double") for c in numeric], len(numeric)
    cat = F.col(category) if category else F.lit(0)
    complete = cat.isNotNull()
    for c in x:
        complete = complete & c.isNotNull()
    there = [complete & F.col(v).isNotNull() for v in values]
    pattern = sum((F.when(on, F.lit(1 << p)).otherwise(F.lit(0)).cast("long") for p, on in enumerate(there)), F.lit(0).cast("long"))
    d = panel.select(date, cat.alias("_cat"), pattern.alias("_pattern"), *(c.alias(f"_x{i}") for i, c in enumerate(x)), *(F.col(v).cast("double").alias(f"_y{p}") for p, v in enumerate(values)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    product = lambda a, b: F.covar_pop(a, b) * F.count("*")
    sums = d.groupBy(date, "_cat", "_pattern").agg(
        F.count("*").alias("n"), *(F.avg(f"_x{i}").alias(f"m{i}") for i in range(k)), *(product(f"_x{i}", f"_x{j}").alias(f"c{i}_{j}") for i, j in pairs),
        *(s for p in range(len(values)) for s in (F.avg(f"_y{p}").alias(f"my{p}"), product(f"_y{p}", f"_y{p}").alias(f"cy{p}"), *(product(f"_x{i}", f"_y{p}").alias(f"c{i}_y{p}") for i in range(k)))),
    )
    cats = sums.where("_cat is not null").groupBy(date).agg(F.countDistinct("_cat").alias("_all"))
    # the value is variable k, beside the controls 0 to k - 1
    one = lambda p: F.struct(F.lit(p).alias("p"), F.col(f"my{p}").alias(f"m{k}"), F.col(f"cy{p}").alias(f"c{k}_{k}"), *(F.col(f"c{i}_y{p}").alias(f"c{i}_{k}") for i in range(k)))
    rows = F.filter(F.array(*map(one, range(len(values)))), lambda r: F.col("_pattern").bitwiseAND(F.pow(F.lit(2.0), r["p"]).cast("long")) != 0)
    d = sums.select(date, "_cat", "n", *(f"m{i}" for i in range(k)), *(f"c{i}_{j}" for i, j in pairs), F.inline(rows))
    every = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

    def merged(d: DataFrame, by: list[str], center: list[str]) -> DataFrame:
        """Sums of parts of a group around the means of the whole: n, means and centred products."""
        w = Window.partitionBy(*by)
        d = d.withColumns({f"_g{i}": F.sum(F.col("n") * F.col(f"m{i}")).over(w) / F.sum("n").over(w) for i in range(k + 1)})
        shifted = lambda i, j: F.col(f"c{i}_{j}") + F.col("n") * (F.col(f"m{i}") - F.col(f"_g{i}")) * (F.col(f"m{j}") - F.col(f"_g{j}"))
        return d.groupBy(*by).agg(F.sum("n").alias("n"), *(F.first(f"_g{i}").alias(f"m{i}") for i in range(k + 1)), *(F.sum(shifted(i, j)).alias(f"c{i}_{j}") for i, j in every), *center)

    within = merged(d, [date, "_cat", "p"], [])
    whole = merged(within, [date, "p"], [F.count("*").alias("_cats"), *(F.sum(f"c{i}_{j}").alias(f"s{i}_{j}") for i, j in every)]).join(cats, date)
    s = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}")
    usable = (F.col("n") > F.col("_cats") + k) & (F.col("_cats") == F.col("_all"))
    if k == 0:
        slopes = []
    elif k == 1:
        usable = usable & (s(0, 0) > 1e-12 * F.col("c0_0"))
        slopes = [F.try_divide(s(0, 1), s(0, 0))]
    else:
        det = s(0, 0) * s(1, 1) - s(0, 1) * s(0, 1)
        usable = usable & (det > 1e-12 * s(0, 0) * s(1, 1))
        slopes = [F.try_divide(s(0, 2) * s(1, 1) - s(1, 2) * s(0, 1), det), F.try_divide(s(1, 2) * s(0, 0) - s(0, 2) * s(0, 1), det)]
    usable = usable if numeric or category else F.lit(True)
    left = s(k, k) - sum((b * s(i, k) for i, b in enumerate(slopes)), F.lit(0.0))
    std = F.when(left > 1e-13 * s(k, k), F.sqrt(left / F.col("n"))).otherwise(0.0)  # below is the rounding of a perfect fit
    solved = whole.select(date, "p", usable.alias("usable"), std.alias("std"), F.array(*slopes).cast("array<double>").alias("slopes"))
    fits = within.select(date, "_cat", "p", F.array(*(f"m{i}" for i in range(k + 1))).alias("means")).join(solved, [date, "p"])
    return fits.groupBy(date, "_cat").agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct("usable", "means", "slopes", "std")))).alias("_fits"))


def preprocess_family(panel: DataFrame, date: str, policies: list[Policy]) -> DataFrame:
    """neutralized__ and standardized__ columns of each policy's winsorized__ factor.

    Policies with the same controls are fitted together (`family_fits`), and their fits, a row for each date and category, are joined to the
    panel once; the panel itself is not shuffled as long as Spark broadcasts the fits. It is read once for each set of controls and
    once for the result, so a panel that is not stored should be.
    """
    forbid_columns(panel)
    columns, out = panel.columns, {}
    groups: dict[tuple, list[Policy]] = {}
    for p in policies:
        groups.setdefault((p.numeric, p.category), []).append(p)
    for g, ((numeric, category), members) in enumerate(groups.items()):
        fits = family_fits(panel.select(columns), date, [f"winsorized__{m.factor}" for m in members], list(numeric), category)
        fits = fits.withColumnsRenamed({"_cat": f"_cat{g}", "_fits": f"_fits{g}"})
        panel = panel.withColumn(f"_cat{g}", F.col(category) if category else F.lit(0)).join(fits, [date, f"_cat{g}"], "left")
        for k, m in enumerate(members):
            fit, y = F.element_at(f"_fits{g}", F.lit(k)), F.col(f"winsorized__{m.factor}")
            residual = y - F.get(fit["means"], F.lit(len(numeric)))
            for i, c in enumerate(numeric):
                residual = residual - F.get(fit["slopes"], F.lit(i)) * (F.col(c) - F.get(fit["means"], F.lit(i)))
            residual = F.when(fit["usable"], residual)
            out[f"neutralized__{m.factor}"] = residual if numeric or category else y
            out[f"standardized__{m.factor}"] = F.when(residual.isNull(), None).when(fit["std"] > FLAT, residual / fit["std"]).otherwise(0.0)
    return panel.withColumns(out).select(*(c for c in columns if c not in out), *out)


def preprocess_registered(panel: DataFrame, factor: str, date: str, direction: int, n_mad: float = 3.0) -> DataFrame:
    """processed_factor: the direction times the stored z-score, or one made here."""
    if f"standardized__{factor}" not in panel.columns:
        panel = standardize(winsorize_mad(panel, factor, [date], n_mad), f"winsorized__{factor}", [date], f"standardized__{factor}")
    return panel.withColumn("processed_factor", direction * F.col(f"standardized__{factor}"))


def attach_market_cap(panel: DataFrame, caps: DataFrame, key: str, date: str, cap: str = "market_cap", industry: str = "industry") -> DataFrame:
    """As-of log of the last market value on or before the date, its age in days, and the industry
    as a control. Values that are not positive, and a value from the future, are errors when rows are made."""
    from .asof import asof_backward

    x = F.col(cap)
    caps = caps.withColumn(cap, F.when(x.isNull() | (x > 0), x).otherwise(F.raise_error(F.lit("a market value is not positive")).cast("double")))
    d = asof_backward(panel, caps.withColumnRenamed(date, "_cap_date"), key, date, "_cap_date", [cap], "market_cap_date")
    late = F.col("market_cap_date") > F.col(date)
    d = d.withColumn("market_cap_date", F.when(late, F.raise_error(F.lit("a market value from the future")).cast("date")).otherwise(F.col("market_cap_date")))
    return d.withColumn("log_market_cap", F.log(cap)).withColumn("market_cap_age", F.datediff(date, "market_cap_date")).withColumn("industry_control", F.col(industry).cast("string"))


def family_diagnostics(result: DataFrame, date: str, policies: list[Policy]) -> DataFrame:
    """Per policy of `preprocess_family`: observations, processed ones and their share, the mean
    absolute correlation with the controls before and after (null without controls), and the
    mean rank correlation by date of winsorised and processed values."""
    out = None
    for p in policies:
        a, z = f"winsorized__{p.factor}", f"standardized__{p.factor}"
        row = result.agg(F.lit(p.factor).alias("factor"), F.count(a).alias("n_observed"), F.count(z).alias("n_processed"), (F.count(z) / F.count("*")).alias("coverage"))
        for name, c in (("exposure_before", a), ("exposure_after", f"neutralized__{p.factor}")):
            if p.numeric or p.category:
                row = row.crossJoin(control_correlation(result, c, date, list(p.numeric), p.category).select(F.col("mean_abs_correlation").alias(name)))
            else:
                row = row.withColumn(name, F.lit(None).cast("double"))
        row = row.crossJoin(stored(spearman_by(result, [date], a, z), "date-correlations").agg(F.avg("rank_ic").alias("rank_correlation")))
        out = row if out is None else out.unionByName(row)
    return out
