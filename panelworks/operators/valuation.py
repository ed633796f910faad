"""Conversion value, premium within parity buckets, coverage, tails and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import PARITY_LABELS, bucket, conversion_value, double_low, premium, valid_price
from ..functions.ranks import exact_quantiles
from ..sources.folders import stored
from .checks import duplicate_keys, key_difference, mismatch


def conversion_valuation(panel: DataFrame, close: str = "close", stock_close: str = "stock_close", convert_price: str = "convert_price") -> DataFrame:
    """Adds conversion_value, conversion_premium, double_low and valuation_available; all
    are null unless the three prices are positive."""
    ok = valid_price(close) & valid_price(stock_close) & valid_price(convert_price)
    d = panel.withColumn("valuation_available", ok).withColumn("conversion_value", F.when(ok, conversion_value(stock_close, convert_price)))
    d = d.withColumn("conversion_premium", F.when(ok, premium(close, "conversion_value")))
    return d.withColumn("double_low", F.when(ok, double_low(close, "conversion_premium")))


def relative_premium(panel: DataFrame, by: list[str], value: str = "conversion_premium", parity: str = "conversion_value", minimum: int = 5) -> DataFrame:
    """Adds parity_bucket, bucket_count, bucket_median, relative_premium and parity_score:
    the premium less the exact median of its date and bucket, where the bucket holds at least `minimum`."""
    d = panel.withColumn("parity_bucket", F.when(F.col(value).isNotNull(), bucket(parity)))
    w = Window.partitionBy(*by, "parity_bucket")
    on = F.col("parity_bucket").isNotNull()
    d = d.withColumn("bucket_count", F.when(on, F.count(value).over(w))).withColumn("bucket_median", F.when(on, F.median(value).over(w)))
    d = d.withColumn("relative_premium", F.when(F.col("bucket_count") >= minimum, F.col(value) - F.col("bucket_median")))
    return d.withColumn("parity_score", -F.col("relative_premium"))


def bucket_no(label: str = "parity_bucket"):
    return F.array_position(F.array(*map(F.lit, PARITY_LABELS)), F.col(label)).cast("int")


def parity_coverage(panel: DataFrame, by: list[str]) -> DataFrame:
    """Rows, valued rows, scored rows, medians and shares of each date and bucket."""
    d = panel.groupBy(*by, "parity_bucket").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("valuation_available").cast("long")).alias("n_valued"),
        F.count("relative_premium").alias("n_scored"),
        F.median("conversion_value").alias("median_value"),
        F.median("conversion_premium").alias("median_premium"),
    )
    return d.withColumn("valued_share", F.col("n_valued") / F.col("n_rows")).withColumn("scored_share", F.col("n_scored") / F.col("n_rows"))


def tails(panel: DataFrame, value: str, keys: list[str], k: int = 20) -> DataFrame:
    """The k smallest and the k largest of the other rows, by value then keys."""
    d = panel.where(F.col(value).isNotNull()).select(*keys, value)
    low = d.orderBy(value, *keys).limit(k)
    high = d.join(low.select(*keys), keys, "left_anti").orderBy(F.col(value).desc(), *keys).limit(k)
    return low.withColumn("tail", F.lit("low")).unionByName(high.withColumn("tail", F.lit("high")))


def tails_by_factor(panel: DataFrame, factors: list[str], keys: list[str], k: int = 10) -> DataFrame:
    """The k smallest and largest values of each factor, in long form."""
    d = panel.unpivot(keys, factors, "factor", "value").where("value is not null")
    up, down = Window.partitionBy("factor").orderBy("value", *keys), Window.partitionBy("factor").orderBy(F.col("value").desc(), *keys)
    low = d.withColumn("position", F.row_number().over(up)).where(F.col("position") <= k).withColumn("tail", F.lit("low"))
    high = d.withColumn("position", F.row_number().over(down)).where(F.col("position") <= k).withColumn("tail", F.lit("high"))
    return low.unionByName(high)


def valuation_audit(panel: DataFrame, expected: DataFrame, keys: list[str], by: list[str], close: str = "close", stock_close: str = "stock_close", convert_price: str = "convert_price", minimum: int = 5) -> DataFrame:
    """One row: rows, valued and scored rows and their shares, repeated keys, keys missing from or
    beyond `expected`, and mismatches of each column with its formula, recomputed from the prices and, for the
    counts and medians of a bucket, from the panel's own premiums. `passed` if all are 0."""
    ok = (F.col(close) > 0) & (F.col(stock_close) > 0) & (F.col(convert_price) > 0)
    prem, n = F.col("conversion_premium"), F.col("_count")
    grouped = (F.col("conversion_value") > 0) & prem.isNotNull() & F.col("parity_bucket").isNotNull()
    w = Window.partitionBy(*by, "parity_bucket")
    d = panel.withColumn("_count", F.when(grouped, F.count(F.when(grouped, prem)).over(w))).withColumn("_median", F.when(grouped, F.median(F.when(grouped, prem)).over(w)))
    pairs = {
        "value_mismatches": (F.col("conversion_value"), F.when(ok, F.col(stock_close) / F.col(convert_price) * 100)),
        "premium_mismatches": (prem, F.when(ok, F.col(close) / F.col("conversion_value") - 1)),
        "double_low_mismatches": (F.col("double_low"), F.when(ok, F.col(close) + 100 * prem)),
        "count_mismatches": (F.when(grouped, F.col("bucket_count")), n),
        "median_mismatches": (F.when(grouped, F.col("bucket_median")), F.col("_median")),
        "relative_mismatches": (F.when(grouped, F.col("relative_premium")), F.when(n >= minimum, prem - F.col("_median"))),
        "score_sign_mismatches": (F.when(F.col("relative_premium").isNotNull(), F.col("parity_score")), -F.col("relative_premium")),
    }
    row = d.agg(
        F.count("*").alias("n_rows"),
        F.count_if("valuation_available").alias("n_valued"),
        F.count("parity_score").alias("n_scored"),
        F.count_if(F.col("valuation_available") != prem.isNotNull()).alias("availability_mismatches"),
        F.count_if((n < minimum) & F.col("parity_score").isNotNull()).alias("small_group_scores"),
        *(F.count_if(mismatch(*p)).alias(k) for k, p in pairs.items()),
    )
    apart = key_difference(panel, expected, keys).agg(F.count_if(F.col("side") == "missing").alias("missing_keys"), F.count_if(F.col("side") == "extra").alias("extra_keys"))
    out = row.crossJoin(apart).crossJoin(duplicate_keys(panel, keys).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("repeated_keys")))
    faults = [c for c in out.columns if c.endswith(("mismatches", "_keys", "scores"))]
    out = out.withColumn("valued_share", F.try_divide("n_valued", "n_rows")).withColumn("scored_share", F.try_divide("n_scored", "n_rows"))
    return out.withColumn("passed", sum((F.col(c) for c in faults), F.lit(0)) == 0)


def factor_audit(actual: DataFrame, expected: DataFrame, keys: list[str], factors: list[str], flags: tuple[str, ...] = ()) -> DataFrame:
    """One row that compares a factor panel with its recomputation: rows, repeated keys, keys
    missing or beyond it, mismatches of all values and `flags`, and coverage__<factor>. Both are read several times, so give stored ones;
    what moves their rows is stored in turn, as one row, so that its tasks stay small."""
    left = actual.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in (*factors, *flags)))
    both = left.join(expected.select(*keys, *factors, *flags), keys)
    wrong = [mismatch(F.col(f"_a_{c}"), F.col(c)).cast("long") for c in factors] + [(~F.col(f"_a_{c}").eqNullSafe(F.col(c))).cast("long") for c in flags]
    off = stored(both.agg(F.coalesce(F.sum(sum(wrong[1:], wrong[0])), F.lit(0)).alias("mismatches")), "mismatches")
    row = actual.agg(F.count("*").alias("n_rows"), *((F.count(c) / F.count("*")).alias(f"coverage__{c}") for c in factors))
    tagged = lambda d, n: d.select(*keys, F.lit(n).alias("_a"), F.lit(1 - n).alias("_e"))
    g = tagged(actual, 1).unionByName(tagged(expected, 0)).groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_e").alias("_e"))
    null = F.lit(False)  # equals no key
    for k in keys:
        null = null | F.col(k).isNull()
    missing, extra = (F.col("_e") > 0) & ((F.col("_a") == 0) | null), (F.col("_a") > 0) & ((F.col("_e") == 0) | null)
    apart = stored(g.agg(F.count_if(missing).alias("missing_keys"), F.count_if(extra).alias("extra_keys"), F.coalesce(F.sum(F.when(F.col("_a") > 1, F.col("_a") - 1)), F.lit(0)).alias("repeated_keys")), "keys-apart")
    out = row.crossJoin(off).crossJoin(apart)
    return out.withColumn("passed", F.col("mismatches") + F.col("missing_keys") + F.col("extra_keys") + F.col("repeated_keys") == 0)


def quantiles(panel: DataFrame, columns: list[str], points: tuple[float, ...] = (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0), by: list[str] | None = None) -> DataFrame:
    """(by, column, point, value) in long form; no task sorts a whole column."""
    long = panel.unpivot(by or [], columns, "column", "_value")
    return exact_quantiles(long, [*(by or []), "column"], "_value", points)


def bucket_report(panel: DataFrame) -> DataFrame:
    """(bucket_no, parity_bucket, n_rows, n_valued, median_premium, median_score, coverage) over all dates, medians by selection.
    The panel is read once and stored."""
    on = stored(panel.where("parity_bucket is not null").select("parity_bucket", "conversion_premium", "parity_score"), "bucketed")
    d = on.groupBy("parity_bucket").agg(F.count("*").alias("n_rows"), F.count("conversion_premium").alias("n_valued"), F.avg(F.col("parity_score").isNotNull().cast("double")).alias("coverage"))
    mid = exact_quantiles(on.unpivot(["parity_bucket"], ["conversion_premium", "parity_score"], "_of", "_value"), ["parity_bucket", "_of"], "_value", (0.5,))
    of = lambda c: F.max(F.when(F.col("_of") == c, F.col("value")))
    d = d.join(mid.groupBy("parity_bucket").agg(of("conversion_premium").alias("median_premium"), of("parity_score").alias("median_score")), "parity_bucket", "left")
    return d.select(bucket_no().alias("bucket_no"), "parity_bucket", "n_rows", "n_valued", "median_premium", "median_score", "coverage")
