"""Scalar expressions on columns: cleaning, prices, buckets, controls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grades from best to worst; the best scores 19, the worst 1.
RATINGS = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC", "CC", "C")
# Left-closed parity buckets.
PARITY_EDGES = (0.0, 70.0, 90.0, 100.0, 110.0, 130.0)
PARITY_LABELS = ("<70", "70-90", "90-100", "100-110", "110-130", ">=130")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_date(c: Column | str) -> Column:
    """A date from yyyyMMdd as text or number (also with .0) or an ISO text; else null."""
    s = F.regexp_replace(col(c).cast("string"), r"\.0$", "")
    return F.coalesce(F.try_to_date(s, "yyyyMMdd"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))


def number(c: Column | str) -> Column:
    """A double; text that is none, NaN and the infinite are null."""
    x = col(c).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def clean_code(c: Column | str) -> Column:
    return F.trim(F.ltrim(col(c).cast("string"), F.lit("\ufeff")))


def rating_score(c: Column | str) -> Column:
    """19 for the best grade to 1 for the worst; an unknown grade is null."""
    pairs = [x for k, r in enumerate(RATINGS) for x in (F.lit(r), F.lit(len(RATINGS) - k))]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(col(c))))


def valid_price(c: Column | str) -> Column:
    x = col(c)
    return F.coalesce((x > 0) & (x < float("inf")), F.lit(False))


def bucket(c: Column | str, edges: tuple[float, ...] = PARITY_EDGES, labels: tuple[str, ...] = PARITY_LABELS) -> Column:
    """Label of the left-closed interval that holds the value; null below the first edge."""
    x, out = col(c), F.when(col(c) < edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels, strict=False):
        out = out.when(x < upper, label)
    return out.when(x.isNotNull(), labels[-1])


def first_match(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """Label of the first rule that holds; a null rule does not."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(default).cast("string"))


def conversion_value(stock_close: Column | str, convert_price: Column | str) -> Column:
    s, p = col(stock_close), col(convert_price)
    return F.when(valid_price(s) & valid_price(p), s / p * 100)


def premium(close: Column | str, value: Column | str) -> Column:
    c, v = col(close), col(value)
    return F.when(valid_price(c) & valid_price(v), c / v - 1)


def double_low(close: Column | str, prem: Column | str) -> Column:
    return col(close) + 100 * col(prem)


def log_size(c: Column | str) -> Column:
    """Log of a balance; a balance that is not positive is an error."""
    x = col(c)
    return F.when(x.isNull(), None).when(x > 0, F.log(x)).otherwise(F.raise_error(F.lit("a balance is not positive")).cast("double"))


def remaining_years(maturity: Column | str, date: Column | str) -> Column:
    """Days to maturity over 365.25; a maturity before the date is an error."""
    d = F.datediff(col(maturity), col(date))
    return F.when(d.isNull(), None).when(d >= 0, d / 365.25).otherwise(F.raise_error(F.lit("a maturity lies in the past")).cast("double"))


def exchange_suffix(code: Column | str) -> Column:
    return F.right(col(code), F.lit(2))


def year_of(c: Column | str) -> Column:
    """The first four characters of a date or a date's text."""
    return F.substring(col(c).cast("string"), 1, 4).cast("int")
