"""Guards and audits: keys, formulas, fingerprints, run identity."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")


#: How names of columns begin that look into the future.
FUTURE = ("forward_return", "label_")


def future_columns(df: DataFrame, prefixes: tuple[str, ...] = FUTURE) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def forbid_columns(df: DataFrame, prefixes: tuple[str, ...] = FUTURE) -> None:
    if found := future_columns(df, prefixes):
        raise ValueError(f"columns from the future: {found}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"keys are not unique: {keys}")


def mismatch(actual: Column, expected: Column, atol: float = 1e-10, rtol: float = 1e-10) -> Column:
    """True where one is null and the other not, or they differ by more than the tolerance."""
    far = F.abs(actual - expected) > atol + rtol * F.abs(expected)
    return (actual.isNull() != expected.isNull()) | F.coalesce(far, F.lit(False))


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in only one of two tables, with side `missing` (not in a) or `extra` (not in b)."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return y.join(x, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(x.join(y, keys, "left_anti").withColumn("side", F.lit("extra")))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, hash_xor, hash_sum): equal for equal rows in any order, in any engine that has MD5: a row's number is the first 15
    hexadecimal digits of the MD5 of its values as text, by column name, each after a v, or n alone for null, with 0x1F between
    them. hash_sum is decimal text. Floating-point columns, which engines spell differently, are an error: round and cast them first."""
    if floats := [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]:
        raise TypeError(f"floating-point columns have no one text: {floats}")
    row = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in sorted(df.columns)))
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    out = df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("hash_xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"))
    return out.withColumn("hash_sum", F.col("hash_sum").cast("string"))


def holdout_guard(partition: str, unlocked: bool, locked: tuple[str, ...] = ("holdout",)) -> None:
    """Refuses a locked partition before anything is planned."""
    if partition in locked and not unlocked:
        raise PermissionError(f"partition {partition} is locked")


def research_slice(df: DataFrame, date: str, start: str, end: str, history: bool = False) -> DataFrame:
    """Rows of a named partition's dates; a history keeps what it looks back on."""
    if start > end:
        raise ValueError("a partition ends before it starts")
    d = df.where(F.col(date) <= F.lit(end).cast("date"))
    return d if history else d.where(F.col(date) >= F.lit(start).cast("date"))


def run_identity(factor: str, params: dict, shared: dict) -> tuple[str, str]:
    """(run id, comparison group id): the group depends on the shared settings alone."""
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    return digest({"factor": factor, "params": params, "shared": shared}), digest(shared)
