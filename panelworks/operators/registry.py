"""Factors as named, checked functions over a bundle of tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import dealt
from ..sources.folders import stored
from .calendar import calendar
from .checks import require_columns
from .cross_section import standardize, winsorize_mad
from .evaluation import ic_series, summarize_ic
from .windows import frame

KEYS = ["signal_date", "code"]


@dataclass(frozen=True)
class FactorSpec:
    name: str
    family: str
    direction: int
    required: tuple[str, ...]
    params: dict = field(default_factory=dict)
    neutralizers: tuple[str, ...] = ()
    version: str = "1"

    def __post_init__(self) -> None:
        if self.direction not in (1, -1):
            raise ValueError("direction is 1 or -1")


#: Keys of the bundle's tables.
TABLE_KEYS = {"signal": KEYS, "valuation": KEYS, "bond_daily": ["trade_date", "code"], "stock_daily": ["trade_date", "stock"], "lifecycle": ["trade_date", "code"]}


@dataclass(frozen=True)
class FactorBundle:
    """Lazy tables by their keys; the last three are histories. Columns are checked when the bundle
    is made; `bundle_violations` counts faulty rows."""

    signal: DataFrame
    valuation: DataFrame | None = None
    bond_daily: DataFrame | None = None
    stock_daily: DataFrame | None = None
    lifecycle: DataFrame | None = None

    def __post_init__(self) -> None:
        for name, table in self.tables():
            require_columns(table, TABLE_KEYS[name])
            for c in ("signal_date", "trade_date", "available_date", "effective_date"):
                if c in table.columns and table.schema[c].dataType.typeName() != "date":
                    raise TypeError(f"{c} of {name} is not a date")

    def tables(self) -> list[tuple[str, DataFrame]]:
        return [(n, getattr(self, n)) for n in TABLE_KEYS if getattr(self, n) is not None]

    def table(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise KeyError(f"the bundle has no {name}")
        return found


def bundle_violations(bundle: FactorBundle) -> DataFrame:
    """(table, null_keys, repeated_keys, from_future): all must be 0; the future is an
    available_date after a signal's date."""
    out = None
    for name, t in bundle.tables():
        keys = TABLE_KEYS[name]
        null = F.count_if(F.col(keys[0]).isNull() | F.col(keys[1]).isNull())
        late = F.count_if(F.col("available_date") > F.col("signal_date")) if name == "signal" and "available_date" in t.columns else F.lit(0).cast("long")
        row = t.agg(null.alias("null_keys"), late.alias("from_future")).crossJoin(t.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys")))
        row = row.select(F.lit(name).alias("table"), "null_keys", "repeated_keys", "from_future")
        out = row if out is None else out.unionByName(row)
    return out


def factor_output(df: DataFrame, value: str) -> DataFrame:
    """signal_date, code, raw_factor, available_date (the signal date where observed)."""
    return df.select(*KEYS, F.col(value).cast("double").alias("raw_factor"), F.when(F.col(value).isNotNull(), F.col("signal_date")).alias("available_date"))


def factor_violations(frame: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One row of counters: repeated keys, values that are not finite, values from the
    future or without a date, and keys outside the context. All must be 0. Keys of the frame and of the context are moved
    once, together; the frame is read twice."""
    x = F.col("raw_factor")
    a = frame.agg(
        (F.count("*") - F.count_if(F.col("signal_date").isNotNull() & F.col("code").isNotNull())).alias("null_keys"),
        F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("not_finite"),
        F.count_if(F.col("available_date") > F.col("signal_date")).alias("from_future"),
        F.count_if(x.isNotNull() & F.col("available_date").isNull()).alias("undated"),
    )
    tagged = lambda d, n: d.select(*KEYS, F.lit(n).alias("_f"), F.lit(1 - n).alias("_c"))
    rows = tagged(frame, 1) if context is None else tagged(frame, 1).unionByName(tagged(context, 0))
    g = rows.groupBy(*KEYS).agg(F.sum("_f").alias("_f"), F.sum("_c").alias("_c"))
    alone = (F.col("_c") == 0) | F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull()
    outside = [F.coalesce(F.sum(F.when(alone, F.col("_f"))), F.lit(0)).alias("outside_context")] if context is not None else []
    return a.crossJoin(stored(g.agg(F.count_if(F.col("_f") > 1).alias("repeated_keys"), *outside), "frame-keys"))


class FactorRegistry:
    def __init__(self) -> None:
        self._known: dict[str, tuple[FactorSpec, Callable[[Columns, dict], Columns]]] = {}

    def register(self, spec: FactorSpec, fn: Callable[[Columns, dict], Columns]) -> None:
        if spec.name in self._known:
            raise ValueError(f"{spec.name} is registered")
        self._known[spec.name] = (spec, fn)

    def names(self) -> list[str]:
        return sorted(self._known)

    def spec(self, name: str) -> FactorSpec:
        if name not in self._known:
            raise KeyError(f"unknown factor {name}")
        return self._known[name][0]

    def _prepared(self, name: str, bundle: FactorBundle, params: dict | None) -> tuple[FactorSpec, dict]:
        spec = self.spec(name)
        if unknown := set(params or {}) - set(spec.params):
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        for source in spec.required:
            table, _, column = source.partition(".")
            require_columns(bundle.table(table), [column])
        return spec, spec.params | (params or {})

    def calculate(self, name: str, bundle: FactorBundle, params: dict | None = None) -> DataFrame:
        """The standard columns of one factor for the bundle's signal keys."""
        spec, merged = self._prepared(name, bundle, params)
        return factor_output(self._known[name][1](Columns(bundle), merged).frame("value"), "value")

    def inventory(self, spark: SparkSession) -> DataFrame:
        names = [f.name for f in fields(FactorSpec)]
        rows = [tuple(str(getattr(self.spec(n), f)) if f not in ("name", "family", "direction") else getattr(self.spec(n), f) for f in names) for n in self.names()]
        return spark.createDataFrame(rows, ", ".join(f"{f} {'int' if f == 'direction' else 'string'}" for f in names))

    def batch(self, runs: list[tuple[str, dict]], bundle: FactorBundle) -> DataFrame:
        """All runs in long form (factor, signal_date, code, raw_factor, direction). Each source
        of the bundle is prepared once and joined once, whatever the number of runs; a run only adds an
        expression. Unknown names fail before anything is planned; runs with parameters are named by them."""
        prepared = [(n, *self._prepared(n, bundle, p)) for n, p in runs]
        c, cells = Columns(bundle), []
        for (name, spec, merged), (_, given) in zip(prepared, runs, strict=True):
            label = name + "".join(f"_{k}{v}" for k, v in sorted(given.items()))
            self._known[name][1](c, merged)
            cells.append(F.struct(F.lit(label).alias("factor"), c.value.alias("raw_factor"), F.lit(spec.direction).alias("direction")))
        return c.joined().select(*KEYS, F.inline(F.array(*cells))).select("factor", *KEYS, "raw_factor", "direction")


class Columns:
    """The signal keys with the columns that factors ask for. A plugin calls `need` for each table
    it reads and sets `value`; tables are joined once, however many plugins ask."""

    def __init__(self, bundle: FactorBundle) -> None:
        self.bundle, self.value = bundle, F.lit(None).cast("double")
        self._tables: dict[tuple, DataFrame] = {}
        self._valuation: list[str] = []

    def need_valuation(self, *names: str) -> None:
        """Columns of the bundle's valuation, which is joined once for all of them."""
        self._valuation += [n for n in names if n not in self._valuation]

    def need(self, name: tuple, keys: list[str], make: Callable[[], DataFrame]) -> None:
        if (name, tuple(keys)) not in self._tables:
            self._tables[name, tuple(keys)] = make()

    def joined(self) -> DataFrame:
        out = self.bundle.signal.select(*KEYS, *(c for c in ("stock",) if c in self.bundle.signal.columns))
        valuation = {("valuation", tuple(KEYS)): self.bundle.table("valuation").select(*KEYS, *self._valuation)} if self._valuation else {}
        for (_, keys), table in (valuation | self._tables).items():
            out = out.join(table, list(keys), "left")
        return out

    def frame(self, name: str) -> DataFrame:
        return self.joined().withColumn(name, self.value)

    def set(self, value: Column) -> Columns:
        self.value = value
        return self


def union_calendar(bundle: FactorBundle) -> DataFrame:
    """(trade_date, cal_idx) of all dates of the two price histories."""
    return calendar(bundle.table("bond_daily").select("trade_date").unionByName(bundle.table("stock_daily").select("trade_date")))


def _leg(daily: DataFrame, cal: DataFrame, key: str, price: Column, window: int, name: str) -> DataFrame:
    """(key, signal_date, name): the return over `window` positions of the calendar, where both
    ends have positive prices and enough days between have one."""
    d = daily.select(key, "trade_date", price.alias("_p")).join(F.broadcast(cal), "trade_date")
    back = F.max("_p").over(frame(key, "cal_idx", -window, -window))
    seen = F.count("_p").over(frame(key, "cal_idx", -window, 0))
    ok = (F.col("_p") > 0) & (back > 0) & (seen >= math.ceil((window + 1) * 0.8))
    return d.select(key, F.col("trade_date").alias("signal_date"), F.when(ok, F.col("_p") / back - 1).alias(name))


def default_registry() -> FactorRegistry:
    """The seven built-in factors, computed from the bundle's tables."""
    r = FactorRegistry()

    def passed(source: str):
        return lambda c, p: (c.need_valuation(source), c.set(F.col(source)))[1]

    for name, family, direction, source in (
        ("conversion_premium", "valuation", -1, "conversion_premium"),
        ("relative_premium_to_parity_median", "valuation", -1, "relative_premium"),
        ("stock_return_20d", "stock", 1, "stock_return_20d"),
        ("cb_return_20d", "bond", -1, "cb_return_20d"),
        ("cb_abnormal_turnover_20d", "bond", -1, "cb_abnormal_turnover_20d"),
    ):
        r.register(FactorSpec(name, family, direction, (f"valuation.{source}",)), passed(source))

    def low(c: Columns, p: dict) -> Columns:
        c.need_valuation("close", "conversion_premium")
        return c.set(F.col("close") + 100 * F.col("conversion_premium"))

    r.register(FactorSpec("double_low", "valuation", -1, ("valuation.close", "valuation.conversion_premium")), low)

    def spread(c: Columns, p: dict) -> Columns:
        n = p["window"]
        if n not in (5, 10, 20):
            raise ValueError("window is 5, 10 or 20")
        b = c.bundle
        number = lambda x: F.col(x).try_cast("double")
        c.need(("bond leg", n), ["code", "signal_date"], lambda: _leg(b.table("bond_daily"), union_calendar(b), "code", number("close"), n, f"_bond_{n}"))
        c.need(("stock leg", n), ["stock", "signal_date"], lambda: _leg(b.table("stock_daily"), union_calendar(b), "stock", number("close") * number("adj_factor"), n, f"_stock_{n}"))
        return c.set(F.col(f"_bond_{n}") - F.col(f"_stock_{n}"))

    needs = ("signal.stock", "bond_daily.close", "stock_daily.close", "stock_daily.adj_factor")
    r.register(FactorSpec("cb_stock_return_spread", "linkage", -1, needs, {"window": 20}), spread)
    return r


def evaluate_batch(batch: DataFrame, labels: DataFrame, min_assets: int = 5) -> tuple[DataFrame, DataFrame]:
    """(ic by factor and date, summary by factor) of a long batch, each factor winsorised,
    standardised and signed by date. The series is stored, the summary reads it there."""
    by = ["factor", "signal_date"]
    d = standardize(winsorize_mad(dealt(batch, *by), "raw_factor", by, name="_w"), "_w", by, "_z")
    d = d.withColumn("processed_factor", F.col("direction") * F.col("_z")).join(labels, KEYS)
    ic = stored(ic_series(d, by, min_assets=min_assets), "batch-ic")
    return ic, summarize_ic(ic, ["factor"])
