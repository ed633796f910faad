"""Readers and writers of panels, events and results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import clean_code, clean_date, number
from ..operators.calendar import open_dates
from ..operators.checks import assert_unique, require_columns


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; a repeated key is an error, found when the rows are made."""
    twice = F.count("*").over(Window.partitionBy(*keys)) > 1
    key = keys[0]
    fault = F.raise_error(F.lit(f"keys are not unique: {keys}")).cast(df.schema[key].dataType)
    return df.withColumn("_twice", twice).withColumn(key, F.when(F.col("_twice"), fault).otherwise(F.col(key))).drop("_twice")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a CSV with a header, all as text; the others are not parsed."""
    d = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(d, columns)
    return d.select(*columns)


def daily_bars(raw: DataFrame, key: str, date: str, values: list[str]) -> DataFrame:
    """Clean codes, dates and numbers; rows without a key or date go."""
    d = raw.select(clean_code(key).alias(key), clean_date(date).alias("trade_date"), *(number(v).alias(v) for v in values))
    return d.where(F.col(key).isNotNull() & F.col("trade_date").isNotNull())


def history(bars: DataFrame, codes: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Bars of the listed codes in an inclusive range of dates."""
    d = bars.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return d.join(codes.select(key).distinct(), key, "left_semi")


def renamed_history(source: DataFrame, names: dict[str, str], codes: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """As `history` on a source whose columns are renamed (source name -> name), in order."""
    d = source.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items())).withColumn("trade_date", clean_date("trade_date"))
    return history(d, codes, key, start, end)


def open_calendar(source: DataFrame, historical: DataFrame | None = None, date: str = "trade_date") -> DataFrame:
    return open_dates(source, historical, date)


def reference_universe(terms: DataFrame, daily_codes: DataFrame, key: str, kind: str, ordinary: str, list_date: str, size: str) -> DataFrame:
    """A row for each ordinary key with a list date and a size that also has daily data; of
    several, that with the earliest list date, then the smallest size."""
    d = terms.where((F.col(kind) == ordinary) & F.col(key).isNotNull() & F.col(list_date).isNotNull() & F.col(size).isNotNull())
    d = d.join(daily_codes.select(key).distinct(), key, "left_semi")
    rest = [c for c in d.columns if c not in (key, list_date, size)]
    best = d.groupBy(key).agg(F.min(F.struct(list_date, size, *rest)).alias("b"))
    return best.select(key, "b.*")


def ordinary_codes(terms: DataFrame, key: str, kind: str, ordinary: str) -> DataFrame:
    return terms.where((F.col(kind) == ordinary) & F.col(key).isNotNull()).select(key).distinct()


def members(snapshots: DataFrame, date: str, name: str, constituents: str, dates: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """(date, member, name) of the snapshots of one exact date or of listed dates."""
    d = snapshots.where(F.col(date) == F.lit(as_of).cast("date")) if as_of else snapshots
    if dates is not None:
        d = d.join(F.broadcast(dates.select(date).distinct()), date, "left_semi")
    return d.select(date, name, F.explode(constituents).alias("member")).where("member is not null")


def redemption_events(raw: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Renamed events with dates; the price falls back to its taxed form, the last trading
    day is never inferred; incomplete rows go and a repeated (key, date) is an error."""
    d = raw.select(*(F.col(a).alias(b) for a, b in names.items()))
    d = d.withColumn("effective_date", clean_date("effective_date")).withColumn("call_reg_date", clean_date("call_reg_date")).withColumn("payment_date", clean_date("payment_date"))
    d = d.withColumn("call_price", F.coalesce(number("call_price"), number("call_price_tax"))).drop("call_price_tax").withColumn("last_trade_date", F.lit(None).cast("date"))
    return unique_rows(d.dropna(subset=[key, "effective_date", "event_status"]), [key, "effective_date"])


def lifecycle_terms(raw: DataFrame, key: str) -> DataFrame:
    d = raw.select(clean_code(key).alias(key), *(clean_date(c).alias(c) for c in ("list_date", "delist_date", "maturity_date")), number("maturity_call_price").alias("maturity_call_price"))
    d = d.where(F.col(key).isNotNull()).withColumn("maturity_payment_date", F.lit(None).cast("date"))
    return unique_rows(d, [key])


def overlapping_terms(terms: DataFrame, start: str, end: str) -> DataFrame:
    """Terms of what was listed by the end of a sample and not delisted before its start."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return terms.where((F.col("list_date") <= b) & (F.col("delist_date").isNull() | (F.col("delist_date") >= a)))


def read_years(spark: SparkSession, path: str, date: str, start: str, end: str) -> DataFrame:
    """A year-partitioned table between two dates; only the years touched are opened."""
    d = spark.read.parquet(path).where(F.col("year").between(int(start[:4]), int(end[:4])))
    return d.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_on_schedule(spark: SparkSession, path: str, date: str, schedule: DataFrame, on: str = "signal_date") -> DataFrame:
    """The rows of a year-partitioned table on the dates of a schedule. The schedule's years reach the scan as a
    dynamic filter, so other years are not opened, without a job before. Years and dates, a row a day at most, are broadcast."""
    known = schedule.where(F.col(on) >= F.lit("0001-01-01").cast("date"))  # a comparison, as Spark makes no dynamic filter from a side that has none
    dates, years = known.select(F.col(on).alias(date)).distinct(), known.select(F.year(on).alias("year")).distinct()
    return spark.read.parquet(path).join(F.broadcast(years), "year", "left_semi").join(F.broadcast(dates), date, "left_semi")


def read_years_strict(spark: SparkSession, path: str, date: str, start: str, end: str, keys: list[str], flag: str | None = None) -> DataFrame:
    """As `read_years`; a year without rows, or a repeated key, is an error."""
    d = read_years(spark, path, date, start, end)
    have = {r["year"] for r in d.select("year").distinct().collect()}
    if missing := set(range(int(start[:4]), int(end[:4]) + 1)) - have:
        raise FileNotFoundError(f"years without data: {sorted(missing)}")
    assert_unique(d, keys)
    return d.where(flag) if flag else d


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None, optional: bool = False) -> DataFrame:
    """Parquet or CSV by suffix; an optional table that is absent is empty."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.option("header", True).csv(path) if path.lower().endswith(".csv") else reader.parquet(path)
    except AnalysisException as e:
        if optional and schema is not None and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_years(df: DataFrame, path: str, date: str) -> None:
    """One folder a year; rows of a year are gathered first, so files are few."""
    df.withColumn("year", F.year(date)).repartition("year", F.month(date)).write.mode("errorifexists").partitionBy("year").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Refuses to replace anything."""
    df.write.mode("errorifexists").parquet(path)


#: Tables of an evidence package.
RUN_TABLES = ("summary", "raw", "processed", "coverage", "ic", "quantiles", "nav", "stability")


def write_run(tables: dict[str, DataFrame], path: str, factor: str, run_id: str, group_id: str, required: tuple[str, ...] = RUN_TABLES) -> None:
    """An evidence package: each table with its factor and run, in a folder of the run. Nothing is
    written if a required table is missing."""
    if missing := sorted(set(required) - set(tables)):
        raise KeyError(f"a run without {missing}")
    for name, df in tables.items():
        write_new(df.withColumns({"factor": F.lit(factor), "run_id": F.lit(run_id), "comparison_group": F.lit(group_id)}), f"{path}/run_id={run_id}/{name}")


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """The one-row summaries of all runs; a run with no or several rows, or whose id is not
    its folder's, is an error when the rows are made."""
    folder = lambda c: F.regexp_extract(c, r"run_id=([^/]+)/", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    runs = files.select(folder("path").alias("_run")).distinct()
    d = spark.read.parquet(f"{path}/run_id=*/summary").withColumn("_folder", folder(F.input_file_name()))
    d = runs.join(d.withColumn("_n", F.count("*").over(Window.partitionBy("_folder"))), F.col("_run") == F.col("_folder"), "left")
    fault = F.when(F.col("_n").isNull(), "a run has no summary").when(F.col("_n") > 1, "a run has several summaries").when(F.col("run_id") != F.col("_folder"), "a run lies in another's folder")
    return d.withColumn("run_id", F.when(fault.isNull(), F.col("run_id")).otherwise(F.raise_error(fault).cast("string"))).drop("_folder", "_run", "_n")


def merge_events(existing: DataFrame, *batches: DataFrame, order: list[str] | None = None) -> DataFrame:
    """All distinct rows, by column name, in the order of the columns given, else of all."""
    out = existing
    for b in batches:
        out = out.unionByName(b)
    return out.dropDuplicates().orderBy(*(order or out.columns))
