"""Readers and writers over the test tables: what is written is read back and compared."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import run_identity
from ..sources import event_log
from ..sources import tables as S
from ..sources.folders import new_folder
from .panels import BARS, SIGNALS, read, register, rounded, signals, tidy

QUERIES: dict = {}
query = partial(register, QUERIES)



def order_day() -> Column:
    return F.col("o_orderdate").cast("date")


def customer() -> Column:
    return F.col("o_custkey")


def raw_csv(spark: SparkSession, sf: str) -> str:
    """A CSV of orders whose codes, dates and numbers are spelled in several ways."""
    path = new_folder(spark, "orders-csv")
    code = F.when(customer() % 11 > 0, F.concat(F.when(customer() % 5 == 0, "﻿").otherwise(" "), customer().cast("string"), F.lit(" ")))
    date = F.when(customer() % 3 == 0, F.date_format(order_day(), "yyyyMMdd")).when(customer() % 3 == 1, F.date_format(order_day(), "yyyyMMdd'.0'")).otherwise(F.date_format(order_day(), "yyyy-MM-dd"))
    price = F.when(customer() % 7 > 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    read(spark, sf, "orders").select("o_orderkey", code.alias("code"), date.alias("day"), price.alias("price")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return S.daily_bars(S.read_csv(spark, raw_csv(spark, sf), ["code", "day", "price"]), "code", "day", ["price"])


CSV_SQL = "cs AS (SELECT CAST(o_custkey AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS trade_date, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice END AS price FROM orders WHERE o_custkey % 11 > 0)"


@query("csv_daily", f"WITH {CSV_SQL} SELECT code, trade_date, round(price, 6) AS price FROM cs")
def csv_daily(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(bars(spark, sf))


@query("csv_history", f"WITH {CSV_SQL} SELECT code, trade_date, round(price, 6) AS price FROM cs WHERE trade_date BETWEEN DATE '1994-03-01' AND DATE '1996-08-31' AND code IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')")
def csv_history(spark: SparkSession, sf: str) -> DataFrame:
    codes = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("code"))
    return tidy(S.history(bars(spark, sf), codes, "code", "1994-03-01", "1996-08-31"))


@query("open_calendar", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F' UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 45)
SELECT d AS trade_date, row_number() OVER (ORDER BY d) - 1 AS cal_idx FROM d WHERE d IS NOT NULL""")
def open_calendar(spark: SparkSession, sf: str) -> DataFrame:
    source = read(spark, sf, "orders").select(order_day().alias("trade_date"), (F.col("o_orderstatus") == "F").cast("int").alias("is_open"))
    return tidy(S.open_calendar(source, read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_shipdate").alias("trade_date"))))


@query("reference_universe", """SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS list_date, round(o_totalprice, 6) AS size, o_orderpriority AS kind FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_totalprice) = 1""")
def reference_universe(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    terms = o.select(customer().alias("code"), order_day().alias("list_date"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("kind"))
    return tidy(S.reference_universe(terms, o.where("o_orderstatus = 'F'").select(customer().alias("code")), "code", "kind", "1-URGENT", "list_date", "size"), "code", "list_date", "size", "kind")


@query("renamed_history", "SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS trade_date, round(o_totalprice, 6) AS close FROM orders WHERE o_custkey % 4 = 1 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def renamed_history(spark: SparkSession, sf: str) -> DataFrame:
    codes = read(spark, sf, "customer").where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("code"))
    names = {"o_custkey": "code", "o_orderdate": "trade_date", "o_totalprice": "close"}
    return tidy(S.renamed_history(read(spark, sf, "orders"), names, codes, "code", "1995-01-01", "1996-06-30"))


@query("market_values", "SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS trade_date, round(o_totalprice, 6) AS market_cap FROM orders WHERE o_custkey % 4 = 2 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def market_values(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("text_day", F.date_format(order_day(), "yyyyMMdd"))
    codes = read(spark, sf, "customer").where("c_custkey % 4 = 2").select(F.col("c_custkey").alias("code"))
    return tidy(S.renamed_history(o, {"o_custkey": "code", "text_day": "trade_date", "o_totalprice": "market_cap"}, codes, "code", "1996-01-01", "1996-12-31"))


@query("membership_panel", """SELECT CAST(o_orderdate AS DATE) AS trade_date, c_mktsegment AS industry, o_custkey AS member FROM (SELECT DISTINCT o_orderdate, c_mktsegment, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey)
WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 49)""")
def membership_panel(spark: SparkSession, sf: str) -> DataFrame:
    named = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == customer())
    snapshots = named.groupBy(order_day().alias("trade_date"), F.col("c_mktsegment").alias("industry")).agg(F.collect_set("o_custkey").alias("constituents"))  # a day's members at most
    dates = read(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_shipdate").cast("date").alias("trade_date"))
    return S.members(snapshots, "trade_date", "industry", "constituents", dates)


@query("ordinary_codes", "SELECT DISTINCT o_custkey AS code FROM orders WHERE o_orderpriority = '2-HIGH'")
def ordinary_codes(spark: SparkSession, sf: str) -> DataFrame:
    return S.ordinary_codes(read(spark, sf, "orders").select(customer().alias("code"), F.col("o_orderpriority").alias("kind")), "code", "kind", "2-HIGH")


@query("lifecycle_terms", """WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS code, DATE '1994-01-01' + CAST(c_custkey % 900 AS INT) AS list_date, CASE WHEN c_custkey % 3 = 0 THEN DATE '1995-06-01' + CAST(c_custkey % 700 AS INT) END AS delist_date, DATE '2000-01-01' + CAST(c_custkey % 500 AS INT) AS maturity_date,
  CASE WHEN c_custkey % 5 > 0 THEN CAST(100 + c_custkey % 9 AS DOUBLE) END AS maturity_call_price FROM customer)
SELECT *, CAST(NULL AS DATE) AS maturity_payment_date FROM t WHERE list_date <= DATE '1996-03-31' AND (delist_date IS NULL OR delist_date >= DATE '1996-01-01')""")
def lifecycle_terms(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    day = lambda start, n: F.date_format(F.date_add(F.to_date(F.lit(start)), (k % n).cast("int")), "yyyyMMdd")
    raw = read(spark, sf, "customer").select(F.concat(F.lit(" "), k.cast("string")).alias("code"), day("1994-01-01", 900).alias("list_date"), F.when(k % 3 == 0, day("1995-06-01", 700)).alias("delist_date"), day("2000-01-01", 500).alias("maturity_date"), F.when(k % 5 > 0, (100 + k % 9).cast("string")).otherwise("-").alias("maturity_call_price"))
    return tidy(S.overlapping_terms(S.lifecycle_terms(raw, "code"), "1996-01-01", "1996-03-31"))


@query("redemption_events", """SELECT c_custkey AS code, DATE '1997-01-01' + CAST(c_custkey % 400 AS INT) AS effective_date, CASE WHEN c_custkey % 2 = 0 THEN 'called' ELSE 'near' END AS event_status, CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-03-01' + CAST(c_custkey % 40 AS INT) END AS call_reg_date,
  CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-05-01' + CAST(c_custkey % 40 AS INT) END AS payment_date, CASE WHEN c_custkey % 3 > 0 THEN 101.5 WHEN c_custkey % 5 > 0 THEN 100.25 END::DOUBLE AS call_price, CAST(NULL AS DATE) AS last_trade_date FROM customer WHERE c_custkey % 13 > 0""")
def redemption_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    day = lambda start, n: F.date_add(F.to_date(F.lit(start)), (k % n).cast("int")).cast("string")
    called = k % 2 == 0
    raw = read(spark, sf, "customer").select(k.alias("bond"), F.when(k % 13 > 0, day("1997-01-01", 400)).alias("announced"), F.when(called, "called").otherwise("near").alias("status"), F.when(called, day("1998-03-01", 40)).alias("registered"), F.when(called, day("1998-05-01", 40)).alias("paid"), F.when(k % 3 > 0, "101.5").alias("price"), F.when(k % 5 > 0, "100.25").otherwise("none").alias("taxed"))
    names = {"bond": "code", "announced": "effective_date", "status": "event_status", "registered": "call_reg_date", "paid": "payment_date", "price": "call_price", "taxed": "call_price_tax"}
    return tidy(S.redemption_events(raw, "code", names))


def yearly(spark: SparkSession, sf: str) -> str:
    path = new_folder(spark, "orders-by-year")
    S.write_years(read(spark, sf, "orders").select("o_orderkey", customer().alias("code"), order_day().alias("day"), (F.col("o_orderstatus") == "F").alias("is_eligible")), path, "day")
    return path


@query("year_partitions", "SELECT o_orderkey, o_custkey AS code, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-05-10' AND DATE '1996-02-20'")
def year_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(S.read_years(spark, yearly(spark, sf), "day", "1994-05-10", "1996-02-20").drop("is_eligible"))


@query("year_partitions_strict", "SELECT o_orderkey, o_custkey AS code, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-05-10' AND DATE '1996-02-20' AND o_orderstatus = 'F'")
def year_partitions_strict(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(S.read_years_strict(spark, yearly(spark, sf), "day", "1995-05-10", "1996-02-20", ["o_orderkey"], "is_eligible").drop("is_eligible"))


@query("format_dispatch", "SELECT 'parquet' AS kind, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation UNION ALL SELECT 'csv', r_regionkey, r_name FROM region")
def format_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "formats")
    S.write_new(read(spark, sf, "nation").select("n_nationkey", "n_name"), f"{path}/nation.parquet")
    read(spark, sf, "region").select("r_regionkey", "r_name").write.option("header", True).csv(f"{path}/region.csv")
    a = S.read_any(spark, f"{path}/nation.parquet").select(F.lit("parquet").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = S.read_any(spark, f"{path}/region.csv").select(F.lit("csv").alias("kind"), F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    return a.unionByName(b).unionByName(S.read_any(spark, f"{path}/absent.parquet", a.schema, optional=True))


@query("run_index", "SELECT p AS priority, count(*) AS n_rows, round(avg(x), 6) AS mean_price, 'price' AS factor, true AS in_group FROM (SELECT o_orderpriority AS p, o_totalprice AS x FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) GROUP BY 1")
def run_index(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence packages of three runs, written and indexed."""
    path, group = new_folder(spark, "runs"), ""
    for p in ("1-URGENT", "2-HIGH", "5-LOW"):
        rows = read(spark, sf, "orders").where(F.col("o_orderpriority") == p).select(F.col("o_orderpriority").alias("priority"), "o_totalprice")
        run, group = run_identity("price", {"priority": p}, {"table": "orders"})
        summary = rows.groupBy("priority").agg(F.count("*").alias("n_rows"), F.avg("o_totalprice").alias("mean_price"))
        S.write_run({"summary": summary, "raw": rows}, path, "price", run, group, required=("summary", "raw"))
    d = S.run_index(spark, path)
    return d.select("priority", "n_rows", rounded("mean_price").alias("mean_price"), "factor", (F.col("comparison_group") == group).alias("in_group"))


@query("merged_events", """SELECT event_id % 1000 AS k, event_type, count(*) AS n FROM (SELECT DISTINCT event_id % 1000 AS event_id, event_type FROM events) GROUP BY ALL""")
def merged_events(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "events").select((F.col("event_id") % 1000).alias("k"), "event_type")
    merged = S.merge_events(d.where("k < 400"), d.where("k >= 300 and k < 800"), d.where("k >= 700"), order=["k", "event_type"])
    return merged.groupBy("k", "event_type").agg(F.count("*").alias("n"))


@query("event_log", """SELECT event_id % 1000 AS k, event_type, min(CASE WHEN event_id % 1000 < 400 THEN 0 WHEN event_id % 1000 < 800 THEN 1 ELSE 2 END) AS version, 1 AS n FROM events GROUP BY ALL""")
def merged_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three overlapping batches into a log; the version of a row is that of the first batch that had it."""
    d = read(spark, sf, "events").select((F.col("event_id") % 1000).alias("k"), "event_type")
    path, out = new_folder(spark, "event-log"), None
    for version, rows in enumerate(("k < 400", "k >= 300 and k < 800", "k >= 100")):
        event_log.add_events(d.where(rows), path, version)
    for version in range(3):
        seen = event_log.read_events(spark, path, d.schema, version).groupBy("k", "event_type").agg(F.count("*").alias("n")).withColumn("version", F.lit(version))
        out = seen if out is None else out.unionByName(seen)
    return tidy(out.groupBy("k", "event_type").agg(F.min("version").alias("version"), F.max("n").alias("n")))


@query("schedule_panel", f"""WITH {BARS}, {SIGNALS} SELECT o_orderkey, o_custkey AS code, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS BIGINT) AS year
FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT signal_date FROM signals WHERE signal_date BETWEEN DATE '1996-03-01' AND DATE '1997-10-31')""")
def schedule_panel(spark: SparkSession, sf: str) -> DataFrame:
    wanted = signals(spark, sf).where("signal_date between '1996-03-01' and '1997-10-31'")
    return tidy(S.read_on_schedule(spark, yearly(spark, sf), "day", wanted).drop("is_eligible"), "o_orderkey", "code", "day", "year")
