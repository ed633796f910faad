"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_folder, shared_dir

#: Spark then deletes the shuffle files of a statement when the statement ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="spark-panelworks-")) / "panelworks.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "panelworks").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The application's database of intermediate tables; its folder is in the shared one, so
    that dropping a table deletes its files."""
    name = "scratch_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId.lower())
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Statements inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, buckets: tuple[int, str] | None = None, part: str | None = None, **options: object) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back, which cuts the
    lineage and survives lost executors. With `buckets`, a number and a column, rows are
    filed by the column's hash, and joins on it need not move them; with `part`, a column, rows
    of each value are apart and can be deleted alone. `options` are the writer's."""
    spark = df.sparkSession
    table = f"{scratch(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").options(**options)
    if buckets:
        writer = writer.bucketBy(*buckets).sortBy(buckets[1])
    if part:
        writer = writer.partitionBy(part)
    with shuffles_deleted(spark):
        writer.saveAsTable(table)
    out = spark.table(table)
    out._scratch_table = table
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialise` that nothing reads any more."""
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._scratch_table}")


def discard_part(table: DataFrame, part: str, value: str) -> None:
    """Deletes the rows of one value of a table that `materialise` wrote in parts."""
    table.sparkSession.sql(f"ALTER TABLE {table._scratch_table} DROP IF EXISTS PARTITION ({part} = '{value}')")


def kept_tables(spark: SparkSession) -> set[str]:
    """Names of the intermediate tables that exist now."""
    db = scratch(spark)
    return {f"{db}.{t.name}" for t in spark.catalog.listTables(db)}


def discard_since(spark: SparkSession, before: set[str], *still_read: DataFrame) -> None:
    """Deletes the tables made since `before` was taken, but for those still read."""
    for name in kept_tables(spark) - before - {t._scratch_table for t in still_read}:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def release(spark: SparkSession) -> None:
    """Drops all intermediate tables of the application, also those that results still read: for the end of a session."""
    spark.sql(f"DROP DATABASE IF EXISTS {scratch(spark)} CASCADE")


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows by the hash of the key. A cut of the hash comes first, so that
    all tasks together send about that many, however many tasks there are."""
    n, share = rows.count(), 1 << 30
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(share)) < int(1.05 * share * most / n) + 1)
    return rows.orderBy(F.xxhash64(key), key).limit(most)
