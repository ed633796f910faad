"""An event table that keeps each distinct row once, with the version that brought it.

Rows are filed by ranges of their hash. A batch reads only the ranges that its own rows fall into, so what
is read grows with the batch as long as it is small against the table, and new rows are added as new files: nothing is written twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from .folders import stored

#: Ranges of the row hash; the first bits name the range.
RANGE_BITS = 6
_OWN = ("_hash", "_version", "_range")


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    h = F.xxhash64(*(F.struct(F.col(c)) for c in columns))
    return df.select(*columns, h.alias("_hash")).withColumn("_range", F.shiftrightunsigned("_hash", 64 - RANGE_BITS).cast("int"))


def _stored_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The log's files with its own columns; None before the first batch."""
    own = T.StructType([*schema.fields, T.StructField("_hash", T.LongType()), T.StructField("_version", T.LongType()), T.StructField("_range", T.IntegerType())])
    try:
        return spark.read.schema(own).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def known_in_ranges(spark: SparkSession, path: str, schema: T.StructType, ranges: list[int]) -> DataFrame | None:
    """Stored rows of some ranges: the others' folders are pruned."""
    log = _stored_log(spark, path, schema)
    return None if log is None else log.where(F.col("_range").isin(ranges))


def add_events(batch: DataFrame, path: str, version: int) -> None:
    """Adds the distinct rows of a batch that the log has not; columns go by name, null equals null. A batch
    that is run again adds nothing. Versions are whole numbers that rise."""
    spark, columns = batch.sparkSession, batch.columns
    rows = stored(_hashed(batch.dropDuplicates(), sorted(columns)).select(*columns, "_hash", "_range"), "event-batch")
    ranges = [r["_range"] for r in rows.select("_range").distinct().collect()]  # 2**RANGE_BITS at most
    known = known_in_ranges(spark, path, batch.schema, ranges)
    if known is not None:
        have = known.select("_range", "_hash", F.struct(*columns).alias("_known"))
        rows = rows.withColumn("_row", F.struct(*columns))
        same = (rows["_range"] == have["_range"]) & (rows["_hash"] == have["_hash"]) & rows["_row"].eqNullSafe(have["_known"])
        rows = rows.join(have, same, "left_anti").drop("_row")
    rows.withColumn("_version", F.lit(version).cast("long")).repartition("_range").write.mode("append").partitionBy("_range").parquet(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The log's rows, those of versions up to one if it is given; no rows before the first batch."""
    log = _stored_log(spark, path, schema)
    if log is None:
        return spark.createDataFrame([], schema)
    return (log if version is None else log.where(F.col("_version") <= version)).drop(*_OWN)


def stream_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the files of a stream batch by batch, each as a version, and ends when all are in."""
    return events.writeStream.foreachBatch(lambda batch, n: add_events(batch, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
