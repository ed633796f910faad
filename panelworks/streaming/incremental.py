"""Incremental intake of event files with the exact-row rule of `merge_events`."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_rows(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct rows of a batch that are not among the known ones; null equals null."""
    row = F.struct(*batch.columns)
    have = known.select(F.xxhash64(F.struct(*batch.columns)).alias("_h"), F.struct(*batch.columns).alias("_known"))
    d = batch.dropDuplicates().withColumn("_h", F.xxhash64(row)).withColumn("_row", row)
    d = d.join(have, (d["_h"] == have["_h"]) & d["_row"].eqNullSafe(have["_known"]), "left_anti")
    return d.select(*batch.columns)


def append_to(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new, batch by batch, and ends when all files are in. Late events and rows that
    share a key are kept; only exact repeats go, also those of a batch that is run again."""

    def add(batch: DataFrame, _: int) -> None:
        try:
            known = batch.sparkSession.read.schema(batch.schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = batch.limit(0)
        new_rows(batch, known).write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
