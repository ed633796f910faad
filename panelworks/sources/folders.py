"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master, whose tasks run on the
    driver's machine, may go without: it gets a folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-panelworks-")
    return _own["dir"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is stored: bytes of a shuffle that Spark merges into one task, and the pieces that it merges from. By default it merges up to 64 MB, or
#: one task a core if that is less; rows that compress well are many times as large when they are sorted. Files are read in splits of a few MB, as a
#: task holds the rows of its split, uncompressed, until they are sorted for a shuffle of many pieces.
MERGED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024", "spark.sql.files.maxPartitionBytes": "16m"}


@contextmanager
def small_pieces(spark: SparkSession) -> Iterator[None]:
    """Statements run with the settings MERGED, so that tasks grow in number and not in size; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in MERGED}
    for k, v in MERGED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder, for plans that read them several times. Shuffles are merged into pieces of bounded
    size meanwhile (`small_pieces`)."""
    path = new_folder(df.sparkSession, name)
    with small_pieces(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
