"""Sharding over fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise, new_folder

#: Virtual slots; a constant of the data set, never changed after the first version.
SLOTS = 8192


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot): size is UTF-8 bytes plus `overhead`, a null text has
    none. The virtual slot hashes id, size and checksum, so null ids spread as well.
    Rows equal in all three share a slot."""
    d = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("b"))
    d = d.select("id", (F.length("b") + overhead).cast("long").alias("size"), F.crc32("b").alias("text_crc32"))
    return d.withColumn("vslot", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot: one row a slot, however large the data."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def assign_slots(totals: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """First map: the largest slots first, each into the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(totals, key=lambda x: (-x[1], x[0])):
        filled, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (filled + size, s))
    return out


def edit_map(old: dict[int, int], totals: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Next map for changed sizes or another number of shards: slots leave shards that
    are gone or over the mean, smallest slots last, and go to the lightest; the rest stay."""
    size = {slot: b for slot, b, _ in totals}
    mean = sum(size.values()) / shards
    load, out, moving = dict.fromkeys(range(shards), 0), {}, []
    for slot in sorted(size, key=lambda s: (size[s], s)):
        at = old.get(slot)
        if at is not None and at < shards and load[at] + size[slot] <= mean:
            out[slot] = at
            load[at] += size[slot]
        else:
            moving.append(slot)
    heap = [(b, s) for s, b in load.items()]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-size[s], s)):
        filled, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (filled + size[slot], s))
    return out


def map_rows(totals: list[tuple[int, int, int]], mapping: dict[int, int]) -> list[dict]:
    """Rows of a map: vslot, shard, the place `first` of the slot's first row in its shard, so that
    places are gapless, and the slot's bytes and rows. At most `SLOTS` of them."""
    at, rows = {}, []
    for slot, size, n in sorted(totals):
        s = mapping[slot]
        rows.append({"vslot": slot, "shard": s, "first": at.get(s, 0), "bytes": size, "n_rows": n})
        at[s] = at.get(s, 0) + n
    return rows


def write_map(spark: SparkSession, store: str, version: int, rows: list[dict]) -> None:
    """Adds a version to a stored map; versions are kept and never replaced."""
    kind = "array<struct<vslot int, shard int, first bigint, bytes bigint, n_rows bigint>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    table.coalesce(1).write.mode("errorifexists").parquet(f"{store}/version={version}")


def read_map(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """(version, vslot, shard, first, bytes, n_rows) of one version, by default the last."""
    d = spark.read.parquet(store)
    return d.where(F.col("version") == (d.agg(F.max("version")).first()[0] if version is None else version))


def _placed(rows: DataFrame, mapping: DataFrame, id_col: str) -> DataFrame:
    """Rows of `slotted` by a map of the same rows."""
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "size", "text_crc32")) - 1
    placed = rows.withColumn("n", place).join(F.broadcast(mapping.select("version", "vslot", "shard", "first")), "vslot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("n")).alias("place"), "version")


def _totals(rows: DataFrame) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in slot_totals(rows).select("vslot", "bytes", "n_rows").collect()]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Each row with its shard, under the law `bytes`: sizes of shards are near equal,
    as thousands of slots are dealt by their bytes. Returns `id_col`, size, text_crc32,
    vslot, shard int, place long (gapless from 0 in a shard, ordered by slot, id, size
    and checksum) and version, which is 1. The map is stored in the folder `store`, one of
    its own if None; `rebalance` edits it there.

    The rows are shuffled once, without their texts, by virtual slot; the driver sees
    `slots` totals at most, and the map is stored before it is used. Null ids and
    texts, empty tables and repeated rows are ordinary; ties of equal rows are
    interchangeable. Other columns are not read.
    """
    spark = docs.sparkSession
    store = store or new_folder(spark, "slot-map")
    rows = materialise(slotted(docs, id_col, text_col, slots=slots), "slotted")
    totals = _totals(rows)
    write_map(spark, store, 1, map_rows(totals, assign_slots(totals, shards)))
    return _placed(rows, read_map(spark, store, 1), id_col)


def rebalance(docs: DataFrame, store: str, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """As `shard`, for changed documents or another number of shards, by editing the last stored map
    into the next version: slots move only from shards that are gone or over the mean, all others stay
    where they are. `slots` must be that of the first version."""
    spark = docs.sparkSession
    last = [(r["version"], r["vslot"], r["shard"]) for r in read_map(spark, store).select("version", "vslot", "shard").collect()]
    version = max((v for v, _, _ in last), default=0) + 1
    rows = materialise(slotted(docs, id_col, text_col, slots=slots), "slotted")
    totals = _totals(rows)
    write_map(spark, store, version, map_rows(totals, edit_map({s: at for _, s, at in last}, totals, shards)))
    return _placed(rows, read_map(spark, store, version), id_col)


def moves(spark: SparkSession, store: str, before: int, after: int) -> DataFrame:
    """(vslot, from_shard, to_shard, bytes, n_rows) of the slots that a version moved."""
    a = read_map(spark, store, before).select("vslot", F.col("shard").alias("from_shard"))
    b = read_map(spark, store, after).select("vslot", F.col("shard").alias("to_shard"), "bytes", "n_rows")
    return a.join(b, "vslot").where("from_shard <> to_shard").select("vslot", "from_shard", "to_shard", "bytes", "n_rows")
