"""Centroid clustering of integer vectors with a LAESA pivot table.

Distances from every vector to a few fixed pivots are stored once, beside the vector. In each
round the driver measures the centroids against the pivots; by the triangle inequality the
difference of two pivot distances is a lower bound of the distance between vector and
centroid. A vector takes its centroids in the order of their bounds, measures them exactly in whole
numbers, and stops where the next bound is over the best distance. Only per-task sums of
clusters leave a round's tasks, and only clusters times components reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialise

PIVOTS = 12
#: Rows that are assigned together.
BLOCK = 4096
_MOST = (1 << 63) - 1


def largest_component(dims: int) -> int:
    """Components beyond this are cut to it, so that squared distances fit 64 bits."""
    return int((2**62 / dims) ** 0.5) // 2


def integer_rows(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, floor(scale * x) as int64) of the vectors with `dims` finite components."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dims)
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(x).all(1)
    most = largest_component(dims)
    with np.errstate(over="ignore"):
        return at[fine], np.clip(np.floor(scale * x[fine]), -most, most).astype(np.int64)


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each row of v to each pivot."""
    return np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in pivots], 1).astype(float)) if len(pivots) else np.zeros((len(v), 0))


def choose_pivots(candidates: np.ndarray, count: int) -> np.ndarray:
    """From a few candidates, each time the one with the largest sum of distances to those chosen."""
    chosen, total = [], np.zeros(len(candidates))
    for _ in range(min(count, len(candidates))):
        best = int(np.argmax(np.where(np.isin(np.arange(len(candidates)), chosen), -1.0, total)))
        chosen.append(best)
        total += pivot_distances(candidates, candidates[best : best + 1])[:, 0]
    return candidates[chosen]


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances made) of each row: the nearest centroid, of equal ones the
    first. Bounds are lowered by more than their rounding error."""
    bound = np.zeros((len(v), len(centroids)))
    for k in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, k, None] - centroid_pivots[None, :, k]), out=bound)
    bound = np.maximum(0.0, bound * (1 - 1e-12) - 1e-5)
    order = np.argsort(bound, axis=1, kind="stable")
    low = np.take_along_axis(bound, order, 1) ** 2
    cluster, best, made = np.zeros(len(v), np.int64), np.full(len(v), _MOST), 0
    active = np.arange(len(v))
    for k in range(len(centroids)):
        active = active[low[active, k] <= best[active]]  # bounds rise, so a row that stops is done
        if len(active) == 0:
            break
        c = order[active, k]
        gap = v[active] - centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        made += len(active)
        better = (d < best[active]) | ((d == best[active]) & (c < cluster[active]))
        cluster[active[better]], best[active[better]] = c[better], d[better]
    return cluster, best, made


class Clustering(NamedTuple):
    #: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.
    rows: DataFrame
    #: Final centroids, in order.
    centroids: np.ndarray
    #: Exact distances of all rounds, and what a full comparison would have made.
    exact: int
    full: int


def _assigned(batch: pa.RecordBatch, dims: int, pivots: int, centroids: np.ndarray, centroid_pivots: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(from row, to row, vectors, cluster, distance, exact distances) of blocks of stored rows."""
    for i in range(0, len(batch), BLOCK):
        part = batch.slice(i, BLOCK)
        v = np.frombuffer(b"".join(part["v"].to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
        d = np.frombuffer(b"".join(part["d"].to_pylist()), "<f8").reshape(-1, pivots)
        yield i, i + len(part), v, *nearest(v, d, centroids, centroid_pivots)


def _sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def centroid_clustering(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Clusters the vectors with exactly `dims` components, none null or non-finite, as integers
    floor(scale * x); others have no row.

    The first centroids are the k kept vectors whose SHA-256 of `seed:id` is smallest. A round gives every vector to
    its nearest centroid by squared distance, of equal ones the smaller number, and moves each
    centroid with vectors to floor(sum / count) of theirs. After the last round vectors are assigned
    once more. With fewer than k vectors there are as many centroids as vectors; an empty
    table gives no rows. Repeated rows and vectors count each time; a null id draws as an empty id and keeps
    its row; components are cut to +-`largest_component(dims)` (2**27 for 64), so that distances fit.
    Other columns are not read. k * dims numbers a round reach the driver, no vectors but the k first ones.
    """
    spark = vectors.sparkSession
    d = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = d.schema["id"]
    kept = T.StructType([kind, T.StructField("v", T.BinaryType())])

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = integer_rows(batch["vector"], dims, scale)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at)), pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary())], names=["id", "v"])

    whole = d.mapInArrow(integers, kept)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = whole.select(mark.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64).reshape(-1, dims)
    fixed = choose_pivots(centroids, pivots)
    count = len(fixed)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch["v"].to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array([x.tobytes() for x in pivot_distances(v, fixed)], pa.binary())], names=["id", "v", "d"])

    table = materialise(whole.mapInArrow(measured, T.StructType([*kept.fields, T.StructField("d", T.BinaryType())])), "pivot-table")
    exact = full = 0
    for _ in range(rounds if len(centroids) else 0):
        known = pivot_distances(centroids, fixed)

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids, known: np.ndarray = known) -> Iterator[pa.RecordBatch]:
            total, n, made = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64), 0
            for batch in batches:
                for _, _, v, cluster, _, m in _assigned(batch, dims, count, now, known):
                    order = np.argsort(cluster, kind="stable")
                    has, at = np.unique(cluster[order], return_index=True)
                    total[has] += np.add.reduceat(v[order], at, axis=0)
                    n += np.bincount(cluster, minlength=len(now))
                    made += m
            at = np.flatnonzero(n)
            work = np.zeros(len(at), np.int64)
            work[:1] = made
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(work), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "n", "made", "total"])

        parts = table.mapInArrow(sums, "cluster long, n long, made long, total array<long>")
        parts = parts.select("cluster", "n", "made", F.posexplode("total").alias("at", "x"))
        moved = centroids.copy()
        for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"), F.sum("made").alias("made")).collect():
            moved[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
            if r["at"] == 0:
                exact, full = exact + r["made"], full + r["n"] * len(centroids)
        centroids = moved

    known, fields = pivot_distances(centroids, fixed), T.StructType([kind, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, cluster, distance, _ in _assigned(batch, dims, count, centroids, known):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=fields.names)

    rows = materialise(table.mapInArrow(final, fields), "clusters")
    discard(table)
    sums_of = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    inertia = min(_MOST, sum(int(r["s"]) for r in sums_of))
    about = [(r["cluster"], min(_MOST, int(r["s"])), inertia, _sha256(centroids[r["cluster"]])) for r in sums_of]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(about), "cluster")
    return Clustering(out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids, exact, full)
