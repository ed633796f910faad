"""Near copies among embeddings: sign hashing, exact cosines, connected components.

Equal vectors of a label are one class from the start. A class goes into one bucket of each table, by
the signs of its vector against random hyperplanes, as a row with its number and a sketch, the signs of
all tables, never the vector. Pairs that meet in a bucket and whose sketches are near enough are
candidates. The sketches also say in which tables two classes meet, so a pair is taken in the first of them alone: no
pair is made twice, and none needs to be told from others. The vectors of a candidate are fetched by number, and its cosine is computed in
double precision. A pair at the threshold is missed with probability `miss` by the tables and
SKETCH_MISS by the sketches; any closer pair with less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialise
from .textkernel import U64, mix

THRESHOLD = 0.98
#: A pair at the threshold stays unseen by all tables with at most this probability.
MISS = 1e-6
#: Signs of a sketch at least, and the probability that a pair at the threshold differs in more than is let pass.
SKETCH, SKETCH_MISS = 128, 1e-9
#: Unrelated classes of its label that a class meets in a bucket, about.
LOAD = 16
#: Larger buckets are compared as pairs of blocks in separate tasks.
BLOCK = 512


def table_shape(vectors: int, labels: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits so that a bucket of a label holds about LOAD unrelated vectors,
    tables so that a pair at the threshold meets in one with probability 1 - miss."""
    bits = min(40, max(4, math.ceil(math.log2(max(2, vectors / max(1, labels) / LOAD)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def sketch_limit(signs: int = SKETCH, threshold: float = THRESHOLD, miss: float = SKETCH_MISS) -> int:
    """The fewest signs so that a pair at the threshold differs in more with probability `miss` at most."""
    p, at_most = math.acos(threshold) / math.pi, 0.0
    for k in range(signs + 1):
        at_most += math.comb(signs, k) * p**k * (1 - p) ** (signs - k)
        if 1 - at_most <= miss:
            return k
    return signs


def sketch_words(bits: int, tables: int) -> int:
    """Longs of a sketch: the signs of all tables, and more up to SKETCH."""
    return -(-max(SKETCH, bits * tables) // 64)


def planes(dim: int, count: int) -> np.ndarray:
    """Normal vectors of random hyperplanes, the same in every task."""
    return np.random.RandomState(20_210_527).standard_normal((dim, count))


def _usable(vec: Column) -> Column:
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) for each length of vectors."""
    length = np.array(col.value_lengths(), np.int64)
    flat, first = np.asarray(col.flatten(), np.float64), np.cumsum(length) - length
    for dim in np.unique(length):
        at = np.flatnonzero(length == dim)
        yield at, flat[first[at][:, None] + np.arange(dim)]


def _sign_rows(bits: int, tables: int):
    """Rows (cls, label, vec) to (bucket, cls, no, s0, s1, ...), one for each table `no`."""
    words = sketch_words(bits, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, label = (batch[x].to_numpy() for x in ("cls", "label"))
            for at, m in _matrices(batch["vec"]):
                sign = m / np.abs(m).max(1, keepdims=True) @ planes(m.shape[1], 64 * words) > 0
                code = sign[:, : bits * tables].reshape(len(at), tables, bits) @ (U64(1) << np.arange(bits, dtype=U64))
                place = mix(label[at].view(U64) ^ mix(np.array([m.shape[1]], U64)))[:, None] + np.arange(tables, dtype=U64)
                bucket = mix(mix(place) ^ code)
                sketch = np.packbits(sign, axis=1).view(np.int64)
                cols = [bucket.view(np.int64).ravel(), np.repeat(cls[at], tables), np.tile(np.arange(tables, dtype=np.int16), len(at)), *(np.repeat(sketch[:, k], tables) for k in range(words))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "cls", "no", *(f"s{k}" for k in range(words))])

    return run


def first_meeting(apart: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The first table in which two classes have the same signs, from the exclusive-or of their sketches, a row a pair."""
    differs = np.unpackbits(np.ascontiguousarray(apart).view(np.uint8), axis=1, count=bits * tables)
    return differs.reshape(-1, tables, bits).any(2).argmin(1)


def _candidates(limit: int, bits: int, tables: int):
    """Rows sorted by tile to pairs (a, b), a < b, whose sketches differ in `limit` signs at most and that
    meet in no earlier table."""
    words = sketch_words(bits, tables)

    def pairs(t: pa.Table) -> pa.RecordBatch:
        c = {k: t[k].to_numpy() for k in ("tile", "cls", "chunk", "no")} | {"inner": t["inner"].to_numpy(zero_copy_only=False)}
        sketch = np.column_stack([t[f"s{k}"].to_numpy() for k in range(words)]).view(U64)  # bits of negative longs are not those of their size
        i, found = np.arange(len(t)), []
        for d in range(1, len(t)):
            i = i[i + d < len(t)]
            i = i[c["tile"][i] == c["tile"][i + d]]
            if not len(i):
                break
            j = i + d
            apart = sketch[i] ^ sketch[j]
            on = (np.bitwise_count(apart).sum(1) <= limit) & (c["inner"][i] | (c["chunk"][i] != c["chunk"][j]))
            x, y, apart = i[on], j[on], apart[on]
            new = first_meeting(apart, bits, tables) == c["no"][x]
            found.append((c["cls"][x[new]], c["cls"][y[new]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            keys = kept["tile"].to_numpy()
            end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last tile may go on
            if end:
                yield pairs(kept.slice(0, end))
                kept = kept.slice(end)
        if kept is not None and len(kept):
            yield pairs(kept)

    return run


def _verify(threshold: float):
    """Rows (a, b, va, vb) to those whose cosine reaches the threshold."""

    def unit(m: np.ndarray) -> np.ndarray:
        m = m / np.abs(m).max(1, keepdims=True)
        return m / np.sqrt((m * m).sum(1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.zeros(len(batch), bool)
            for (at, x), (_, y) in zip(_matrices(batch["va"]), _matrices(batch["vb"]), strict=True):
                on[at] = np.einsum("ij,ij->i", unit(x), unit(y)) >= threshold
            keep = pa.array(np.flatnonzero(on))
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])

    return run


def embedding_links(classes: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(a, b): pairs a < b of classes (cls, label long, vec) of equal labels and lengths that link."""
    total, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    bits, tables = table_shape(total, labels, threshold, miss)
    signs = [f"s{k}" for k in range(sketch_words(bits, tables))]
    rows = classes.select("cls", "label", "vec").mapInArrow(_sign_rows(bits, tables), "bucket long, cls long, no short, " + ", ".join(f"{s} long" for s in signs))
    rows = materialise(rows, "signatures")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    sizes = materialise(sizes, "large-buckets")
    met = rows.join(sizes, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other"))
    met = met.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(block).alias("tile"), "cls", "chunk", (F.col("chunk") == F.col("other")).alias("inner"), "no", *signs)
    limit = sketch_limit(64 * len(signs), threshold)
    pairs = met.repartition("tile").sortWithinPartitions("tile", "cls").mapInArrow(_candidates(limit, bits, tables), "a long, b long")
    pairs = materialise(pairs, "candidates")
    discard(rows, sizes)
    held = lambda x: classes.select(F.col("cls").alias(x), F.col("vec").alias(f"v{x}"), F.col("label").alias(f"l{x}"))
    full = pairs.join(held("b"), "b").join(held("a"), "a").where("la = lb and size(va) = size(vb)")
    out = materialise(full.select("a", "b", "va", "vb").mapInArrow(_verify(threshold), "a long, b long"), "embedding-links")
    discard(pairs)
    return out


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """A row for each vector: `id_col`, n_links, component_id, kept.

    Vectors with equal labels and lengths link at a cosine of `threshold` or more, in
    double precision. Vectors that are null, empty, zero or hold null or non-finite
    components, and those with a null label, link with nothing. Equal vectors are one
    class from the start, so a vector that a third of all rows share costs one row; classes are told
    apart by 128 bits and numbered when stored. A bucket over BLOCK classes is cut into blocks whose
    pairs go to separate tasks. Repeated rows count as vectors of their own. A null
    id is a row like others, with itself as a component. Other columns are not read.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    if v.schema["vec"].dataType.elementType.typeName() not in ("float", "double"):
        v = v.withColumn("vec", F.col("vec").cast("array<double>"))
    good = _usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    digest = lambda k: F.when(good, F.xxhash64(F.lit(k), "label", "vec"))
    v = v.withColumn("ha", digest(1)).withColumn("hb", digest(2))
    classes = v.where("ha is not null").groupBy("ha", "hb").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first(F.xxhash64("label")).alias("label"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links = embedding_links(classes, threshold, miss)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("links"))
    comp = connected_components(links, "a", "b")
    per_class = classes.select("cls", "ha", "hb", "least", "n").join(counts.withColumnRenamed("a", "cls"), "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    per_class = materialise(per_class.select("ha", "hb", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component")), "linked")
    least = materialise(per_class.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    discard(classes, links)
    per_class = per_class.join(least, "component").select("ha", "hb", "n_links", "component_id")
    res = v.select("id", "ha", "hb").join(per_class, ["ha", "hb"], "left")
    res = res.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return res.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
