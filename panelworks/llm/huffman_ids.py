"""Token ids as canonical, length-limited Huffman code in independent blocks."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialise
from .tokenization import encode_with_end

MAX_BITS = 16
#: Tokens between two bit offsets, and tokens of a block (a longer document has its own).
STEP, BLOCK_TOKENS = 256, 1 << 19
MAGIC = b"CHID"
HEAD = struct.Struct("<4sHHIIQ")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each id, 0 for ids without a count. Package-merge, so no code of at most
    `limit` bits is shorter in total. More ids than 2**limit have no such code, which raises."""
    ids = np.flatnonzero(counts)
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids cannot have codes of {limit} bits")
    out = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        out[ids] = 1
        return out
    order = ids[np.lexsort((ids, counts[ids]))]
    weights = counts[order].astype(np.int64)
    n, chosen, level = len(order), [], weights
    marks = [np.arange(n)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        marks.append(np.where(at < n, at, -1))
    take = 2 * n - 2
    for m in reversed(marks):
        used = m[:take]
        leaves = used[used >= 0]
        chosen.append(leaves)
        take = 2 * int((used < 0).sum())
    out[order] = np.bincount(np.concatenate(chosen), minlength=n).astype(np.uint8)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        step = np.left_shift(np.int64(1), MAX_BITS - lengths[order].astype(np.int64))
        codes[order] = (np.cumsum(step) - step) >> (MAX_BITS - lengths[order].astype(np.int64))
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each string of MAX_BITS bits, id * 32 + bits of the code that it begins with."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    rows = np.repeat(order.astype(np.int64) * 32 + lengths[order], np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64)))
    out = np.zeros(1 << MAX_BITS, np.int64)
    out[: len(rows)] = rows
    return out


def encode_block(keys: list[int | None], ends: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """A block: head, keys, ends, bit offsets of each STEP-th token, then the code in 32-bit words."""
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    bits = int(at[-1] + n[-1]) if len(ids) else 0
    words = np.zeros((bits + 31) // 32 + 2, np.uint64)
    if len(ids):
        word, room = at >> 5, 64 - (at & 31) - n
        value = codes[ids].astype(np.uint64) << room.astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(value, first)
        words[word[first]] += sums >> np.uint64(32)
        words[word[first] + 1] += sums & np.uint64(0xFFFFFFFF)
    nulls = np.array([k is None for k in keys], bool)
    names = np.array([0 if k is None else k for k in keys], "<i8")
    return b"".join([HEAD.pack(MAGIC, 1, STEP, len(keys), len(ids), bits), np.packbits(nulls).tobytes(), names.tobytes(), ends.astype("<u4").tobytes(), at[::STEP].astype("<u8").tobytes(), words.astype("<u4").tobytes()])


class Block(NamedTuple):
    """A block's parts: keys, ends of their documents, bit offsets of every STEP-th id, and the
    bit stream as overlapping pairs of words."""

    keys: list[int | None]
    ends: np.ndarray
    offsets: np.ndarray
    pairs: np.ndarray
    n_ids: int


def open_block(block: bytes) -> Block:
    magic, version, step, n_keys, n_ids, _ = HEAD.unpack_from(block)
    if (magic, version, step) != (MAGIC, 1, STEP):
        raise ValueError("not a block of this format")
    at = HEAD.size

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, n, at)
        at += out.nbytes
        return out

    nulls = np.unpackbits(part("u1", (n_keys + 7) // 8))[:n_keys].astype(bool)
    names, ends = part("<i8", n_keys), part("<u4", n_keys).astype(np.int64)
    offsets = part("<u8", (n_ids + step - 1) // step).astype(np.int64)
    words = part("<u4", (len(block) - at) // 4).astype(np.uint64)
    keys = [None if z else int(k) for k, z in zip(names, nulls, strict=True)]
    return Block(keys, ends, offsets, (words[:-1] << np.uint64(32)) | words[1:], n_ids)


def decode_slice(b: Block, table: np.ndarray, first: int, end: int) -> np.ndarray:
    """The ids of places first to end, from the bit offsets around them. All stretches between
    offsets are decoded side by side, a table look-up for each token."""
    if first >= end:
        return np.zeros(0, np.uint32)
    lead, tail = first // STEP, -(-end // STEP)
    offsets = b.offsets[lead:tail]
    out = np.zeros((STEP, len(offsets)), np.uint32)
    last = min(b.n_ids, tail * STEP) - (tail - 1) * STEP
    for k in range(STEP if len(offsets) > 1 else last):
        if k == last:
            offsets = offsets[:-1]
        here = b.pairs[offsets >> 5] >> (48 - (offsets & 31)).astype(np.uint64)
        row = table[(here & np.uint64(0xFFFF)).astype(np.int64)]
        out[k, : len(offsets)] = row >> 5
        offsets = offsets + (row & 31)
    return out.T.reshape(-1)[first - lead * STEP : end - lead * STEP]


def decode_block(block: bytes, table: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, ends, ids) of a whole block."""
    b = open_block(block)
    return b.keys, b.ends, decode_slice(b, table, 0, b.n_ids)


class IdStore(NamedTuple):
    """blocks: (file_no, block_no, n_tokens, block), in ascending order of ids;
    code: one row with the bits of each id."""

    blocks: DataFrame
    code: DataFrame


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 49408) -> IdStore:
    """Encodes whole texts, each followed by `end_id`, and writes the blocks in ascending
    order of `id_col` (a long; nulls first; repeated ids by length and checksum).

    Ids are made once and kept as bytes in the shared folder; their counts over all
    documents give the code (at most `vocabulary` counts reach the driver); a range
    shuffle brings them in order. A null or empty text is its end id alone; an empty
    table gives no blocks; other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 1000):
                batch = whole.slice(k, 1000)
                ids, ends = encode_with_end(tokenizer, batch["text"].to_pylist(), end_id)
                ids = ids.astype("<u4")
                each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                small = [x.astype("<u2").tobytes() if vocabulary <= 1 << 16 else x.tobytes() for x in each]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(small, pa.binary())], names=["id", "crc", "ids"])

    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    stored = materialise(d.mapInArrow(tokens, "id long, crc long, ids binary"), "ids", compression="zstd")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch["ids"]:
                total += np.bincount(np.frombuffer(x.as_py(), kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    rows = stored.select("ids").mapInArrow(counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(vocabulary, np.int64)
    for r in rows:
        total[r["token"]] = r["n"]
    lengths = code_lengths(total)
    codes = canonical_codes(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, block_no, keys, parts, n = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            body = encode_block(keys, np.cumsum([len(x) for x in parts]), ids, lengths, codes)
            return pa.RecordBatch.from_arrays([pa.array([file_no], pa.int32()), pa.array([block_no], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())], names=["file_no", "block_no", "n_tokens", "block"])

        for batch in batches:
            for key, raw in zip(batch["id"].to_pylist(), batch["ids"], strict=True):
                ids = np.frombuffer(raw.as_py(), kind)
                if keys and n + len(ids) > BLOCK_TOKENS:
                    yield row()
                    keys, parts, n, block_no = [], [], 0, block_no + 1
                keys.append(key)
                parts.append(ids)
                n += len(ids)
        if keys:
            yield row()

    order = [F.col("id").asc_nulls_first(), F.length("ids"), F.col("crc")]
    ordered = stored.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialise(ordered.mapInArrow(blocks, "file_no int, block_no int, n_tokens long, block binary"), "id-blocks")
    discard(stored)
    code = materialise(spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary"), "id-code")
    return IdStore(written, code)


def read_ids(store: IdStore, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(`id_col`, start, n_tokens, ids_crc32[, ids]) of each document, from the files alone.
    The driver reads one row, the code; block totals are summed by file before they
    are accumulated, so the ordered window has a row for each file."""
    lengths = np.frombuffer(bytes(store.code.first()["lengths"]), np.uint8)
    fields = [T.StructField("file_no", T.IntegerType()), T.StructField("block_no", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("id", "start", "n_tokens", "ids_crc32"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for file_no, block_no, raw in zip(batch["file_no"], batch["block_no"], batch["block"], strict=True):
                keys, ends, ids = decode_block(raw.as_py(), table)
                starts = np.concatenate([[0], ends[:-1]])
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(keys)
                cols = [pa.repeat(file_no, n), pa.repeat(block_no, n), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    inner = store.blocks.select("file_no", "block_no", "n_tokens")
    files = inner.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("before"))
    w = Window.partitionBy("file_no").orderBy("block_no")
    firsts = inner.withColumn("within", F.sum("n_tokens").over(w) - F.col("n_tokens")).join(files, "file_no").select("file_no", "block_no", (F.col("before") + F.col("within")).alias("base"))
    docs = store.blocks.select("file_no", "block_no", "block").mapInArrow(run, T.StructType(fields))
    out = docs.join(firsts, ["file_no", "block_no"]).withColumn("start", F.col("base") + F.col("start"))
    return out.select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_some(store: IdStore, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(`id_col`, ids) of the documents named in `wanted`: only the stretches of blocks that hold them
    are decoded, from the bit offset before each. A null id finds nothing."""
    lengths = np.frombuffer(bytes(store.code.first()["lengths"]), np.uint8)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, block_no, raw in zip(batch["file_no"], batch["block_no"], batch["block"], strict=True):
                b = open_block(raw.as_py())
                n = len(b.keys)
                cols = [pa.repeat(file_no, n), pa.repeat(block_no, n), pa.array(range(n), pa.int32()), pa.array(b.keys, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["file_no", "block_no", "k", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for raw, places in zip(batch["block"], batch["places"], strict=True):
                b = open_block(raw.as_py())
                at = places.as_py()
                found = [decode_slice(b, table, int(b.ends[k - 1]) if k else 0, int(b.ends[k])).astype(np.int32) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array([b.keys[k] for k in at], pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["id", "ids"])

    keys = wanted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    blocks = store.blocks.select("file_no", "block_no", "block")
    places = blocks.mapInArrow(index, "file_no int, block_no int, k int, id long").join(keys, "id").groupBy("file_no", "block_no").agg(F.collect_list("k").alias("places"))  # a block's documents at most
    return blocks.join(places, ["file_no", "block_no"]).select("block", "places").mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)
