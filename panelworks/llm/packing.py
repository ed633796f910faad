"""Best-fit packing of token pieces into sequences, with a bounded number of open bins."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialise
from .textkernel import U64, mix
from .tokenization import encode_with_end, encoder, forget

SEQUENCE_TOKENS = 1024
OPEN_BINS = 4096
#: Pieces that one task packs: enough that its open bins at the end are a small share.
TASK_PIECES = 150_000
#: Ids hardly repeat, so only entropy coding makes them smaller; small row groups bound what a writer holds.
PACKED_TABLE = {"compression": "zstd", "parquet.block.size": 16 << 20}


class BestFit:
    """Online best fit. Open bins are listed by free space; a bitset holds which free
    spaces have a bin, so the best bin is one shift and one lowest bit away. With
    `open_bins` open, the fullest closes before another opens."""

    def __init__(self, size: int, open_bins: int) -> None:
        self.size, self.open_bins = size, open_bins
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0
        #: Bins that nothing more goes into; the caller may empty the list.
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        b = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to `size` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.open_bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            self.bins[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(b)
        return b, self.size - free


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS) -> DataFrame:
    """(id, piece, start, length, ids, deal): a document's ids and end id as bytes, two for each id
    if the vocabulary allows, else four; one longer than `size` is cut so that all but its
    first piece have `size` ids. `deal` is the piece's own number, scattered, by which pieces are dealt
    out later: equal pieces have different ones."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType
    fields = [T.StructField("id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length")), T.StructField("ids", T.BinaryType()), T.StructField("deal", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = TaskContext.get().partitionId() << 40
        width = "<u2" if max(encoder(tokenizer).top_id, end_id) < 1 << 16 else "<u4"
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                ids, ends = encode_with_end(tokenizer, batch["text"].to_pylist(), end_id)
                ids = ids.astype(width)
                total = np.diff(ends)
                n = (total + size - 1) // size
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = total - (n - 1) * size
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
                length = np.where(piece == 0, head[row], size)
                at_ids = ends[:-1][row] + start
                held = [ids[a : a + k].tobytes() for a, k in zip(at_ids, length, strict=True)]
                cols = [batch["id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary()), pa.array(mix(np.arange(dealt, dealt + len(row), dtype=U64)).view(np.int64))]
                dealt += len(row)
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return d.mapInArrow(run, T.StructType(fields))


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """(sequence_id, ids, pieces): sequences with the ids of their pieces (bytes) and, in the
    order of their offsets, structs id, piece, start, length. `pieces` is as of
    `token_pieces`, with a `length` of 1 to `size`. Rows are dealt by their own numbers into tasks of
    about `task_pieces` and arrive in that order, so pieces that repeat, and frequent keys and
    lengths, are spread evenly. A task holds its open sequences, `open_bins` at most."""
    stored = materialise(pieces, "pieces", **PACKED_TABLE)
    tasks = max(1, math.ceil(stored.count() / task_pieces))
    dealt = stored.repartition(tasks, "deal").sortWithinPartitions("deal")
    held = T.StructType([stored.schema[x] for x in ("id", "piece", "start", "length")])
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("pieces", T.ArrayType(held))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        filled: dict[int, list[tuple]] = {}
        kind = None
        forget()

        def rows(done: list[int]) -> pa.RecordBatch:
            parts = [filled.pop(b) for b in done]
            flat = [p for part in parts for p in part]
            cols = [pa.array([p[k] for p in flat], t) for k, t in enumerate((kind, pa.int32(), pa.int64(), pa.int64()))]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cols, names=held.names))
            return pa.RecordBatch.from_arrays([pa.array([base + b for b in done], pa.int64()), pa.array([b"".join(p[4] for p in part) for part in parts], pa.binary()), lists], names=schema.names)

        for batch in batches:
            kind = batch["id"].type
            for row in zip(*(batch[x].to_pylist() for x in ("id", "piece", "start", "length", "ids")), strict=True):
                filled.setdefault(bins.place(row[3])[0], []).append(row)
            while bins.closed:
                yield rows(bins.closed[:1000])
                del bins.closed[:1000]
        left = list(filled)
        for at in range(0, len(left), 1000):
            yield rows(left[at : at + 1000])

    packed = materialise(dealt.mapInArrow(run, schema), "sequences", **PACKED_TABLE)
    discard(stored)
    return packed


def unpack(sequences: DataFrame, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): the pieces of
    sequences of `pack`, cut from the sequences' ids. The checksum is of four bytes an id."""
    held = sequences.schema["pieces"].dataType.elementType
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    fields = [*held.fields, T.StructField("ids_crc32", T.LongType()), *ids_field, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(at, min(at + 1000, len(whole))))) for c in whole.columns], names=whole.schema.names)
                pieces = batch["pieces"].flatten()
                length = np.array(pieces.field("length"), np.int64)
                n = np.array(batch["pieces"].value_lengths(), np.int64)
                body = b"".join(batch["ids"].to_pylist())
                ids = np.frombuffer(body, f"<u{len(body) // max(1, int(length.sum()))}").astype("<u4") if body else np.zeros(0, "<u4")
                first = np.cumsum(length) - length
                offset = first - np.repeat(first[np.cumsum(n) - n], n)
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(first, length, strict=True)]
                cols = [*(pieces.field(f.name) for f in held), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                cols += [pa.array(np.repeat(np.array(batch["sequence_id"]), n), pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return sequences.mapInArrow(run, T.StructType(fields))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, with_ids: bool = True) -> DataFrame:
    """Packs whole documents into sequences of at most `size` tokens.

    Returns a row for each piece: `id_col`, piece, start, length, ids_crc32, ids (if
    `with_ids`), sequence_id, offset. Whether or not the rows show ids, the stored
    sequences hold them, and ids_crc32 is taken from there. A null or empty text is its
    end id alone; null and repeated ids are packed like others; an empty table gives no
    rows; other columns are not read. Ids are made once and written to the shared folder,
    so a lost executor repeats only its own part.
    """
    pieces = token_pieces(docs, tokenizer, end_id, id_col, text_col, size)
    return unpack(pack(pieces, size), with_ids).withColumnRenamed("id", id_col)
