"""Fill-in-middle: prefix, middle and suffix of texts change places by displacement of bytes.

A batch of texts is one run of UTF-8 bytes. Each text is scanned for its code points and cut
into three segments. All bytes of a segment move by one displacement, so the displacements of a
whole batch are a difference array with an entry where a segment starts, and its cumulative sum
says for every byte where it goes: one scatter builds all outputs. Rebuilding finds the
three marks in each output, makes the difference array of the reverse and gathers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import chunks, string_buffers

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned numbers for each id, from the SHA-256 of `seed:id`; a null id counts as empty text."""
    digests = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def occurrences(body: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) where the mark stands whole within a row, in order."""
    if len(body) < len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = body[: len(body) - len(mark) + 1] == mark[0]
    for k, c in enumerate(mark[1:], 1):
        here = here & (body[k : len(body) - len(mark) + 1 + k] == c)
    at = np.flatnonzero(here)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + len(mark) <= offsets[row + 1]
    return at[inside], row[inside]


def displacements(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """The displacement of each of `size` bytes, from segments in order that cover them all; segments
    may be empty."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(shifts, prepend=0))
    return np.cumsum(steps[:-1])


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def transform(offsets: np.ndarray, body: np.ndarray, h: np.ndarray, marks: tuple[bytes, ...], plain_percent: int, spm_percent: int) -> tuple[np.ndarray, ...]:
    """(code points, form, prefix, middle, output offsets, output bytes) of the rows."""
    points = np.flatnonzero((body & 0xC0) != 0x80)
    edges = np.append(points, len(body))
    first = np.searchsorted(points, offsets)
    n = np.diff(first)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    form = np.where(h[:, 3] % 100 < spm_percent, SPM, PSM)
    form[(n == 0) | (h[:, 2] % 100 >= 100 - plain_percent)] = PLAIN
    for mark in marks:
        form[occurrences(body, offsets, mark)[1]] = PLAIN
    moved = form != PLAIN
    start, end = offsets[:-1], offsets[1:]
    a, b = np.where(moved, edges[first[:-1] + low], end), np.where(moved, edges[first[:-1] + high], end)
    size = [len(m) for m in marks]
    to = _bounds(end - start + np.where(moved, sum(size), 0))
    base, p, s = to[:-1], a - start, end - b
    prefix_at = base + np.where(form == PSM, size[0], np.where(form == SPM, size[1] + s + size[0], 0))
    suffix_at = np.where(form == PSM, prefix_at + p + size[1], base + size[1])
    middle_at = to[1:] - (b - a)
    suffix_at[~moved], middle_at[~moved] = to[1:][~moved], to[1:][~moved]
    shift = displacements(np.column_stack([start, a, b]).ravel(), np.column_stack([prefix_at - start, middle_at - a, suffix_at - b]).ravel(), len(body))
    out = np.empty(to[-1], np.uint8)
    out[np.arange(len(body)) + shift] = body
    for mark, at in zip(marks, (prefix_at, suffix_at, middle_at), strict=True):
        out[at[moved, None] - len(mark) + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return n, form, low, high - low, to, out


def rebuild(offsets: np.ndarray, body: np.ndarray, form: np.ndarray, marks: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether rebuilt, text offsets, text bytes) from outputs and forms. A row whose marks are not
    once each in its form's order is not rebuilt and gets no bytes."""
    rows, moved = len(form), form != PLAIN
    at, good = np.full((3, rows), -1), np.ones(rows, bool)
    for k, mark in enumerate(marks):
        places, row = occurrences(body, offsets, mark)
        at[k, row] = places
        good &= ~moved | (np.bincount(row, minlength=rows) == 1)
    size, start, end = [len(m) for m in marks], offsets[:-1], offsets[1:]
    p0, s0, m0 = at[0] + size[0], at[1] + size[1], at[2] + size[2]
    p1, s1 = np.where(form == PSM, at[1], at[2]), np.where(form == PSM, at[2], at[0])
    lead = np.where(form == PSM, at[0], at[1])
    good &= ~moved | ((lead == start) & (p0 <= p1) & (s0 <= s1) & (m0 <= end))
    p0, p1 = np.where(moved, p0, start), np.where(moved, p1, end)
    m0, m1, s0, s1 = (np.where(moved, x, end) for x in (m0, end, s0, s1))
    p, m, s = (np.where(good, hi - lo, 0) for lo, hi in ((p0, p1), (m0, m1), (s0, s1)))
    to = _bounds(p + m + s)
    base = to[:-1]
    shift = displacements(np.column_stack([base, base + p, base + p + m]).ravel(), np.column_stack([p0 - base, m0 - base - p, s0 - base - p - m]).ravel(), to[-1])
    return good, to, body[np.arange(to[-1]) + shift]


def _strings(offsets: np.ndarray, body: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body)), mask, -1 if mask else 0)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """A row for each row of `docs`: `id_col`, n, form, prefix_chars, middle_chars, output.

    The text's n code points are cut at two places that the id and the seed draw. form is
    `plain` (the text as it is) for an empty text, for one that holds a mark, and for `plain_percent` of
    100 otherwise; of the others `spm_percent` of 100 are `spm` (suffix, prefix, middle) and the rest
    `psm` (prefix, suffix, middle), each part behind its mark. The lengths are null for plain.
    A null text is empty; a null id draws as an empty id; equal ids draw alike, and
    repeated rows appear as often as they come. A very long text is moved whole, alone. An
    empty table gives no rows. Other columns are not read. Nothing is shuffled.
    """
    raw = tuple(m.encode() for m in marks)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = T.StructType([d.schema["id"], *(T.StructField(c, t) for c, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = string_buffers(batch["text"])
            for i, j in chunks(offsets):
                ids = batch["id"].slice(i, j - i)
                n, form, prefix, middle, to, out = transform(offsets[i : j + 1] - offsets[i], body[offsets[i] : offsets[j]], draws(ids.to_pylist(), seed), raw, plain_percent, spm_percent)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(FORMS[form]), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), _strings(to, out)], names=fields.names)

    return d.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def restore_middle(rows: DataFrame, form_col: str = "form", output_col: str = "output", name: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """`rows` with the texts rebuilt from output and form alone. The text is null where the output or form is
    null, the form is unknown, or the marks are not as the form has them."""
    raw = tuple(m.encode() for m in marks)
    columns = [c for c in rows.columns if c != name]
    fields = T.StructType([*(rows.schema[c] for c in columns), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = string_buffers(batch[output_col])
            there = np.array(batch[output_col].is_valid())
            names = np.array([x or "" for x in batch[form_col].to_pylist()], object)
            form = np.select([names == f for f in FORMS], range(len(FORMS)), -1).astype(np.int64)
            for i, j in chunks(offsets):
                known = form[i:j] >= 0
                good, to, text = rebuild(offsets[i : j + 1] - offsets[i], body[offsets[i] : offsets[j]], np.maximum(form[i:j], 0), raw)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in columns), _strings(to, text, good & known & there[i:j])], names=fields.names)

    return rows.select(*columns).mapInArrow(run, fields)
