"""Katz back-off of any order: Good-Turing discounts, exactly normalised back-off weights.

The model. c counts n-grams of 1 to `order` words in the training texts; each text begins
with a START that is context only and finishes with an END that is a token. N is the number of
tokens, V that of distinct ones. Unigrams are (c(w)+1) / (N+V+1), with one more class for all
unknown words. With x the one to order-1 words before w (fewer at the beginning of a text):

    P(w | x) = d(c(x w)) c(x w) / c(x)     if the n-gram x w was seen
             = alpha(x) P(w | x')          if only x was seen; x' is x without its first word
             = P(w | x')                   if x was not seen

d(r) r is the Good-Turing count (r+1) n(r+1) / n(r); where counts of counts are scarce, above K
above all, n comes from its log-linear fit, so that 0 < d < 1 for all r and every context keeps
mass for unseen words. alpha(x) is that mass over the mass that P(. | x') gives to words unseen after x,
so every context sums to one over the V words and the unknown class.

How it runs. Texts become chunks of hashed words, stored once, filed by chunk. Order by order a
chunk sends its distinct n-grams, as sorted key arrays cut by ranges into buckets; a bucket's
task adds up the counts, keeps its part of the table and answers every chunk with counts and the
places of its n-grams in the table. Keys of longer n-grams are made of the places of their parts,
so they are short, exact while they fit 64 bits, and spread evenly; an n-gram whose parts were not
seen is not asked for. Of the chunks that have an n-gram one owns it and adds it to its context, so
weights come from sums by context with one entry a chunk. A word or n-gram that is everywhere is
thus one entry a chunk, and no task holds a text, a context or a key whole. The numbers of
chunks and buckets follow the input, and what they exchange is what any shuffle between as many
tasks exchanges: a message per pair that has something to say.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, discard_part, materialise
from .textkernel import U64, chunks, mix, string_buffers, word_hashes

ORDER = 3
#: Largest count whose discount comes from the counts of counts themselves.
K = 5
#: Text bytes of a chunk, and entries of a bucket, about.
CHUNK_TEXT, BUCKET_ENTRIES = 12 << 20, 1_500_000
START, END = mix(np.array([11, 13], U64))


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((0, 0), np.uint8)
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def expand(b: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(b[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending whole numbers by their differences, whose leading bytes are zero."""
    return squeeze(np.diff(keys.astype(U64), prepend=U64(0)))


def expand_keys(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, "u8"), dtype=U64)


def squeeze_values(x: np.ndarray) -> bytes:
    """Eight-byte values, many of them equal, by their places in the list of distinct ones."""
    values, place = np.unique(x, return_inverse=True)
    if 3 * len(values) >= len(x):
        return bytes(8) + squeeze(x)
    listed = squeeze(values)
    return len(listed).to_bytes(8, "little") + listed + squeeze(place.astype(np.uint32))


def expand_values(b: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return expand(b[8 : 8 + n], kind)[expand(b[8 + n :], "u4")] if n else expand(b[8:], kind)


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A fixed permutation of the whole numbers under 2**bits that scatters neighbours."""
    mask, half = U64((1 << bits) - 1), U64(max(1, bits // 2))
    with np.errstate(over="ignore"):
        for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x * U64(odd)) & mask
            x = x ^ (x >> half)
    return x


def cuts(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where the ranges of the buckets begin and end among ascending keys under 2**bits."""
    edges = np.array([(k << bits) // buckets for k in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Shape(NamedTuple):
    """Buckets of an order's table, and entries of the largest; a seen n-gram's number is
    bucket * most + place."""

    buckets: int
    most: int
    bits: int


class Chunk(NamedTuple):
    """Tokens as places in the sorted vocabulary of the chunk; `row` is the text, `first` and `ends`
    where texts begin and end, `start` the place of START among the `size` words."""

    size: int
    start: int
    token: np.ndarray
    row: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    train: np.ndarray

    @staticmethod
    def of(r: dict) -> Chunk:
        token, ends = expand(r["token"], "i4"), expand(r["ends"], "i8")
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        row = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
        return Chunk(r["n_vocab"], r["start"], token, row, first, ends, expand(r["train"], "u1").astype(bool))


class Answer(NamedTuple):
    """Of the keys asked for: training count, number (-1 if never seen), and whether this
    chunk owns the n-gram."""

    count: np.ndarray
    number: np.ndarray
    owned: np.ndarray


class Level(NamedTuple):
    """The distinct n-grams of one order in a chunk, by ascending key. `place`: of the n-gram
    that a token ends, -1 where none was asked for. `before`: place of the context among
    the order below, by token, -1 where there is none. Of an n-gram: its context, itself without the
    first word (places in the order below), last word, and count in the chunk's training texts."""

    keys: np.ndarray
    place: np.ndarray
    before: np.ndarray
    context: np.ndarray
    shorter: np.ndarray
    word: np.ndarray
    count: np.ndarray


def levels(c: Chunk, answers: list[Answer], shapes: list[Shape]) -> list[Level]:
    """Levels of the orders 1 to len(answers) + 1; of the first only the places."""
    none = np.zeros(0, np.int64)
    out = [Level(none, c.token, none, none, none, none, none)]
    for k, a in enumerate(answers):
        now = out[-1].place
        before = np.concatenate([np.full(1, -1, np.int32), now[:-1]])
        before[c.first] = c.start if k == 0 else -1
        seen = np.append(a.count > 0, False)
        i = np.flatnonzero(seen[before] & seen[now])
        one = answers[0].number[c.token[i]].astype(U64)
        wide, bits = shapes[0].buckets * shapes[0].most, shapes[k + 1].bits
        with np.errstate(over="ignore"):
            key = a.number[before[i]].astype(U64)
            key = spread(key * U64(wide) + one, bits) if bits < 64 else mix(mix(key) + one)
        keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        place = np.full(len(now), -1, np.int32)
        place[i] = inverse
        count = np.bincount(inverse, weights=c.train[c.row[i]], minlength=len(keys)).astype(np.int32)
        out.append(Level(keys, place, before, before[i][at], now[i][at], c.token[i][at], count))
    return out


def text_chunks(docs: DataFrame, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """Two rows a chunk: `words` with its vocabulary and training counts, and `texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            offsets, body = string_buffers(batch["text"])
            for i, j in chunks(offsets, chunk_text):
                local, parts, bounds = offsets[i : j + 1] - offsets[i], [], [np.zeros(1, np.int64)]
                for a, b in chunks(local):
                    h, at = word_hashes(local[a : b + 1] - local[a], body[offsets[i] + local[a] : offsets[i] + local[b]])
                    bounds.append(at[1:] + sum(map(len, parts)))
                    parts.append(h)
                bounds = np.concatenate(bounds)
                words = np.insert(np.concatenate(parts), bounds[1:], END)
                vocab, token = np.unique(np.append(words, START), return_inverse=True)
                start, token = int(token[-1]), token[:-1]
                ids = batch["id"].slice(i, j - i).to_pylist()
                train = np.array([x is None or zlib.crc32(str(x).encode()) % 7 != 2 for x in ids], np.uint8)
                ends = bounds[1:] + np.arange(1, len(bounds))
                count = np.bincount(token[np.repeat(train, np.diff(ends, prepend=0)) > 0], minlength=len(vocab))
                count[start] = int(train.sum())
                n += 1
                yield _rows(CHUNKS, ["words"], [n], [None], [0], [len(vocab)], [0], [start], [squeeze_keys(vocab)], [squeeze(count.astype(np.uint64))], [None], [None], [None])
                yield _rows(CHUNKS, ["texts"], [n], [ids], [len(words)], [len(vocab)], [int(train.sum())], [start], [None], [None], *([squeeze(x)] for x in (token.astype(np.uint32), ends, train)))

    return docs.mapInArrow(run, CHUNKS)


CHUNKS = "kind string, chunk long, ids array<long>, n_tokens long, n_vocab long, n_train long, start long, keys binary, counts binary, token binary, ends binary, train binary"
ASK = "bucket int, chunk long, keys binary, counts binary"
COUNTED = "kind string, bucket int, chunk long, keys binary, counts binary, owned binary, places binary, totals array<long>"
ANSWER = "level int, bucket int, chunk long, counts binary, owned binary, places binary"
#: Intermediate tables are already compressed inside their columns; small row groups bound what a writer holds.
PLAIN = {"compression": "none", "parquet.block.size": 16 << 20}


def _rows(names: str, *cols: list) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _answers(rows: list[dict], shapes: list[Shape]) -> list[Answer]:
    """A chunk's answers, order by order."""
    out = []
    for k, shape in enumerate(shapes):
        own = sorted((r for r in rows if r["level"] == k), key=lambda r: r["bucket"])
        none = [np.zeros(0, np.int64)]
        count = np.concatenate([expand(r["counts"], "u8").astype(np.int64) for r in own] or none)
        number = np.full(len(count), -1)
        if k < len(shapes) - 1 or not own or own[0]["places"] is not None:
            number[count > 0] = np.concatenate([r["bucket"] * shape.most + expand_keys(r["places"]).astype(np.int64) for r in own] or none)
        out.append(Answer(count, number, np.concatenate([expand(r["owned"], "u1") for r in own] or none).astype(bool)))
    return out


def _messages(chunk: int, keys: np.ndarray, counts: np.ndarray, shape: Shape) -> Iterator[pa.RecordBatch]:
    at = cuts(keys, shape.buckets, shape.bits)
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        yield _rows(ASK, [int(b)], [chunk], [squeeze_keys(keys[s])], [squeeze(counts[s].astype(np.uint64))])


def _ask_words(stored: DataFrame, shape: Shape) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            yield from _messages(r["chunk"], expand_keys(r["keys"]), expand(r["counts"], "u8"), shape)

    return stored.where("kind = 'words'").select("chunk", "keys", "counts").mapInArrow(run, ASK)


#: Columns of a chunk's texts that levels are made from.
TEXTS = ["chunk", "n_vocab", "start", "token", "ends", "train"]


def _ask(stored: DataFrame, answers: DataFrame, shapes: list[Shape]) -> DataFrame:
    """What chunks ask of the order that is next after those answered; `shapes` ends with it."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        level = levels(Chunk.of(r), _answers(right.to_pylist(), shapes[:-1]), shapes)[-1]
        return pa.Table.from_batches(list(_messages(r["chunk"], level.keys, level.count, shapes[-1])), schema=_rows(ASK, [], [], [], []).schema)

    texts = stored.where("kind = 'texts'").select(*TEXTS)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, ASK)


def _count(asked: DataFrame, top: bool) -> DataFrame:
    """Per bucket: a `table` row with keys, counts and totals (sum, distinct, and how many
    keys have count 1, 2, ..., K+1), and an `answer` row for each chunk; `top` n-grams are no contexts, so their
    places are not sent."""

    def run(group: pa.Table) -> pa.Table:
        group = group.to_pylist()
        keys = [expand_keys(r["keys"]) for r in group]
        own = np.concatenate([expand(r["counts"], "u8") for r in group]).astype(np.int64)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=own, minlength=len(known)).astype(np.int64)
        trained = np.flatnonzero(own > 0)
        _, first = np.unique(place[trained], return_index=True)
        owner = np.zeros(len(place), np.uint8)
        owner[trained[first]] = 1
        bucket, seen = group[0]["bucket"], total > 0
        among = np.cumsum(seen) - 1
        freq = np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)[1 : K + 2]
        out = [_rows(COUNTED, ["table"], [bucket], [None], [squeeze_keys(known[seen])], [squeeze(total[seen].astype(np.uint64))], [None], [None], [[int(total.sum()), int(seen.sum()), *map(int, freq)]])]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        for r, a, b in zip(group, at[:-1], at[1:], strict=True):
            p = place[a:b]
            out.append(_rows(COUNTED, ["answer"], [bucket], [r["chunk"]], [None], [squeeze(total[p].astype(np.uint64))], [squeeze(owner[a:b])], [None if top else squeeze_keys(among[p][seen[p]])], [None]))
        return pa.Table.from_batches(out)

    return asked.groupBy("bucket").applyInArrow(run, COUNTED)


class Discounts(NamedTuple):
    """`low[r]` for r to K, and the slope of the log-linear fit of the counts of counts."""

    low: np.ndarray
    slope: float

    @staticmethod
    def of(freq: list[int]) -> Discounts:
        """From the numbers of n-grams seen 1, ..., K+1 times. A Good-Turing count that is
        missing, or not between 0 and its r, comes from the fit; so do all above K. The slope is held
        between -3 and -1.05, for which the fit's discounts are below 1."""
        n = np.array([0, *freq], float)
        r = np.flatnonzero(n)
        slope = float(np.clip(np.polyfit(np.log(r), np.log(n[r]), 1)[0] if len(r) > 1 else -2.0, -3.0, -1.05))
        low = np.ones(K + 1)
        for k in range(1, K + 1):
            good = (k + 1) * n[k + 1] / n[k] / k if n[k] else 0.0
            low[k] = good if 0 < good < 1 else (1 + 1 / k) ** (slope + 1)
        return Discounts(low, slope)

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return np.where(r <= K, self.low[np.minimum(r, K)], (1 + 1 / np.maximum(r, 1)) ** (self.slope + 1))


def _spared(count: np.ndarray, grade: Discounts) -> np.ndarray:
    """What the discount takes off counts."""
    return count * (1 - grade(count))


def _under(below: np.ndarray, k: int, grades: list[Discounts]) -> np.ndarray:
    """Numerators of the probabilities that the next lower order gives, from its counts."""
    return below + 1.0 if k == 1 else grades[k - 1](below) * below


STATE = "kind string, level int, bucket int, chunk long, places binary, many binary, single binary, below binary, left binary, lower binary, over binary, count binary, asks binary, ids array<long>, train binary, tokens binary, known binary, base binary, partial binary, rows binary, marks binary"


def _look_up(stored: DataFrame, answers: DataFrame, shapes: list[Shape], n: int, v: int, grades: list[Discounts]) -> DataFrame:
    """Per chunk: a `docs` row with the sums that need no back-off weight and the tokens that do
    (by order: which text, and which of the contexts asked for), and `context` rows with the
    chunk's share of the masses of contexts, by their places in the tables. `many` is how many n-grams
    of a context the chunk owns, 2 for more than one: of one it sends the count and that of the
    n-gram without its first word, of more the sums `left` and `lower`."""
    names = [f.split()[0] for f in STATE.split(", ")]

    def state(**given) -> pa.RecordBatch:
        return _rows(STATE, *([given.get(x)] for x in names))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        c = Chunk.of(r)
        got = _answers(right.to_pylist(), shapes)
        level = levels(c, got[:-1], shapes)
        unigram = (got[0].count + 1.0) / (n + v + 1)
        n_docs = len(c.ends)
        total = lambda x, row=c.row: np.bincount(row, weights=x, minlength=n_docs)
        logs, pending = np.zeros(len(c.token)), np.ones(len(c.token), bool)
        rows, marks, asked = [], [], [np.zeros(len(a.count), bool) for a in got]
        held = [np.append(a.count, 0) for a in got]
        for k in range(len(got) - 1, 0, -1):
            context, seen = held[k - 1][level[k].before], held[k][level[k].place]
            hit = pending & (seen > 0)
            logs[hit] = logs[hit] + np.log10(grades[k](seen[hit]) * seen[hit] / context[hit])
            pending &= ~hit
            open_ = np.flatnonzero(pending & (context > 0))
            asked[k - 1][level[k].before[open_]] = True
            number = np.cumsum(asked[k - 1]) - 1
            rows.append(squeeze(c.row[open_].astype(np.uint32)))
            marks.append(squeeze(number[level[k].before[open_]].astype(np.uint32)))
        base = np.log10(unigram)[c.token]
        logs[pending] += base[pending]
        pack = lambda blobs: b"".join(len(x).to_bytes(8, "little") + x for x in blobs)
        tokens, known = np.diff(c.ends, prepend=0), total(got[0].count[c.token] > 0).astype(np.int64)
        out = [state(kind="docs", chunk=r["chunk"], ids=r["ids"], train=r["train"], tokens=squeeze(tokens), known=squeeze(known), base=squeeze(total(base)), partial=squeeze(total(logs)), rows=pack(rows), marks=pack(marks))]
        for k in range(1, len(got)):
            own = np.flatnonzero(got[k].owned)
            count, context, shorter = got[k].count[own], level[k].context[own], level[k].shorter[own]
            size = len(got[k - 1].count)
            below = got[0].count[level[1].word[own]] if k == 1 else got[k - 1].count[shorter]
            over = np.full(size, n + v + 1 if k == 1 else 0)
            if k > 1:
                over[context] = held[k - 2][level[k - 1].context[shorter]]
            many = np.minimum(np.bincount(context, minlength=size), 2).astype(np.uint8)
            left_over = np.bincount(context, weights=_spared(count, grades[k]), minlength=size)
            lower = np.bincount(context, weights=_under(below, k, grades), minlength=size)
            single, single_below = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            single[context], single_below[context] = count, below
            use = np.flatnonzero(asked[k - 1] | (many > 0))
            shape = shapes[k - 1]
            bucket, place = np.divmod(got[k - 1].number[use], shape.most)
            at = np.searchsorted(bucket, np.arange(shape.buckets + 1))
            for b in np.flatnonzero(np.diff(at)):
                s = use[at[b] : at[b + 1]]
                one, more = s[many[s] == 1], s[many[s] == 2]
                out.append(
                    state(
                        kind="context", level=k - 1, bucket=int(b), chunk=r["chunk"], places=squeeze_keys(place[at[b] : at[b + 1]]), many=squeeze(many[s]), single=squeeze(single[one]), below=squeeze(single_below[one]),
                        left=squeeze(left_over[more]), lower=squeeze(lower[more]), over=squeeze_values(over[s]), count=squeeze(got[k - 1].count[s]), asks=squeeze(asked[k - 1][s]),
                    )
                )
        return pa.Table.from_batches(out)

    texts = stored.where("kind = 'texts'").select(*TEXTS, "ids")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, STATE)


WEIGHTS = "kind string, level int, bucket int, chunk long, alpha binary"
SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _back_off(contexts: DataFrame, grades: list[Discounts]) -> DataFrame:
    """Per bucket a `table` row with log10 alpha of its n-grams as contexts, in the order of the
    bucket's keys, and an `answer` row for each chunk that asks."""

    def run(group: pa.Table) -> pa.Table:
        group = group.to_pylist()
        places = [expand_keys(r["places"]).astype(np.int64) for r in group]
        flat = np.concatenate(places)
        size = int(flat.max()) + 1
        level, bucket = group[0]["level"], group[0]["bucket"]
        many = np.concatenate([expand(r["many"], "u1") for r in group])
        sums = np.zeros((2, len(flat)))
        single, below = (np.concatenate([expand(r[x], "u8") for r in group]).astype(np.int64) for x in ("single", "below"))
        sums[:, many == 1] = _spared(single, grades[level + 1]), _under(below, level + 1, grades)
        sums[:, many == 2] = [np.concatenate([expand(r[x], "f8") for r in group]) for x in ("left", "lower")]
        left, lower = (np.bincount(flat, weights=x, minlength=size) for x in sums)
        over, count = np.zeros(size, np.int64), np.ones(size, np.int64)
        np.maximum.at(over, flat, np.concatenate([expand_values(r["over"], "i8") for r in group]))
        count[flat] = np.concatenate([expand(r["count"], "i8") for r in group])
        alpha = np.zeros(size)
        on = left > 0
        alpha[on] = np.log10(left[on] / count[on]) - np.log10(1 - lower[on] / over[on])
        out = [_rows(WEIGHTS, ["table"], [level], [bucket], [None], [squeeze_values(alpha)])]
        for r, p in zip(group, places, strict=True):
            asks = expand(r["asks"], "u1").astype(bool)
            if asks.any():
                out.append(_rows(WEIGHTS, ["answer"], [level], [bucket], [r["chunk"]], [squeeze(alpha[p[asks]])]))
        return pa.Table.from_batches(out)

    return contexts.groupBy("level", "bucket").applyInArrow(run, WEIGHTS)


def _unpack(b: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        yield b[at + 8 : at + 8 + n]
        at += 8 + n


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    r = left.to_pylist()[0]
    got, score = right.to_pylist(), expand(r["partial"], "f8").copy()
    parts = list(zip(_unpack(r["rows"]), _unpack(r["marks"]), strict=True))
    for level, (rows, marks) in zip(range(len(parts) - 1, -1, -1), parts, strict=True):
        own = sorted((x for x in got if x["level"] == level), key=lambda x: x["bucket"])
        alpha = np.concatenate([expand(x["alpha"], "f8") for x in own] or [np.zeros(0)])
        score += np.bincount(expand(rows, "u4"), weights=alpha[expand(marks, "u4")] if len(alpha) else None, minlength=len(score))
    train = expand(r["train"], "u1").astype(bool)
    return pa.Table.from_batches([_rows(SCORES, r["ids"], (~train).tolist(), expand(r["tokens"], "i8"), expand(r["known"], "i8"), expand(r["base"], "f8"), score)])


class Scored(NamedTuple):
    """scores, and the stored model. counts: (level, bucket, keys, counts) with the sorted keys of
    the n-grams of level + 1 words; weights: (level, bucket, alpha), log10 of the back-off
    weights in the order of those keys. Both are stored by level and bucket."""

    scores: DataFrame
    counts: DataFrame
    weights: DataFrame
    discounts: list[Discounts]
    shapes: list[Shape]
    train_tokens: int
    vocabulary: int


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_text: int = CHUNK_TEXT, bucket_entries: int = BUCKET_ENTRIES) -> Scored:
    """Learns from the texts whose crc32(id as text) mod 7 is not 2 and scores all texts.

    scores: a row for each row of `docs`: `id_col`, held_out, n_tokens, n_known,
    train_tokens, base_score, score. A-Z are lowered; tokens are words without space and
    the controls 0x09-0x0D, then one end. A null, empty or wordless text is its end
    alone. A null id trains. Repeated rows count each time. Without training texts
    all words are unknown. An empty table gives no rows. Other columns are not read.

    Each step is stored in the shared folder and later steps read it there; tables
    and shuffles that nothing needs any more are deleted.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialise(text_chunks(d, chunk_text), "lm-chunks", buckets=(files, "chunk"), part="kind", **PLAIN)
    tokens, vocab, train_docs = (int(x or 0) for x in stored.where("kind = 'texts'").agg(F.sum("n_tokens"), F.sum("n_vocab"), F.sum("n_train")).first())
    shapes, grades, totals, tables = [], [], [], []
    answers = None
    for k in range(order):
        buckets = max(12, math.ceil((tokens if k else vocab) / bucket_entries))
        bits = min(64, (shapes[-1].buckets * shapes[-1].most * shapes[0].buckets * shapes[0].most - 1).bit_length()) if k else 64
        shape = Shape(buckets, 0, bits)
        asked = _ask(stored, answers, [*shapes, shape]) if k else _ask_words(stored, shape)
        counted = materialise(_count(asked, k == order - 1), f"lm-counts-{k}", part="kind", **PLAIN)
        if k == 0:
            discard_part(stored, "kind", "words")
        tables.append(counted)
        table = counted.where("kind = 'table'").select("totals")
        summed = table.select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("n"), F.max("col").alias("most")).collect()
        of = {r["pos"]: (r["n"], r["most"]) for r in summed}
        totals.append(of.get(0, (0, 0))[0])
        shapes.append(Shape(buckets, max(1, of.get(1, (0, 0))[1]), bits))
        grades.append(Discounts.of([of.get(2 + r, (0, 0))[0] for r in range(K + 1)]))
        if k == 0:
            v = of.get(1, (0, 0))[0] - (train_docs > 0)
        given = counted.where("kind = 'answer'").select(F.lit(k).alias("level"), "bucket", "chunk", "counts", "owned", "places")
        answers = given if answers is None else answers.unionByName(given)
    n = totals[0] - train_docs
    state = materialise(_look_up(stored, answers, shapes, n, v, grades), "lm-state", part="kind", **PLAIN)
    counts = [t.where("kind = 'table'").select(F.lit(k).alias("level"), "bucket", "keys", "counts") for k, t in enumerate(tables)]
    model = counts[0]
    for t in counts[1:]:
        model = model.unionByName(t)
    discard(stored)
    for t in tables:
        discard_part(t, "kind", "answer")
    weights = materialise(_back_off(state.where("kind = 'context'").select("level", "bucket", "chunk", "places", "many", "single", "below", "left", "lower", "over", "count", "asks"), grades), "lm-weights", **PLAIN)
    discard_part(state, "kind", "context")
    alpha = weights.where("kind = 'answer'").select("chunk", "level", "bucket", "alpha")
    texts = state.where("kind = 'docs'").select("chunk", "ids", "train", "tokens", "known", "base", "partial", "rows", "marks")
    out = texts.groupBy("chunk").cogroup(alpha.groupBy("chunk")).applyInArrow(_finish, SCORES)
    out = out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    return Scored(out, model, weights.where("kind = 'table'").select("level", "bucket", "alpha"), grades, shapes, n, v)
