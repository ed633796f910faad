"""Exact Jaccard links between word-shingle sets, by filters under several token orders.

How candidates are found. Each document's tokens are the hashes of its distinct
shingles. Its pool is all of them, up to WHOLE, or else the CUT smallest. Pools of similar
documents share at least `need` tokens: a set of WHOLE * t or less only has similar sets
whose pools are whole, so t times its size; for larger ones each of the CUT smallest tokens
of the union is common with probability t or more and then lies in both pools, so `need` is
what CUT such draws reach but for a chance under MISS, far below that of a collision of
64-bit hashes. With `exact` all pools are whole and nothing is left to chance.

If two pools share `need` tokens, then under ANY order of all tokens the first
|pool| - need + 1 tokens of both meet. Three orders are used: rare tokens first, and two
independent hash orders among tokens that occur in more than one class. Pairs come from
meeting under the first order, where what is left behind the places of the first common
token must suffice; only those that also meet under the two others, and fit in size, are
verified on their whole sets. Rare-first keeps buckets of frequent passages empty unless
documents consist of little else.

How copies are handled. Equal sets are one class with a number of its own, and links are made
between classes; a row is one of its class, whatever its id, and classes that share an id are joined.
A pair leaves the join only if its parity sketches, which bound the difference of the sets from below, allow
the threshold. `jaccard_links` pairs buckets in full, so a group of near copies costs what it has
links, the square of its size. `jaccard_components` only needs what joins: in each bucket, classes are first
compared with one leader alone, that with the fewest rarer tokens, which copies of one text are closest to; what it leaves apart
gets a leader of its own in the next round; at last
buckets are paired in full, but only between classes that are not yet in one component, so groups stay near linear.

How links are counted. Every link lies inside a component, so `jaccard_join` deals the classes of each component into blocks
of bounded size and compares each two blocks in one task: prefixes must meet under all three orders there too, what
is left is verified on whole sets, and only a number for each class and pair of blocks comes out. No link is left out, and no row is
made for a pair; a component of m classes sends each of them m / BLOCK_CLASSES times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialise
from .textkernel import U64, chunks, mix, shingle_hashes, string_buffers, word_hashes

WORDS, PERCENT = 5, 75
#: Sets up to WHOLE are their own pools; larger ones keep the CUT smallest tokens.
WHOLE, CUT = 256, 64
#: Chance at most that cut pools of two similar sets share fewer tokens than `need`.
MISS = 1e-11
#: Classes, and tokens of their sets, that a block of a component holds on average at most.
BLOCK_CLASSES, BLOCK_TOKENS = 48, 200_000
#: Rounds in which a bucket has a leader, before what is still apart is paired in full.
LEADER_ROUNDS = 3
#: Tokens that are counted together in a comparison of two blocks.
COLUMNS = 4096
#: Bits of a set's parity sketch, as longs: two sketches differ in no more bits than the
#: sets in tokens.
SKETCH = 16


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a batch with a column `text`."""
    offsets, body = string_buffers(batch["text"])
    for i, j in chunks(offsets):
        h, bounds = shingle_hashes(*word_hashes(offsets[i : j + 1] - offsets[i], body[offsets[i] : offsets[j]]), words)
        for k in range(i, j):
            yield k, np.unique(h[bounds[k - i] : bounds[k - i + 1]])


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5DEADBEEF)).sum(dtype=U64)
    return tuple(int(x) for x in np.array([a, b], U64).view(np.int64))


def shingle_signatures(docs: DataFrame, words: int = WORDS, whole: int = WHOLE) -> DataFrame:
    """(id, n, set_a, set_b, pool, parity): set size, its digest, pool, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, pool, parity = [], [], [], [], []
            for _, s in _sets(batch, words):
                n.append(len(s))
                for to, x in zip((a, b), _digest(s), strict=True):
                    to.append(x)
                parity.append(np.packbits(np.bincount((s & U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64))
                pool.append((s if len(s) <= whole else s[:CUT]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(pool, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))], names=["id", "n", "set_a", "set_b", "pool", "parity"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, set_a long, set_b long, pool array<long>, parity array<long>")


def shingle_sets(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, tokens): whole sets of rows (cls, set_a, set_b, text) whose text has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True)
            found = [(k, s.view(np.int64)) for (k, s), key in zip(_sets(batch, words), keys, strict=True) if _digest(s) == key]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["cls"].take(at), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["cls", "tokens"])

    return rows.select("cls", "set_a", "set_b", "text").mapInArrow(run, "cls long, tokens array<long>")


def need_cut(percent: int, miss: float = MISS) -> int:
    """The most tokens that CUT draws, each common with this chance, fall short of with
    probability `miss` at most."""
    t, below = percent / 100, 0.0
    for c in range(CUT + 1):
        below += math.comb(CUT, c) * t**c * (1 - t) ** (CUT - c)
        if below > miss:
            return max(1, c)
    return CUT


def need(n: Column, percent: int = PERCENT, whole: int = WHOLE) -> Column:
    """Tokens that the pool of a set of n shares at least with that of any similar set."""
    return F.when(n <= whole * percent // 100, F.ceil(n * percent / 100.0 - 1e-9)).otherwise(F.lit(need_cut(percent))).cast("int")


def fits(a: Column, b: Column, percent: int, whole: int = WHOLE) -> Column:
    """Whether sizes, what is left from the places of a common token on, and the sketches
    allow the threshold. a, b: structs n, need, left, parity. True for a similar pair's first
    common token."""
    small = whole * percent // 100
    both = F.when((a["n"] <= small) & (b["n"] <= small), F.ceil((a["n"] + b["n"]) * percent / (100.0 + percent) - 1e-9)).otherwise(F.least(a["need"], b["need"]))
    apart = sum((F.bit_count(F.get(a["parity"], F.lit(i)).bitwiseXOR(F.get(b["parity"], F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    sizes = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    return sizes & (F.least(a["left"], b["left"]) >= both) & (apart * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold."""
    joined = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("sb")), "b").join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("sa")), "a")
    sized = joined.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return sized.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _filtered(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs that also meet under the other orders."""
    side = lambda x: heads.select(F.col("cls").alias(x), F.col("second").alias(f"s{x}"), F.col("third").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where(F.arrays_overlap("sa", "sb") & F.arrays_overlap("ta", "tb")).select("a", "b")


class Links(NamedTuple):
    """Links of documents: those of a class link with each other and with all of linked classes."""

    #: (id, n, cls): a row for each row of the documents; cls is null without shingles or id.
    rows: DataFrame
    #: (cls, n, rep, copies): classes of equal sets with their smallest id and number of rows.
    classes: DataFrame
    #: (a, b): every verified pair of different classes, once with a < b.
    pairs: DataFrame


class _Prepared(NamedTuple):
    """rows and classes as in `Links`; heads: classes with their prefixes under the three orders;
    sets: whole sets of these; tokens: (token, cls, k, fit), a row for each prefix token under the first."""

    rows: DataFrame
    classes: DataFrame
    heads: DataFrame
    sets: DataFrame
    tokens: DataFrame


def _prepare(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, whole: int) -> _Prepared:
    """Tables that a join needs with one row a key are stored first, so that Spark can split
    the other side where a key is hot."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(shingle_signatures(d, words, whole), "signatures")
    linked = signed.where("n > 0 and id is not null")
    key = ["set_a", "set_b", "n"]
    classes = materialise(linked.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    of = linked.join(classes, key)
    reps = materialise(of.where("id = rep").dropDuplicates(["cls"]).select("cls", "id", *key, "pool", "parity"), "representatives")
    rows = materialise(signed.select("id", F.when(F.col("id").isNotNull(), F.col("set_a")).alias("set_a"), "set_b", "n").join(classes.drop("rep", "copies"), key, "left").select("id", "n", "cls"), "members")
    tokens = reps.select("cls", F.explode("pool").alias("token"))
    shared = materialise(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-tokens")
    hits = tokens.join(shared, "token")
    heads = hits.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("hits"))  # a pool at most
    heads = heads.join(reps.select("cls", "id", "set_a", "set_b", "n", "parity"), "cls")
    heads = heads.withColumn("need", need(F.col("n"), percent, whole)).where(F.size("hits") >= F.col("need"))
    length = F.size("hits") - F.col("need") + 1
    other = lambda seed: F.transform(F.slice(F.sort_array(F.transform("hits", lambda x: F.struct(F.xxhash64(x["token"], F.lit(seed)).alias("h"), x["token"].alias("token")))), 1, length), lambda x: x["token"])
    heads = heads.select("cls", "id", "set_a", "set_b", "n", "parity", "need", F.size("hits").alias("left"), F.slice("hits", 1, length).alias("first"), other(2).alias("second"), other(3).alias("third"))
    heads = materialise(heads, "prefixes")
    discard(signed, reps, shared)
    sets = materialise(shingle_sets(d.join(heads.select("id", "cls", "set_a", "set_b"), "id"), words).dropDuplicates(["cls"]), "sets")
    at = heads.select("cls", "n", "need", "left", "parity", F.posexplode("first.token").alias("k", "token"))
    at = at.select("token", "cls", "k", F.struct("n", "need", (F.col("left") - F.col("k")).alias("left"), "parity").alias("fit"))
    return _Prepared(rows, classes.select("cls", "n", "rep", "copies"), heads, sets, at)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, exact: bool = False) -> Links:
    """All links between different texts and the membership of classes. Sets, links and nulls are as
    in `jaccard_components`."""
    whole = 1 << 40 if exact else WHOLE
    p = _prepare(docs, id_col, text_col, words, percent, whole)
    left = p.tokens.select("token", F.col("cls").alias("a"), F.col("fit").alias("fa"))
    right = p.tokens.select("token", F.col("cls").alias("b"), F.col("fit").alias("fb"))
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & fits(F.col("fa"), F.col("fb"), percent, whole))
    pairs = materialise(pairs.select("a", "b", (F.col("fa.n") + F.col("fb.n") <= 64 * SKETCH).alias("small")).distinct(), "pairs")
    rest = _filtered(pairs.where("not small"), p.heads)  # small sets: the sketch leaves little more than links
    out = materialise(_verified(pairs.where("small").select("a", "b").unionByName(rest), p.sets, percent), "jaccard-links")
    discard(p.heads, p.sets, pairs)
    return Links(p.rows, p.classes, out)


def overlaps(lists: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common values of each list of `left` with each other one of `right`, from lists of distinct longs; what a list
    has in common with itself is not told."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1  # values of one list alone are in no pair
    keep = n[at] > 1
    row, column = row[keep], number[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, width, COLUMNS):
        i, j = np.searchsorted(column, (c, c + COLUMNS))
        part = np.zeros((len(lists), min(COLUMNS, width - c)), np.float32)
        part[row[i:j], column[i:j] - c] = 1
        out += part[left] @ part[right].T
    return out.astype(np.int64)


def block_links(t: pa.Table, percent: int) -> pa.Table:
    """(cls, linked) of two blocks `lo` and `hi` of a component: for each class the rows of the classes of the other block, or of the
    same if there is but one, that it links with."""
    lists = {c: t[c].combine_chunks() for c in ("first", "second", "third", "tokens")}
    block, copies, cls = (t[c].to_numpy() for c in ("block", "copies", "cls"))
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    link = np.ones((len(left), len(right)), bool)
    if lo == hi:
        np.fill_diagonal(link, False)
    for order in ("first", "second", "third"):
        if link.any():
            link &= overlaps(lists[order], left, right) > 0
    if link.any():
        size, common = lists["tokens"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), overlaps(lists["tokens"], left, right)
        link &= 100 * common >= percent * (size[left][:, None] + size[right][None] - common)
    sides = [(left, link @ copies[right])] + ([(right, copies[left] @ link)] if lo != hi else [])
    at, linked = (np.concatenate(x) for x in zip(*sides, strict=True))
    some = linked > 0
    return pa.table({"cls": pa.array(cls[at[some]], pa.int64()), "linked": pa.array(linked[some], pa.int64())})


def _link_counts(p: _Prepared, comp: DataFrame, percent: int) -> DataFrame:
    """(cls, linked): the rows of other classes that each class links with; classes without links have no row."""
    members = p.heads.select("cls", "n", F.col("first.token").alias("first"), "second", "third").join(comp, "cls")
    sizes = members.groupBy("component").agg(F.count("*").alias("_m"), F.sum("n").alias("_t")).where("_m > 1")
    blocks = F.ceil(F.greatest(F.col("_m") / BLOCK_CLASSES, F.col("_t") / BLOCK_TOKENS)).cast("int")
    sizes = materialise(sizes.select("component", blocks.alias("blocks")), "component-blocks")
    d = members.drop("n").join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    d = d.join(p.classes.select("cls", "copies"), "cls").join(p.sets, "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("component", "cls", "copies", "first", "second", "third", "tokens", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    counted = d.groupBy("component", "lo", "hi").applyInArrow(lambda t: block_links(t, percent), "cls long, linked long")
    out = materialise(counted.groupBy("cls").agg(F.sum("linked").alias("linked")), "link-counts")
    discard(sizes)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """A row for each row of `docs`: `id_col`, n_shingles, component_id.

    A-Z are lowered; words are runs without space and the controls 0x09-0x0D; the set of
    a text is its distinct shingles of `words` words, or its whole sequence if it has
    fewer. Rows link when 100 * |intersection| >= percent * |union|. component_id is the
    smallest id that links reach. A null, empty or wordless text has no shingles and
    links with nothing; a null id has itself, null, as component. Rows that share an
    id are one node, whose links are those of all its texts, and appear as often as they come, each
    with the shingles of its own text. Other columns are not read.
    """
    return _joined(docs, id_col, text_col, words, percent, exact, False)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """As `jaccard_components`, with n_links: how many other rows a row links with, from all links. Rows of a null id, or without
    shingles, have 0; rows that share an id count each for itself."""
    return _joined(docs, id_col, text_col, words, percent, exact, True)


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, exact: bool, count: bool) -> DataFrame:
    whole = 1 << 40 if exact else WHOLE
    p = _prepare(docs, id_col, text_col, words, percent, whole)
    links = _joining_links(p, percent, whole)
    shared = p.rows.where("cls is not null").groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z")
    same = p.rows.where("cls is not null").join(shared, "id").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    comp = connected_components(links.unionByName(same), "a", "b").select(F.col("node").alias("cls"), "component")
    counts = _link_counts(p, comp, percent) if count else None
    ends = p.classes.join(comp, "cls", "left").select("cls", "rep", "copies", F.coalesce("component", "cls").alias("root"))
    least = materialise(ends.groupBy("root").agg(F.min("rep").alias("component_id")), "least-ids")
    ends = ends.join(least, "root")
    if count:
        ends = ends.join(counts, "cls", "left").withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1)
    ends = materialise(ends.select("cls", "component_id", *["n_links"] * count), "class-components")
    discard(least, links, p.heads, p.sets, *([counts] if count else []))
    out = p.rows.join(ends, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] * count))


def _joining_links(p: _Prepared, percent: int, whole: int) -> DataFrame:
    """Verified links (a, b) between classes that join all that any links join: in LEADER_ROUNDS rounds with a leader of each
    bucket, then between all components that these leave apart in a bucket.

    A leader is compared with the classes of other components alone. It is, of the classes that nothing has joined yet if there are any,
    the one with the fewest rarer tokens, so what one leader misses has a leader of its own in the next round, and
    little is left to pair in full."""
    placed, found, tried, old = p.tokens.withColumn("component", F.col("cls")), None, None, []
    for n in range(LEADER_ROUNDS):
        first = F.struct(F.col("component") != F.col("cls"), "k", F.xxhash64("cls", F.lit(n)), "cls")
        leaders = materialise(placed.groupBy("token").agg(F.min_by(F.struct("cls", "fit", "component"), first).alias("top")), "leaders")
        star = placed.join(leaders, "token").where((F.col("component") != F.col("top.component")) & fits(F.col("fit"), F.col("top.fit"), percent, whole))
        star = star.select(F.least("cls", "top.cls").alias("a"), F.greatest("cls", "top.cls").alias("b")).distinct()
        star = materialise(star.join(tried, ["a", "b"], "left_anti") if tried is not None else star, "star-pairs")
        near = materialise(_verified(_filtered(star, p.heads), p.sets, percent), "star-links")
        found, tried = (near, star) if found is None else (found.unionByName(near), tried.unionByName(star))
        comp = connected_components(found, "a", "b").select(F.col("node").alias("cls"), "component")
        now = p.tokens.join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        mixed = now.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
        mixed = materialise(mixed, "mixed")
        before, placed = placed, materialise(now.join(mixed, "token", "left_semi"), "buckets")
        discard(leaders, mixed, *([before] if n else []))
        old += [star, near]
    left = placed.select("token", F.col("cls").alias("ia"), F.col("component").alias("ca"), F.col("fit").alias("fa"))
    right = placed.select("token", F.col("cls").alias("ib"), F.col("component").alias("cb"), F.col("fit").alias("fb"))
    pairs = left.join(right, "token").where((F.col("ca") < F.col("cb")) & fits(F.col("fa"), F.col("fb"), percent, whole))
    pairs = pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    out = materialise(found.unionByName(_verified(_filtered(pairs, p.heads), p.sets, percent)), "joining-links")
    discard(placed, *old)
    return out
