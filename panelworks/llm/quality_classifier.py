"""Quality classifier: document evidence and host and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import below
from .storage import discard, materialise
from .textkernel import chunks, mix, string_buffers, word_hashes

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!=+_~^@/\\{}[]"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Variances of evidence are at most 0.25 and count as this at least; sites that show none of their own shrink to their prior.
LEAST_VARIANCE = 1e-9
#: Hashed words whose weights make the feature `lexical`.
LEXICON = 1 << 14
FEATURES = ("log_bytes", "word_bytes", "symbols", "punctuation", "capitals", "digits", "line_words", "lone_symbols", "sentence_ends", "word_repeats", "distinct_words", "lexical")


def evidence(offsets: np.ndarray, body: np.ndarray, lexicons: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: counts of byte classes and of repeated words
    against bytes or words, and `lexical`, the mean weight of its words, once for each lexicon."""
    if len(body) == 0:
        return np.zeros((len(offsets) - 1, len(FEATURES) - 1 + len(lexicons)))
    word = ~_SPACE[body]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    starts[offsets[:-1][offsets[:-1] < len(body)]] = word[offsets[:-1][offsets[:-1] < len(body)]]
    symbol = _SYMBOL[body]
    ends = np.append(~word[1:], True)
    marks = [word, starts, symbol, _PUNCT[body], _UPPER[body], _DIGIT[body], body == 10, symbol & starts & ends, (body == ord(".")) & ends]
    total = [np.diff(np.concatenate([[0], np.cumsum(m, dtype=np.int64)])[offsets]).astype(float) for m in marks]
    inside, words, symbols, punct, upper, digits, lines, lone, stops = total
    n, w = np.maximum(inside, 1), np.maximum(words, 1)
    hashes, bounds = word_hashes(offsets, body)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[again], minlength=len(w))
    _, first = np.unique(mix(row.astype(np.uint64)) ^ hashes, return_index=True)
    distinct = np.bincount(row[first], minlength=len(w))
    at = (hashes & np.uint64(LEXICON - 1)).astype(np.int64)
    lexical = [np.bincount(row, weights=x[at], minlength=len(w)) / w for x in lexicons]
    return np.column_stack([np.log1p(inside), inside / w, symbols / n, punct / w, upper / w, digits / n, w / (lines + 1) / 100, lone / w, stops / w, repeats / w, np.log(np.maximum(distinct, 1)) - 0.8 * np.log(w), *lexical])


def document_features(docs: DataFrame, columns: list[str], lexicons: np.ndarray) -> DataFrame:
    """`columns` and the array `x` of `evidence` for each row with a column `text`."""
    kept = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = string_buffers(batch["text"])
            rows = [np.zeros((0, len(FEATURES) - 1 + len(lexicons)))]
            rows += [evidence(offsets[i : j + 1] - offsets[i], body[offsets[i] : offsets[j]], lexicons) for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(list(np.concatenate(rows)), pa.list_(pa.float64()))], names=[*columns, "x"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*columns, "text").mapInArrow(run, f"{fields}, x array<double>")


def hashed_words(docs: DataFrame) -> DataFrame:
    """(id, words): the distinct hashed words of each text, and LEXICON, which stands for the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = string_buffers(batch["text"])
            words, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in chunks(offsets):
                h, bounds = word_hashes(offsets[i : j + 1] - offsets[i], body[offsets[i] : offsets[j]])
                row = np.concatenate([np.repeat(np.arange(j - i), np.diff(bounds)), np.arange(j - i)])
                at = np.concatenate([(h & np.uint64(LEXICON - 1)).astype(np.int64), np.full(j - i, LEXICON)])
                both = np.unique(row * (LEXICON + 1) + at)
                words.append(both % (LEXICON + 1))
                counts.append(np.bincount(both // (LEXICON + 1), minlength=j - i))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words).astype(np.int16)))], names=["id", "words"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, words array<smallint>")


def word_weights(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """Log odds of hashed words between all texts of both labels: a row for each fold, from the texts of the
    other, and one from all. `known` has id, y, fold. At most 4 * (LEXICON + 1) sums reach the driver."""
    words = hashed_words(docs).join(known, "id").select("fold", F.col("y").cast("int").alias("y"), F.explode("words").alias("at"))
    seen = np.zeros((2, 2, LEXICON + 1))
    for r in words.groupBy("fold", "y", "at").agg(F.count("*").alias("n")).collect():
        seen[r["fold"], r["y"], r["at"]] = r["n"]
    weight = lambda s: np.log((s[1, :-1] + 0.5) / (s[1, -1] + 1)) - np.log((s[0, :-1] + 0.5) / (s[0, -1] + 1))
    return np.stack([weight(seen[1]), weight(seen[0]), weight(seen.sum(0))])


def fit_logistic(rows: DataFrame, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and intercept on raw features, from all rows (y, x array<double>), by Newton steps on standardised ones; the
    ridge keeps them finite where classes separate. One class or none: only an intercept. Each step reads the rows once; sums of gradients
    and second derivatives are combined by Spark."""
    size = len(FEATURES)
    each = [F.get("x", F.lit(k)) for k in range(size)]
    n, ones, *moments = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0)), *(F.avg(c) for c in each), *(F.stddev_pop(c) for c in each)).first()
    prior = (ones + 1) / (n + 2)
    out = np.zeros(size + 1)
    out[-1] = np.log(prior / (1 - prior))
    if n < 10 or ones in (0, n):
        return out
    mean, scale = np.array(moments[:size]), np.maximum(moments[size:], 1e-9)

    def sums(w: np.ndarray) -> np.ndarray:
        """The gradient and the second derivatives at w, one after the other."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 1) * (size + 2))
            for batch in batches:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                total += np.concatenate([z.T @ (batch["y"].to_numpy() - p), ((z.T * (p * (1 - p))) @ z).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

        found = rows.select("y", "x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(found, key=lambda r: r["at"])])

    w, pull = np.zeros(size + 1), np.full(size + 1, ridge * n)
    pull[-1] = 0
    for _ in range(rounds):
        s = sums(w)
        step = np.linalg.solve(s[size + 1 :].reshape(size + 1, -1) + np.diag(pull + 1e-9), s[: size + 1] - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


class Strengths(NamedTuple):
    """Variances within paths, between the paths of a host, and between hosts, and how many documents' worth
    the prior of a host and of a path therefore has."""

    within: float
    paths: float
    hosts: float

    @property
    def host_weight(self) -> float:
        return max(self.within + self.paths, LEAST_VARIANCE) / max(self.hosts, LEAST_VARIANCE)

    @property
    def path_weight(self) -> float:
        return max(self.within, LEAST_VARIANCE) / max(self.paths, LEAST_VARIANCE)


def estimate_strengths(sites: DataFrame) -> Strengths:
    """By moments of unequal groups, from rows (path_sum, path_square, path_n, host_sum, host_n, host_paths) of each
    path: the sums of squares within paths, between paths and between hosts are set equal to their expectations."""
    share = F.col("path_n") * F.col("path_n") / F.col("host_n")
    once = lambda c: c / F.col("host_paths")
    r = sites.agg(
        F.sum("path_n"), F.count("*"), F.sum(once(F.lit(1.0))), F.sum("path_sum"), F.sum("path_square"), F.sum(F.col("path_sum") * F.col("path_sum") / F.col("path_n")),
        F.sum(once(F.col("host_sum") * F.col("host_sum") / F.col("host_n"))), F.sum(share), F.sum(F.col("path_n") * F.col("path_n")), F.sum(once(F.col("host_n") * F.col("host_n"))),
    ).first()
    n, p, h, total, squares, path_squares, host_squares, shares, path_n2, host_n2 = (float(x or 0) for x in r)
    if n == 0:
        return Strengths(0.0, 0.0, 0.0)
    within = max(0.0, (squares - path_squares) / (n - p)) if n > p else 0.0
    paths = max(0.0, (path_squares - host_squares - (p - h) * within) / (n - shares)) if n - shares > 1e-9 * n else 0.0
    spread = host_squares - total * total / n - (h - 1) * within - paths * (shares - path_n2 / n)
    hosts = max(0.0, spread / (n - host_n2 / n)) if n - host_n2 / n > 1e-9 * n else 0.0
    return Strengths(within, paths, hosts)


def best_threshold(judged: DataFrame) -> float:
    """From all rows (p, y): the cut with the largest sum of the two labels' shares on their right sides; of several the
    lowest. One label or none: 0.5. Distinct values with their counts are dealt by range, so no task sorts all of them."""
    v = judged.groupBy(F.lit(0).alias("_all"), "p").agg(F.count_if(F.col("y") == 0).alias("low"), F.count_if(F.col("y") == 1).alias("high"))
    v = materialise(v.repartitionByRange("p").withColumn("_piece", F.spark_partition_id()), "cuts")
    low, high = v.agg(F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("high"), F.lit(0))).first()
    cut = 0.5
    if low and high:
        right = F.col("low_below") / low + 1 - F.col("high_below") / high
        best = below(v, ["_all"], "p", ["low", "high"]).select("p", right.alias("right")).orderBy(F.col("right").desc(), "p").first()
        before = v.where(F.col("p") < best["p"]).agg(F.max("p")).first()[0]
        cut = 0.0 if before is None else (before + best["p"]) / 2
    discard(v)
    return cut


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str | None = None, label_col: str = "quality", threshold: float | None = None, host_weight: float | None = None, path_weight: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of `docs`: `id_col`, p_document, host_prior, path_prior,
    p_quality, kept; columns named in `carry` come back as the fields of `held`.

    A logistic classifier on byte classes and hashed words, fitted on all labelled
    rows, gives p_document; words have the weights of the half of the rows that a fitted row is not in. The
    evidence of a document for its site is its label, or else p_document; the mean over all documents is the global prior; a host's
    posterior is the mean of its other documents with `host_weight` documents' worth of
    the global prior, a path's that of its other documents with `path_weight` worth of the host's. Both weights are
    estimated, if they are None, from the variances within and between sites (`estimate_strengths`): the less
    sites differ, the more a sparse one shrinks. The posterior odds are the document's odds times the path's odds over the global
    odds; `kept` is p_quality >= threshold, by default the cut that tells the labels of all labelled rows best apart.

    Sites are summed by one grouped aggregation and joined back from stored tables with a
    row a site, so a host with a third of all documents is split. A null host or path is
    a site of its own; a host without another document has the global prior, a path without one its host's. A null or empty text has evidence zero and is judged by that. Labels that
    are null or belong to no document are ignored, several of one document are averaged; without labels of both kinds
    p_document is constant and everything is kept. Repeated rows count each time. Other
    columns are not read.
    """
    path = F.col("lang") if path is None else F.col(path) if isinstance(path, str) else path
    host = F.col(host) if isinstance(host, str) else host
    held = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(True)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"), held.alias("held"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("y in (0.0, 1.0) and id is not null").groupBy("id").agg(F.avg("y").alias("y"))
    known = materialise(known, "labels")
    fold = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")
    lexicons = word_weights(d, known.where("y in (0.0, 1.0)").select("id", "y", fold.alias("fold")))
    names, last = ["id", "host", "path", *["held"] * bool(carry)], len(FEATURES) - 1
    features = materialise(document_features(d, names, lexicons).join(known, "id", "left"), "features")
    x_of = lambda k: F.concat(F.slice("x", 1, last), F.array(F.get("x", k + last)))
    weights = fit_logistic(features.where("y in (0.0, 1.0)").select("y", x_of(fold).alias("x")))

    def chance(score: Column) -> Column:
        return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 / (1 + F.exp(-score))))

    score = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        score = score + F.lit(float(w)) * F.get("x", F.lit(k if k < last else last + 2))
    scored = features.select(*names, "y", chance(score).alias("p")).withColumn("e", F.coalesce("y", "p"))

    paths = materialise(scored.groupBy("host", "path").agg(F.sum("e").alias("path_sum"), F.sum(F.col("e") * F.col("e")).alias("path_square"), F.count("*").alias("path_n")), "paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"), F.count("*").alias("host_paths")), "hosts")
    sites = materialise(paths.join(hosts, "host"), "sites")
    total = hosts.agg(F.sum("host_sum"), F.sum("host_n")).first()
    prior = min(1 - 1e-6, max(1e-6, total[0] / total[1])) if total[1] else 0.5
    found = estimate_strengths(sites)
    a = found.host_weight if host_weight is None else host_weight
    b = found.path_weight if path_weight is None else path_weight
    discard(paths, hosts)
    out = scored.join(sites, ["host", "path"])
    # a site without another document, whose prior counts nothing either, has the prior above it
    without = lambda site, weight, above: F.coalesce(F.try_divide(F.col(f"{site}_sum") - F.col("e") + weight * above, F.col(f"{site}_n") - 1 + weight), above)
    out = out.withColumn("host_prior", F.when(F.col("host_n") > 1, without("host", a, F.lit(prior))).otherwise(F.lit(prior)))
    out = out.withColumn("path_prior", F.when(F.col("path_n") > 1, without("path", b, F.col("host_prior"))).otherwise(F.col("host_prior")))
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_prior")))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(float(np.log(prior / (1 - prior))) - _logit(F.col("p")) - _logit(site))))
    if threshold is None:
        threshold = best_threshold(out.where("y in (0.0, 1.0)").select(F.col("p_quality").alias("p"), "y"))
    out = out.withColumn("kept", F.col("p_quality") >= threshold)
    return out.select(F.col("id").alias(id_col), F.col("p").alias("p_document"), "host_prior", "path_prior", "p_quality", "kept", *["held"] * bool(carry))
