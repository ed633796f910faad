"""Mixing to target weights: soft domain membership and nonnegative document rates.

DataFrame functions only: the work on rows has no Python, and what reaches the driver
are a few numbers for each domain and the marker words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_sample, discard, materialise

#: Labelled documents that marker words are chosen from at most, by hash of the id.
MARKER_DOCS = 4000
MARKERS = 24
RESERVED = "__mix_"


def label_domain() -> Column:
    """Domain of a row of `labels`."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _features(text: Column, markers: dict[str, list[str]]) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    size = F.length(t) + 1.0
    known = [count(rf"(?i)\b(?:{'|'.join(words)})\b") if words else F.lit(0.0) for words in markers.values()]
    return [F.log(size), count("[A-Z]") / size, count(r"[#*$%&|<>!]") / size, *(F.log1p(x) for x in known)]


def _once(*values: Column) -> Column:
    """A struct that the optimizer neither repeats where it is used nor pushes filters
    through, as it depends on the row's number."""
    return F.when(F.monotonically_increasing_id() >= 0, F.struct(*(v.alias(f"c{i}") for i, v in enumerate(values))))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("double")


def choose_markers(sample: DataFrame, most: int = MARKERS) -> dict[str, list[str]]:
    """Words of each domain that its documents of a bounded sample have far oftener than the others'."""
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return {}
    words = sample.select("domain", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))).alias("word")).where("length(word) > 2")
    counts = words.groupBy("word").pivot("domain", domains).count().na.fill(0)
    total, out = sum(sizes.values()), {}
    for d in domains:
        n = sizes.get(d, 0)
        rest = sum((F.col(x) for x in domains if x != d), F.lit(0))
        lift = F.log((F.col(d) + 0.5) / (n + 1)) - F.log((rest + 0.5) / (total - n + 1))
        best = counts.where((F.col(d) >= max(3, n // 50)) & (lift > 2.0)).orderBy(lift.desc(), "word").select("word").limit(most)
        out[d] = [r["word"] for r in best.collect()]
    return out


@dataclass(frozen=True)
class Mix:
    """A fitted mixture: what it takes to rate any document in one projection."""

    domains: list[str]
    markers: dict[str, list[str]]
    prior: list[float]
    mean: list[list[float]]
    var: list[list[float]]
    steps: list[list[float]] = field(default_factory=list)
    #: Of each domain, what the rates miss of its target, as shares of all tokens.
    residual: list[float] = field(default_factory=list)

    def logs(self, x: list[Column]) -> list[Column]:
        """log P(domain, features), Gaussian in each feature."""
        out = []
        for p, mean, var in zip(self.prior, self.mean, self.var, strict=True):
            s = F.lit(float(np.log(p) - 0.5 * np.log(var).sum()))
            for c, m, v in zip(x, mean, var, strict=True):
                s = s - (c - m) * (c - m) / (2 * v)
            out.append(s)
        return out

    def rate(self, p: list[Column]) -> Column:
        """The projected steps from rate 1, in order."""
        r = F.lit(1.0)
        for step in self.steps:
            r = F.greatest(F.lit(0.0), r - sum((c * s for c, s in zip(p, step, strict=True)), F.lit(0.0)))
        return r

    def rated(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """`docs` with columns named RESERVED + tokens, RESERVED + 0, 1, ... (posteriors)
        and RESERVED + rate. No shuffle."""
        return self.rated_features(with_features(docs, self.markers, text_col))

    def rated_features(self, d: DataFrame) -> DataFrame:
        """The same from the result of `with_features`."""
        n, k = len(d.schema[f"{RESERVED}x"].dataType.fields), len(self.domains)
        cols = [c for c in d.columns if c != f"{RESERVED}x"]
        part = lambda name, n: [F.col(f"{RESERVED}{name}.c{i}") for i in range(n)]
        tokens, *x = part("x", n)
        d = d.select(*cols, tokens.alias(f"{RESERVED}tokens"), _once(*self.logs(x)).alias(f"{RESERVED}l"))
        logs = part("l", k)
        d = d.select(*cols, f"{RESERVED}tokens", _once(*(1 / sum((F.exp(F.least(F.lit(60.0), b - a)) for b in logs), F.lit(0.0)) for a in logs)).alias(f"{RESERVED}p"))
        p = part("p", k)
        d = d.select(*cols, f"{RESERVED}tokens", *(c.alias(f"{RESERVED}{i}") for i, c in enumerate(p)), _once(self.rate(p)).alias(f"{RESERVED}r"))
        return d.select(*cols, f"{RESERVED}tokens", *(f"{RESERVED}{i}" for i in range(k)), F.col(f"{RESERVED}r.c0").alias(f"{RESERVED}rate"))


def with_features(docs: DataFrame, markers: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """`docs` with a struct RESERVED + x of tokens and features."""
    return docs.select("*", _once(n_tokens(F.col(text_col)), *_features(F.col(text_col), markers)).alias(f"{RESERVED}x"))


def fit_classifier(features: DataFrame, known: DataFrame, markers: dict[str, list[str]], id_col: str) -> Mix:
    """Priors, means and variances of the domains from all labelled documents. Labels of
    no document are ignored; with none, all is one domain."""
    n = len(features.schema[f"{RESERVED}x"].dataType.fields) - 1
    names = [f"x{k}" for k in range(n)]
    x = features.select(F.col(id_col).alias("id"), *(F.col(f"{RESERVED}x.c{k + 1}").alias(f"x{k}") for k in range(n)))
    stats = x.join(known, "id").groupBy("domain").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.var_pop)))
    rows = {r["domain"]: r for r in stats.collect()}
    if not rows:
        return Mix(["all"], markers, [1.0], [[0.0] * n], [[1.0] * n])
    domains, total = sorted(rows), sum(r["n"] for r in rows.values())
    floor = [1e-3 * max(r[f"var_pop_{c}"] for r in rows.values()) + 1e-6 for c in names]
    return Mix(domains, markers, [rows[d]["n"] / total for d in domains], [[rows[d][f"avg_{c}"] for c in names] for d in domains], [[rows[d][f"var_pop_{c}"] + f for c, f in zip(names, floor, strict=True)] for d in domains])


def fit_mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = 30, tolerance: float = 1e-7, marker_docs: int = MARKER_DOCS) -> tuple[Mix, DataFrame]:
    """The mixture whose rates give each domain its share of `total` expected tokens (None:
    all there are), and the stored, rated table (`id_col`, RESERVED columns).

    Least squares on the domain totals in the metric of H = sum of tokens * p p', where a
    projected gradient step of length one is a Newton step until rates meet zero, so a few rounds do. Each
    round is one aggregation of a number per domain; the rates of the next are the same
    projection with one more step; it ends when the objective no longer falls. Weights of absent domains
    are left out, the rest scaled. Targets that no nonnegative rates reach leave a `residual` in the mix:
    look at it. Tokens are words; at most `marker_docs` labelled documents give the marker words.
    """
    known = labels.select(F.col(id_col).alias("id"), label_domain().alias("domain")).where("domain is not null and id is not null")
    chosen = bounded_sample(known, "id", marker_docs)  # so the broadcast is bounded
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialise(text.join(F.broadcast(chosen), "id"), "labelled")
    markers = choose_markers(sample)
    discard(sample)
    features = materialise(with_features(docs.select(id_col, text_col), markers, text_col).drop(text_col), "mix-features")
    mix = fit_classifier(features, known, markers, id_col)
    plain = materialise(mix.rated_features(features).drop(f"{RESERVED}rate"), "mix-posteriors")
    k = len(mix.domains)
    p = [F.col(f"{RESERVED}{i}") for i in range(k)]
    t = F.col(f"{RESERVED}tokens")
    sums = plain.agg(F.sum(t), *(F.sum(t * p[i] * p[j]) for i in range(k) for j in range(k))).first()
    tokens = float(sums[0] or 0.0)
    want = np.array([weights.get(d, 0.0) for d in mix.domains])
    want = want / want.sum() if want.sum() > 0 else np.full(k, 1 / k)
    target = want * (tokens if total is None else total)
    if tokens > 0:
        h = np.array(sums[1:], float).reshape(k, k)
        inverse = np.linalg.inv(h + np.eye(k) * 1e-9 * np.trace(h))
        best = np.inf
        for _ in range(rounds):
            miss = np.array(plain.agg(*(F.sum(t * c * mix.rate(p)) for c in p)).first(), float) - target
            if (objective := float(miss @ inverse @ miss)) >= best * (1 - 1e-9):
                mix.steps.pop()
                break
            best, mix.residual[:] = objective, [float(x) for x in miss / target.sum()]
            if np.abs(miss).max() < tolerance * target.sum():
                break
            mix.steps.append([float(x) for x in inverse @ miss])
        else:
            del mix.steps[-1:]
    discard(features)
    return mix, plain.withColumn(f"{RESERVED}rate", mix.rate(p))


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: `id_col`, n_tokens, p_<domain> for each domain, rate >= 0.

    A null or empty text has no tokens and its rate changes no total. Null and repeated
    ids are rated like others; an empty table gives no rows; other columns are not read.
    """
    mix, rated = fit_mixture(docs, labels, weights, id_col=id_col, text_col=text_col)
    names = (F.col(f"{RESERVED}{k}").alias(f"p_{d}") for k, d in enumerate(mix.domains))
    return rated.select(id_col, F.col(f"{RESERVED}tokens").cast("long").alias("n_tokens"), *names, F.col(f"{RESERVED}rate").alias("rate"))


def mixed(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", seed: int = 4) -> DataFrame:
    """`docs` with each row as often as its rate says: the whole part, and once more with
    the probability of the rest, decided by a hash of id and text. Same columns."""
    cols = docs.columns
    r = F.col(f"{RESERVED}rate")
    u = (F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    copies = (F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)).cast("int")
    rows = mix.rated(docs, text_col).withColumn(f"{RESERVED}copies", copies).where(F.col(f"{RESERVED}copies") > 0)
    return rows.withColumn(f"{RESERVED}copy", F.explode(F.sequence(F.lit(1), F.col(f"{RESERVED}copies")))).select(*cols)
