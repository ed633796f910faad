"""A stored Katz model, and scores of any texts from it.

The model's tables lie by order and bucket. Texts become chunks as in training; a chunk asks each order's buckets
for the counts and places of its n-grams, then for the back-off weights of the contexts that it needs. A bucket's part
of a table meets all chunks that ask it in one task, and answers each; nothing is counted and no table is changed.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .katz_lm import (
    CHUNK_TEXT, COUNTED, PLAIN, SCORES, WEIGHTS, Discounts, Scored, Shape,
    _ask, _ask_words, _finish, _look_up, _rows, expand, expand_keys, expand_values, squeeze, squeeze_keys, text_chunks,
)
from .storage import discard, materialise


def save_model(model: Scored, path: str) -> None:
    """Writes the tables and numbers of a model; an existing folder is an error."""
    spark = model.counts.sparkSession
    model.counts.write.mode("errorifexists").partitionBy("level").parquet(f"{path}/counts")
    model.weights.write.mode("errorifexists").partitionBy("level").parquet(f"{path}/weights")
    about = {"discounts": [[d.low.tolist(), d.slope] for d in model.discounts], "shapes": [list(s) for s in model.shapes], "train_tokens": model.train_tokens, "vocabulary": model.vocabulary}
    spark.range(1).select(F.lit(json.dumps(about)).alias("about")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> Scored:
    """A model of `save_model`; it has no scores of its own."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    counts = spark.read.schema("bucket int, keys binary, counts binary, level int").parquet(f"{path}/counts").select("level", "bucket", "keys", "counts")
    weights = spark.read.schema("bucket int, alpha binary, level int").parquet(f"{path}/weights").select("level", "bucket", "alpha")
    discounts = [Discounts(np.array(low), slope) for low, slope in about["discounts"]]
    return Scored(spark.createDataFrame([], SCORES), counts, weights, discounts, [Shape(*s) for s in about["shapes"]], about["train_tokens"], about["vocabulary"])


def _found(asked: DataFrame, table: DataFrame) -> DataFrame:
    """An answer for each chunk and bucket: counts of the keys it asks for, and the places of those that the table has."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        stored = right.to_pylist()
        known = expand_keys(stored[0]["keys"]) if stored else np.zeros(0, np.uint64)
        total = expand(stored[0]["counts"], "u8") if stored else np.zeros(0, np.uint64)
        out = [_rows(COUNTED, [], [], [], [], [], [], [], [])]
        for i in range(len(left)):  # one chunk's keys at a time
            r = left.slice(i, 1).to_pylist()[0]
            keys = expand_keys(r["keys"])
            at = np.searchsorted(known, keys)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == keys[hit]
            count = np.zeros(len(keys), np.uint64)
            count[hit] = total[at[hit]]
            out.append(_rows(COUNTED, ["answer"], [r["bucket"]], [r["chunk"]], [None], [squeeze(count)], [squeeze(np.zeros(len(keys), np.uint8))], [squeeze_keys(at[hit])], [None]))
        return pa.Table.from_batches(out)

    return asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(run, COUNTED)


def _weighed(contexts: DataFrame, weights: DataFrame) -> DataFrame:
    """An answer for each chunk and bucket: log10 of the back-off weights of the contexts it asks for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        stored = right.to_pylist()
        alpha = expand_values(stored[0]["alpha"], "f8") if stored else np.zeros(0)
        out = [_rows(WEIGHTS, [], [], [], [], [])]
        for r in left.to_pylist():
            place = expand_keys(r["places"]).astype(np.int64)[expand(r["asks"], "u1").astype(bool)]
            got = np.zeros(len(place))
            inside = place < len(alpha)
            got[inside] = alpha[place[inside]]
            out.append(_rows(WEIGHTS, ["answer"], [r["level"]], [r["bucket"]], [r["chunk"]], [squeeze(got)]))
        return pa.Table.from_batches(out)

    return contexts.groupBy("level", "bucket").cogroup(weights.groupBy("level", "bucket")).applyInArrow(run, WEIGHTS)


def score_texts(model: Scored, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """A row for each row of `docs`, as the scores of `katz_scores` have it: `id_col`, held_out, n_tokens, n_known,
    train_tokens, base_score, score. Texts that the model was trained on get the score that they had there.

    A null, empty or wordless text is its end alone; null and repeated ids are scored like others; words that the model has not seen
    are unknown; an empty table gives no rows. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialise(text_chunks(d, chunk_text), "new-chunks", buckets=(files, "chunk"), part="kind", **PLAIN)
    answers, kept = None, []
    for k in range(len(model.shapes)):
        asked = _ask(stored, answers, model.shapes[: k + 1]) if k else _ask_words(stored, model.shapes[0])
        table = model.counts.where(F.col("level") == k).select("bucket", "keys", "counts")
        kept.append(materialise(_found(asked, table), f"new-answers-{k}", **PLAIN))
        given = kept[-1].select(F.lit(k).alias("level"), "bucket", "chunk", "counts", "owned", "places")
        answers = given if answers is None else answers.unionByName(given)
    state = materialise(_look_up(stored, answers, model.shapes, model.train_tokens, model.vocabulary, model.discounts), "new-state", part="kind", **PLAIN)
    discard(stored, *kept)
    contexts = state.where("kind = 'context'").select("level", "bucket", "chunk", "places", "asks")
    alpha = _weighed(contexts, model.weights).select("chunk", "level", "bucket", "alpha")
    texts = state.where("kind = 'docs'").select("chunk", "ids", "train", "tokens", "known", "base", "partial", "rows", "marks")
    out = texts.groupBy("chunk").cogroup(alpha.groupBy("chunk")).applyInArrow(_finish, SCORES)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
