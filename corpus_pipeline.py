"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Nulls: a null text fails the quality rules; a null doc_id is a row like
others, which is nobody's near copy. Rows that repeat a doc_id are judged one by one by the
rules and the classifier; near copies leave one doc_id of each group, all its rows.
Columns beyond those of documents are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.llm.mixing import fit_mixture, mixed
from panelworks.llm.ngram_jaccard import jaccard_components
from panelworks.llm.packing import pack_documents
from panelworks.llm.quality_classifier import quality_classifier
from panelworks.llm.quality_rules import quality_rules
from panelworks.llm.queries import TARGET_WEIGHTS, tokenizer
from panelworks.llm.storage import discard_since, kept_tables, materialise, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=COLUMNS).where("kept").select("held.*").select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    judged = quality_classifier(docs, read_table(spark, sf_dir, "labels"), carry=COLUMNS)
    return judged.where("kept").select("held.*").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    others = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates for the target weights say."""
    mix, _ = fit_mixture(docs, read_table(spark, sf_dir, "labels"), TARGET_WEIGHTS)
    return mixed(docs, mix).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequences and offsets."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("soft_membership_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: Classifier, links and rates are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = kept_tables(spark)
        after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_since(spark, before - {getattr(docs, "_scratch_table", "")}, after)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
