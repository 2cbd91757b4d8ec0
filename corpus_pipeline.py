"""A corpus from raw documents to packed sequences; each stage calls one operator of tessera.llm.

Stages get the rows that the one before kept, read back from Parquet, and return the columns of documents;
the last returns the pieces of the packed sequences. Extra columns are carried. Null and empty texts
go in the first stage, which asks for words. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import packing, quality_classifier, quality_rules, simhash, suffix_array_dedup
from tessera.llm.common import cut, load
from tessera.ship import ship

#: The least Jaccard similarity of near copies.
SIMILARITY = 0.8
#: Bytes of the shortest byte string that is removed where it repeats: 98 to 99 in 100 repeated passages of 50 words have as many.
REPEAT_BYTES = 250


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the counted rules and the calibrated n-gram regression keep."""
    ship(spark)
    return quality_rules.good_rows(docs, docs, load(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that naive Bayes support vectors predict to be good. They are fitted on the labelled rows of the
    original table, since the stage before has taken most bad examples away."""
    ship(spark)
    return quality_classifier.good_rows(docs, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each component of SimHash links and of texts whose five-word
    shingles are alike."""
    ship(spark)
    return simhash.one_of_each(docs, similarity=SIMILARITY)


def suffix_array_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without byte strings of REPEAT_BYTES that occur twice."""
    ship(spark)
    return suffix_array_dedup.clean_rows(docs, REPEAT_BYTES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, placed in sequences."""
    ship(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_array_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses none of these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
