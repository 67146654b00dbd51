"""A training-data pipeline: quality classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns a DataFrame that is written as Parquet and read again. All but the last
return the columns of `documents`, whatever else these are.

Null and empty texts: the classifier scores them by its intercept alone; those that stay link with no other
document, have no passages (a null text becomes empty) and are packed as pieces of length 0 in no
bin. Null doc_ids stay null and count as the least. Repeated rows are near duplicates, of which one
stays. An empty table gives an empty result. Lengths are counted in words, as each stage calls one operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import jaccard_join, packing, quality, suffix_array
from strandloom.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages of 100 bytes or more that occur again, the first stays."""
    return suffix_array.remove_later_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: which piece of which document lies where in which bin."""
    return packing.pack(docs)


STAGES = [("quality_classifier", classify), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("best_fit_packing", pack)]

#: SQL expresses neither training nor packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
