"""The corpus pipeline: stages of the training-data operators, each written as Parquet and read again.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents.

Defined cases: a null text is empty and stays, if no other empty text does. Each row is judged for itself, by its own text: rows that
share an id, or have none, don't fall together. Of rows with equal texts (white space aside) that with the smallest id stays, one without an id only if
all of them are. Other columns, whatever their names, are kept until packing, which returns pieces. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.decontaminate import keep_clean
from lattica.llm.exact_dedup import ExactDedup
from lattica.llm.jaccard import keep_one
from lattica.llm.packing import pack_documents
from lattica.llm.quality import keep_good
from lattica.llm.shared import stored, table
from lattica.llm.tokens import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id stays."""
    return ExactDedup(docs).kept()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles have a similarity of 0.8 or more with those of one that stays go."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the documents left, as pieces of sequences of at most 4096 tokens."""
    return pack_documents(docs, vocabulary_path(), end_id=2)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Tokenizers, models and fingerprints are outside SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
