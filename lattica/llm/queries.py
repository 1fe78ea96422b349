"""The queries op1 to op10 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import licenses
from lattica.llm.decontaminate import find_leaks
from lattica.llm.exact_dedup import ExactDedup
from lattica.llm.packing import pack_documents
from lattica.llm.pitman_yor import score
from lattica.llm.quality import resample
from lattica.llm.shared import scratch, table
from lattica.llm.simhash import NearDuplicates
from lattica.llm.suffixes import find_repeats
from lattica.llm.token_files import read_token_files, write_token_files
from lattica.llm.tokens import vocabulary_path
from lattica.llm.warc import page_rows, read_archives, write_archives


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=1, uri=scratch(spark, "token-files"))
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactDedup(table(spark, sf_dir, "documents")).decisions()


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents")).labelled()


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample(docs, table(spark, sf_dir, "labels"), k=docs.count() // 2)  # half of all documents are drawn, of those that are fit


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return page_rows(read_archives(spark, [f["path"] for f in files]))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_licenses": op3_licenses,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_suffixes": op8_suffixes,
    "op9_language_model": op9_language_model,
    "op10_warc": op10_warc,
}

ORACLE_SQL = {
    "op3_licenses": licenses.oracle_sql(),
    "op4_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        WINDOW w AS (PARTITION BY text_sha256)""",
}
