"""A training corpus from raw documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import decontamination, language, pieces, secrets, simhash
from docflow.llm.shared import table, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without a letter, or in no learned language, go.

    Null and empty texts go; null ids and repeated rows are judged by their texts; an empty table,
    or one without labelled texts, keeps nothing.
    """
    return language.known_language_only(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near copies the document with the smallest doc_id stays.

    Rows without an id all stay, of rows that share an id one of each group; empty texts are copies.
    """
    return simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that contain a test item go; null and empty texts stay."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets are replaced by their kind; all rows stay, a null text becomes empty."""
    return secrets.without_secrets(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids of every row, with its doc_id, and lang and source where there are such."""
    import public_tokenizers

    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    coded = pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=keep)
    return coded.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("leaks", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("encode", encode_texts),
]

#: Fingerprints, code lengths and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
