"""Corpus pipeline over ``documents``: each stage reads what its predecessor kept.

Every stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that :func:`run` writes as Parquet and reads again as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsearch.llm import mixing, pii, piece_tokens, quality, simhash_dedup
from fedsearch.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the plain rules or the likelihood ratio go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the smallest id of each group stays."""
    return simhash_dedup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans of personal data are replaced by the name of their kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the words that the mix takes, one row per document and pass."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: piece ids of each text, and whether they decode to it."""
    rows = piece_tokens.round_trip(docs.select("doc_id", "source", "lang", "text"))
    return rows.select("doc_id", "source", "lang", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("PII", redact),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot state the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
