"""From raw documents to packed training sequences: five stages, each written and read again by the next.

All stages take empty tables (and give empty ones), nulls in any column, empty and very long texts, and repeated rows;
other columns pass through all but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.llm import fertility, line_dedup, minhash, pii, queries
from lockgrain.llm.common import read, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null and empty texts go; repeated rows share their fate."""
    return fertility.measure(docs, queries.vocabulary("piece_bpe_32k.model")).where("kept").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; their length is counted anew.

    Documents that become empty stay, as do null texts; rows that repeat an id and its text are one document.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    That of the smallest id stays; null ids and texts without words all stay.
    """
    return minhash.keep_one(docs, shingle_words=5, threshold_percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; their length is counted anew.  Null texts stay null."""
    out = pii.find(docs, mask=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place; null and empty texts are one piece, the end alone."""
    return queries.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("minhash", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: Tokenisation and the random field cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
