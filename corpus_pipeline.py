"""A training-data pipeline of five stages, each a call of one corpus operator.

Each stage works on all that the one before it kept, and all but the last
return the columns of documents. Encodings cannot be written in SQL, so there
is no ORACLE_SQL; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postrider.llm.exact_dedup import without_copies
from postrider.llm.mixing import mixed_documents
from postrider.llm.quality import accepted, fit_ratings
from postrider.llm.queries import LEAST_TAIL, ratings, tokenizer
from postrider.llm.sentencepieces import digests
from postrider.llm.similar import without_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds likely to be of the top grade; toxic and poor ones go."""
    return accepted(docs, fit_ratings(docs, ratings(spark, sf_dir)), LEAST_TAIL)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked at a verified similarity of 0.8 of five-word shingles, the one with the smallest id."""
    return without_similar(docs, least=0.8, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes, as documents; one row for each pass over a document."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encodings of what is left."""
    return digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("source mixing", mix), ("sentencepiece encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
