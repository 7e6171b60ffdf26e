"""A corpus from raw documents to packed training sequences: STAGES applied one after another.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. `run` writes each stage's rows as a table before the next.

Defined cases of every stage: null texts are empty; null ids are rows like others; an empty table gives an empty one; further columns are kept
by all stages but the last, whatever their names; very long texts are read whole. Rows equal in id and text are one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosswork.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from mosswork.llm.common import durable
from mosswork.llm.queries import WORDS, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier rejects, which empty ones are too. Without trusted labels every document with text stays."""
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts: the one with the most characters, then the smallest id (null last)."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: its smallest id (null last). Documents without words all stay."""
    return ngram_join.kept_rows(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; n_chars follows the text."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences; a null or empty text is its end mark alone."""
    return packing.pack(docs, vocabulary(WORDS))


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("secret_scans", secrets), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model probabilities, signatures and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
