"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, token encoding.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import jaccard_join, language, mixing, pieces, secrets
from hirelake.llm.common import cut, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; lang becomes the inferred one."""
    return language.accept(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the text; widely copied examples and clean documents stay as they are."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each text, with their number."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("secret_scan", secret_scan), ("source_mix", source_mix), ("tokens", tokens)]

#: The language model, MinHash and the token scan have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
