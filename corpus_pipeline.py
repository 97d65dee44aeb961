"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Each stage works on everything that the one before kept. All but the last return the columns of
``documents``; rows with nulls, empty texts, repeated rows and empty tables pass through as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.llm import bpe, mixing, ngram_join, pii, rules
from postlark.llm.common import table, written
from postlark.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the learned decision list rejects."""
    return rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near duplicates."""
    others = ngram_join.linked(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return ngram_join.restricted(docs, written(others, "others"), "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by marks."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources reach their weights, in shuffled order."""
    return mixing.mixed(docs, numbered=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row."""
    return bpe.encode_documents(docs, vocabulary()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]
#: Learned rules and BPE can't be said in SQL; a test holds each stage's rows and the chain's against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
