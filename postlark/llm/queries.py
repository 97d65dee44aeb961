"""The queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lexical, mixing, ngram_join, pii, repair, repeats, rules, spotsigs, token_files, vector_tree, warc
from .common import table


def vocabulary() -> str:
    """The public tokenizer's file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprinted(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_hostile(table(spark, sf_dir, "conversations")))


def op11_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damaged(conversations), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_rules, op3_warc, op4_spotsigs, op5_pii, op6_token_files, op7_bpe, op8_mixing, op9_repeats, op10_chat, op11_vector_tree, op12_lexical, op13_repair)}
ORACLE_SQL: dict[str, str] = {"op3_warc": warc.WARC_SQL, "op8_mixing": mixing.MIXING_SQL, "op10_chat": chat.CHAT_SQL, "op12_lexical": lexical.RANKED_SQL, "op13_repair": repair.REPAIR_SQL}
