"""Queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, chat, decontam, html_blocks, langid, minhash, mixing, token_fst, topk, url_rules
from .common import table


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language, family and margin of every document."""
    return langid.identify(table(spark, d, "documents"))


def op1_url_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every page with the mined rules that its URL matches."""
    return url_rules.filter_urls(table(spark, d, "pages"), table(spark, d, "labels"))


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document."""
    return token_fst.token_counts(table(spark, d, "documents"))


def op3_chat_examples(spark: SparkSession, d: str) -> DataFrame:
    """One example for every assistant turn."""
    return chat.expand(table(spark, d, "conversations"))


def op4_html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(table(spark, d, "pages"))


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn by raked cell probabilities."""
    return mixing.sampled(table(spark, d, "documents"))


def op6_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Every near copy with the document of its group that stays."""
    return minhash.near_duplicates(table(spark, d, "documents"))


def op8_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest others, among all vectors, of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, d, "embeddings"), query=topk.every_20th())


def op9_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean negative log probability of every document."""
    return attention_lm.scores(table(spark, d, "documents"))


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Every document with every benchmark item that it holds within the edit budget."""
    return decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_examples": chat.EXPAND_SQL, "op5_mixing": mixing.sampled_sql(), "op8_top_k": topk.TOP_K_SQL}
