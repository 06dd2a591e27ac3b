"""The corpus queries by name, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sessionlens.llm import (
    alignment,
    ann,
    bpe,
    decontaminate,
    html,
    mixing,
    quality,
    secrets,
    simhash,
    tokens,
    toxicity,
    turn_trie,
    urls,
)
from sessionlens.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_slots(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping documents and items; a clean document has no row."""
    found = decontaminate.find_overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.drop("doc_hash")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = urls.toxic_page_keys(pages, table(spark, sf_dir, "labels"))
    return urls.judge_urls(pages, listed).drop("url")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), digest=True)


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_secret_scan,
        op2_simhash,
        op3_mixing,
        op4_nearest,
        op5_quality,
        op6_toxicity,
        op7_decontaminate,
        op8_html_text,
        op9_url_filter,
        op10_token_counts,
        op11_alignment,
        op12_byte_pairs,
        op13_turn_trie,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_url_filter": urls.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
