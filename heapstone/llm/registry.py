"""The queries of this subpackage and their SQL: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heapstone.llm import chat, conversation_trie, host_rules, html_extract, license_scan, merkle, mixing, near_dup, packing, quality_cnn, sharding, token_counts, vector_search
from heapstone.llm import oracle as sql
from heapstone.llm.common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=16)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), most=1024)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_cnn.score_documents(docs, quality_cnn.fit(docs, read(spark, sf_dir, "labels")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents")).drop("source")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(read(spark, sf_dir, "documents")).drop("host", "shrunk_rate")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), near_dup.Likeness(width=3, percent=85, rows=6))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_sharding, op3_packing, op4_quality_classifier, op5_chat_formatting, op6_mixing, op7_quality_rules,
        op8_minhash_near_dedup, op9_vector_search, op10_token_counts, op11_conversation_prefix_trie, op12_merkle_manifest, op13_license_scan,
    )
}

SQL: dict[str, str] = {
    "op5_chat_formatting": sql.CHAT, "op6_mixing": sql.MIXING, "op7_quality_rules": sql.QUALITY_RULES, "op8_minhash_near_dedup": sql.NEAR_DEDUP,
    "op11_conversation_prefix_trie": sql.TRIE, "op12_merkle_manifest": sql.MERKLE, "op13_license_scan": sql.LICENSES,
}
