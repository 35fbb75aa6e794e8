"""Registered queries of the subpackage, one per operator, and their DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, embed_dedup, exact_dedup, html_main, langid, lexical_rank, packing, pii, piece_codec, prefix_trie, quality, sharding, simhash
from .common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared language: lang; host: source. doc_id, lang, posterior, text_lang, declared, letters, kept."""
    found = langid.identify(documents(spark, sf_dir))
    return found.select(found["id"].alias("doc_id"), "lang", "posterior", "text_lang", "declared", "letters", "kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(documents(spark, sf_dir), piece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.lm_scores(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.search(lexical_rank.build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_exact_dedup, op3_sharding, op4_packing, op5_quality, op6_simhash, op7_embedding_dedup, op8_pieces,
    op9_brown_lm, op10_pii, op11_prefix_trie, op12_html_main,
    op13_lexical_rank)}
ORACLE: dict[str, str] = {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL, "op13_lexical_rank": lexical_rank.ORACLE_SQL}
