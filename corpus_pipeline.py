"""Corpus pipeline: documents in, packed training sequences out. Each stage works on all that its predecessor kept."""

from __future__ import annotations

import os
import sys

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import exact_dedup, langid, packing, pii, simhash
from shelfspark.llm.common import documents, store
from shelfspark.session import ensure_checkpoint_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    ensure_checkpoint_dir(spark)
    return langid.drop_unidentified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ensure_checkpoint_dir(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ensure_checkpoint_dir(spark)
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows."""
    ensure_checkpoint_dir(spark)
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    ensure_checkpoint_dir(spark)
    return packing.pack(docs, packing.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: No SQL: language models, SimHash components, labelled spans and packing are not expressible; tests/llm checks by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
