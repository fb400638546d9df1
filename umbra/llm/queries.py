"""Queries over the driver's tables for the training-text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import sql
from umbra.llm.bpe import encode_documents
from umbra.llm.chat_format import digests, format_chats
from umbra.llm.common import table
from umbra.llm.decontaminate import Decontamination
from umbra.llm.license_scan import license_digest, scan_licenses
from umbra.llm.line_dedup import LineDedup
from umbra.llm.lm_score import WindowModel
from umbra.llm.near_dedup import NearDedup
from umbra.llm.quality_classifier import KneserNey
from umbra.llm.quality_rules import quality_rules
from umbra.llm.secret_scan import scan_documents, secret_digest


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    return WindowModel().score(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fate of every line of every text; equal lines go at any length."""
    return LineDedup(short_repeats=True).marks(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose three-word shingle sets are 85 % alike."""
    return NearDedup(words=3, percent=85).dedup(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and the verdict."""
    return KneserNey().classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("body")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and one whose texts hold the template's own control strings."""
    own = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(own)))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, tokenizer_file(), with_ids=False).drop("text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each different text scanned once."""
    return secret_digest(scan_documents(table(spark, sf_dir, "documents")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document."""
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values."""
    return Decontamination().leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and the verdict of the cross-document line frequency."""
    return quality_rules(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to callable (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_lm_score, op2_line_dedup, op3_minhash_near_dedup, op4_quality_classifier, op5_chat_format, op6_bpe, op7_secret_scan, op8_license_scan, op9_decontamination, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return sql.SQL
