"""A corpus pipeline of five training-text operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.bpe import encode_documents
from umbra.llm.common import stored, table
from umbra.llm.decontaminate import Decontamination
from umbra.llm.line_dedup import LineDedup
from umbra.llm.near_dedup import NearDedup
from umbra.llm.quality_classifier import KneserNey
from umbra.llm.queries import tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not above the limit of their language."""
    return KneserNey().keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those with nothing left go."""
    had = docs.withColumn("__had", F.rlike("text", F.lit(r"\S")))
    left = LineDedup(short_repeats=True).dedup(had).withColumn("n_chars", F.length("text").cast("long"))
    return left.where(~F.coalesce("__had", F.lit(False)) | F.rlike("text", F.lit(r"\S"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return NearDedup().keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return Decontamination().clean(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and the digest of what they decode to."""
    coded = encode_documents(docs, tokenizer_file())
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-pair encoding", bpe),
]

#: The first and last stage cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
