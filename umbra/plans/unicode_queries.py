"""Queries on invisible Unicode and instruction wording, over documents with evidence put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.instruction import GENERAL, STRONG, folded, has_instruction, has_strong_instruction, sql_folded, sql_test
from umbra.functions.invisible import contains_invisible, inspect
from umbra.functions.text import where_once
from umbra.operators.scoring import severity, total
from umbra.plans.recipes import INJECTED_SQL, injected, inspect_sql
from umbra.tables import table

_BASE = f"WITH {INJECTED_SQL}, {inspect_sql('injected', 't', 'u_')}"


def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(injected(spark, sf_dir), "t")


def _picked(*columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _inspected(spark, sf_dir).select("doc_id", *(F.col("u_" + c).alias(c) for c in columns))

    return run, f"{_BASE} SELECT doc_id, {', '.join(f'u_{c} AS {c}' for c in columns)} FROM u_done"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity summary by language: inspection, wording of the semantic text, score, counts."""
    df = _inspected(spark, sf_dir)
    told = F.when((F.size("u_signals") > 0) & has_instruction(folded(F.col("u_semantic"))), F.array(F.struct(F.lit("instruction-language").alias("kind"), F.lit(20).alias("score")))).otherwise(F.array().cast("array<struct<kind:string,score:int>>"))
    df = where_once(df.withColumn("score", total(F.concat("u_signals", told))), F.col("score") > 0).withColumn("severity", severity(F.col("score")))
    return df.groupBy("lang", "severity").agg(F.count("*").alias("n"), F.sum("score").alias("sum_score"), F.sum("u_tag_count").alias("tag_letters"), F.sum(F.length("u_display")).alias("display_chars"))


FLAGSHIP_SQL = f"""{_BASE}, scored AS (
  SELECT *, CASE WHEN u_has_tags THEN 50 ELSE 0 END + CASE WHEN u_has_zw THEN 40 ELSE 0 END + CASE WHEN u_has_bidi THEN 35 ELSE 0 END AS base,
    {sql_test(sql_folded('u_semantic'), GENERAL)} AS told FROM u_done
), totals AS (SELECT *, least(100, base + CASE WHEN base > 0 AND told THEN 20 ELSE 0 END) AS score FROM scored WHERE base > 0)
SELECT lang, CASE WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'caution' ELSE 'info' END AS severity, count(*) AS n, sum(score)::BIGINT AS sum_score, sum(u_tag_count)::BIGINT AS tag_letters, sum(length(u_display))::BIGINT AS display_chars
FROM totals GROUP BY ALL"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(spark, sf_dir).select("doc_id", F.array_join(F.transform("u_signals", lambda s: F.concat_ws(":", s["kind"], s["score"])), ",").alias("signals"))


SIGNALS_SQL = f"""{_BASE} SELECT doc_id, concat_ws(',', CASE WHEN u_has_tags THEN 'unicode-tags:50' END, CASE WHEN u_has_zw THEN 'zero-width-encoding:40' END, CASE WHEN u_has_bidi THEN 'bidi-control:35' END) AS signals FROM u_done"""


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).select("doc_id", contains_invisible(F.col("t")).alias("invisible"))


def _gate_sql() -> str:
    from umbra.functions import invisible as inv

    return f"WITH {INJECTED_SQL} SELECT doc_id, regexp_matches(t, '{inv.TAGS}|[{inv.OBFUSCATORS}{inv.DIRECTION}]') AS invisible FROM injected"


def instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction wording in whole documents with phrases put in."""
    df = injected(spark, sf_dir).withColumn("f", folded(F.col("t")))
    return df.select("doc_id", has_instruction(F.col("f")).alias("instruction"), has_strong_instruction(F.col("f")).alias("strong"))


INSTRUCTION_SQL = f"WITH {INJECTED_SQL}, f AS (SELECT doc_id, {sql_folded('t')} AS f FROM injected) SELECT doc_id, {sql_test('f', GENERAL)} AS instruction, {sql_test('f', STRONG)} AS strong FROM f"


def _plain(name: str, key: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).where(has_instruction(folded(F.col(text)))).groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum(key), F.lit(0)).alias("keys"))

    return run, f"SELECT count(*) AS n, coalesce(sum({key}), 0)::BIGINT AS keys FROM {name} WHERE {sql_test(sql_folded(text), GENERAL)}"


QUERIES = {
    "flagship_unicode_severity": (flagship, FLAGSHIP_SQL),
    "u1_tag_runs": _picked("tag_count", "tag_decoded"),
    "u2_zero_width": _picked("zw_count", "zw_longest"),
    "u3_zero_width_decode": _picked("zw_decoded"),
    "u4_bidi": _picked("bidi_count", "bidi_overrides", "bidi_unbalanced"),
    "u5_semantic_text": _picked("semantic"),
    "u6_display_text": _picked("display"),
    "k9_k11_unicode_signals": (signals, SIGNALS_SQL),
    "f2_invisible_gate": (gate, _gate_sql()),
    "instruction_language": (instruction, INSTRUCTION_SQL),
    "instruction_pages": _plain("pages", "page_id", "html"),
    "instruction_conversations": _plain("conversations", "conv_id", "text"),
}
