"""Queries on the drawing fold, small predicates and text normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.functions import invisible as inv
from umbra.functions.text import SPACE, comparable, nfkc, squeeze
from umbra.operators.drawing import interpret
from umbra.operators.evidence import auxiliary_only
from umbra.operators.scoring import compact_identifier, score_candidates
from umbra.plans import recipes as r
from umbra.plans.scoring_queries import TESTS_SQL, prepared
from umbra.tables import table


def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order draws one text in its own state, some on a layer that is off, some clipped, some in a form."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    j = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    q = F.col("l_quantity").cast("int")
    glyph = j('[[{"unicode": "w", "width": ', q * 10, '}, -', n * 100, ', {"unicode": "', p % 10, '", "width": 500}]]')
    ops = [
        ("save", "[]"), ("transform", j("[2, 0, 0, 2, ", p % 100, ", ", s, "]")), ("setGState", j('[[["ca", ', F.when(p % 3 == 0, "0.125").otherwise("1"), "]]]")),
        ("setFillRGBColor", j("[", p % 256, ", ", s % 256, ", 2]")), ("clip", "[]"), ("constructPath", j('["endPath", null, [0, 0, ', F.when(p % 7 == 0, "0").otherwise("9"), ", 9]]")),
        ("beginMarkedContentProps", j('["OC", "', F.when(s % 4 == 0, "off").otherwise("on"), '"]')), ("beginText", "[]"), ("setFont", j('["F", -', n, "]")), ("setHScale", F.when(p % 5 == 0, "[50]").otherwise("[100]")),
        ("setTextRenderingMode", F.when(p % 11 == 0, "[3]").otherwise("[0]")), ("setLeadingMoveText", j("[3, -", n, "]")), ("nextLine", "[]"), ("showText", glyph), ("showText", glyph),
        ("endMarkedContent", "[]"), ("restore", "[]"), ("paintImageXObject", "[]"),
    ]
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = t.withColumns({"line": line, "doc_id": F.lit(0), "page_number": F.col("l_orderkey")}).withColumn("operation_index", (F.col("line") * 100).cast("int"))
    at = lambda k: (F.col("line") * 100 + k).cast("int").alias("operation_index")
    run = F.array(*(F.struct(at(k), F.lit(f).alias("fn"), (a if not isinstance(a, str) else F.lit(a)).alias("args")) for k, (f, a) in enumerate(ops)))
    layers = spark.sql("SELECT 0 AS doc_id, 'off' AS layer, false AS visible")
    e = interpret(rows, ["doc_id", "page_number"], layers, run)
    return e.select("page_number", "operation_index", "kind", "text", "advance", "font_size", "horizontal_scale", F.col("ctm")[4].alias("e"), F.col("ctm")[0].alias("a"), "text_x", "text_y", "fill_color", "fill_alpha", "rendering_mode", "hidden_by_clipping", "hidden_by_optional_content")


FOLD_SQL = """WITH l AS (SELECT l_orderkey AS page_number, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line FROM lineitem),
t AS (SELECT *, (q * 10 + 500 + n * 100) / 1000 AS adv FROM l)
SELECT page_number, (line * 100 + 13 + k)::INT AS operation_index, 'text' AS kind, 'w' || (p % 10) AS text, adv AS advance, n::DOUBLE AS font_size, CASE WHEN p % 5 = 0 THEN 50.0 ELSE 100.0 END::DOUBLE AS horizontal_scale, (p % 100)::DOUBLE AS e, 2.0::DOUBLE AS a,
  3 + k * (adv * n * (CASE WHEN p % 5 = 0 THEN 50 ELSE 100 END) / 100) AS text_x, 0.0::DOUBLE AS text_y, '#' || CASE WHEN greatest(p % 256, s % 256, 2) > 1 THEN printf('%02x%02x02', p % 256, s % 256) END AS fill_color,
  CASE WHEN p % 3 = 0 THEN 0.125 ELSE 1.0 END::DOUBLE AS fill_alpha, CASE WHEN p % 11 = 0 THEN 3 ELSE 0 END AS rendering_mode, p % 7 = 0 AS hidden_by_clipping, s % 4 = 0 AS hidden_by_optional_content
FROM t, range(2) AS r(k)
UNION ALL SELECT page_number, (line * 100 + 17)::INT, 'image', NULL, NULL, 0, 100, 0, 1, 0, 0, '#000000', 1, 0, false, false FROM t"""


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.candidates(spark, sf_dir).select("page_number", "operation_index", compact_identifier(F.col("text")).alias("compact_identifier"))


def auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.candidates(spark, sf_dir).select("page_number", "operation_index", auxiliary_only().alias("auxiliary_only"))


AUXILIARY_SQL = f"WITH {r.CANDIDATES_SQL} SELECT page_number, operation_index, fill_alpha <= 0.01 AND rendering_mode <> 3 AND NOT hidden_by_clipping AND NOT hidden_by_optional_content AND NOT regexp_matches(text, '{inv.TAGS}|[{inv.OBFUSCATORS}{inv.DIRECTION}]') AS auxiliary_only FROM candidates"


def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nfkc(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", squeeze(t).alias("squeezed"), comparable(t).alias("comparable"))


NORMAL_SQL = f"SELECT doc_id, regexp_replace(text, '{SPACE}+', '', 'g') AS squeezed, lower(regexp_replace(text, '(?:{SPACE}|[\\pP\\pS])+', '', 'g')) AS comparable FROM documents"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings and their score, by a hundred pages."""
    found = score_candidates(prepared(spark, sf_dir))
    return found.groupBy(F.floor(F.col("page_number") / 100).alias("document")).agg(F.count("*").alias("n_findings"), F.sum("score").alias("sum_score"), F.max("score").alias("max_score"))


FINDINGS_SQL = f"WITH {TESTS_SQL} SELECT page_number // 100 AS document, count(*) AS n_findings, sum(score)::BIGINT AS sum_score, max(score) AS max_score FROM rated GROUP BY 1"

QUERIES = {
    "p1_p20_drawing_fold": (fold, FOLD_SQL),
    "f3_compact_identifier": (identifiers, f"WITH {TESTS_SQL} SELECT page_number, operation_index, coded AS compact_identifier FROM joined"),
    "f5_auxiliary_only": (auxiliary, AUXILIARY_SQL),
    "f12_normal_texts": (normal_texts, NORMAL_SQL),
    "a5_total_findings": (findings, FINDINGS_SQL),
}
