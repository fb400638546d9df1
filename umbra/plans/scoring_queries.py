"""Queries on candidate scoring, one for each signal and for what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.instruction import GENERAL, STRONG, sql_folded, sql_test
from umbra.functions.text import SPACE
from umbra.operators import scoring
from umbra.plans.recipes import CANDIDATES_SQL, candidates, inspect_sql

PAGE = ["page_number"]


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their context and their page's usual size."""
    rows = scoring.instruction_context(candidates(spark, sf_dir), PAGE)
    usual = scoring.median_font_size(rows, PAGE)
    return rows.join(usual, PAGE)


TRIM = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"
CONTEXT_SQL = f"""
{CANDIDATES_SQL}, breaks AS (
  SELECT *, CASE WHEN operation_index - lag(operation_index) OVER w BETWEEN 1 AND 12 AND fill_color IS NOT DISTINCT FROM lag(fill_color) OVER w AND abs(fill_alpha - lag(fill_alpha) OVER w) <= 0.1
      AND rendering_mode = lag(rendering_mode) OVER w AND greatest(font_size, lag(font_size) OVER w) > 0 AND least(font_size, lag(font_size) OVER w) >= greatest(font_size, lag(font_size) OVER w) * 0.8 THEN 0 ELSE 1 END AS fresh
  FROM candidates WINDOW w AS (PARTITION BY page_number ORDER BY operation_index)
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY page_number ORDER BY operation_index ROWS UNBOUNDED PRECEDING) AS run, {TRIM} AS trimmed FROM breaks
), contexts AS (
  SELECT *, substr(array_to_string(list_concat(list(trimmed) OVER (PARTITION BY page_number, run ORDER BY operation_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    coalesce(list(trimmed) OVER (PARTITION BY page_number, run ORDER BY operation_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), []))[1:5], ' '), 1, 800) AS instruction_context FROM runs
), usual AS (
  SELECT page_number, coalesce(median(font_size) FILTER (fill_alpha > 0.5 AND rendering_mode <> 3 AND font_size > 0), 0) AS median_font_size FROM candidates GROUP BY page_number
), prepared AS (SELECT * FROM contexts JOIN usual USING (page_number))"""

#: Distinct texts and contexts are inspected once.
TESTS_SQL = f"""
{CONTEXT_SQL}, said AS (SELECT DISTINCT t FROM (SELECT text AS t FROM prepared UNION ALL SELECT instruction_context FROM prepared)),
{inspect_sql('said', 't', 'u_')}, known AS (
  SELECT t, u_has_tags, u_has_zw, u_has_bidi, u_display, {sql_test(sql_folded('u_semantic'), GENERAL)} AS told, {sql_test(sql_folded('u_semantic'), STRONG)} AS strong FROM u_done
), joined AS (
  SELECT p.*, k.u_has_tags, k.u_has_zw, k.u_has_bidi, k.u_display, c.told, c.strong, length(trimmed) AS len,
    sqrt((('0x' || fill_color[2:3])::INT - shade) ** 2 + (('0x' || fill_color[4:5])::INT - shade) ** 2 + (('0x' || fill_color[6:7])::INT - shade) ** 2) AS distance,
    least(horizontal_scale / 100, transform_scale_ratio, CASE WHEN geometry_reliable OR c.told THEN glyph_width_ratio ELSE 1.0 END) AS ratio,
    (x + width <= 0 OR y + height <= 0 OR x >= page_width OR y >= page_height) AS outside,
    greatest(0, least(page_width, x + width) - greatest(0, x)) * greatest(0, least(page_height, y + height) - greatest(0, y)) / greatest(1, width * height) AS shown,
    length(regexp_replace(p.text, '[^0-9]', '', 'g')) >= 4 AND (regexp_matches(p.text, '(?i)(?:reference|ref\\.?|invoice|id|no\\.?|number|番号|コード)') OR regexp_matches(p.text, '[A-Z0-9][A-Z0-9._/-]{{7,}}')) AS coded
  FROM prepared p JOIN known k ON k.t = p.text JOIN known c ON c.t = p.instruction_context
), tests AS (
  SELECT *,
    CASE WHEN distance < 28 AND len >= 2 AND surrounding_confidence >= 0.55 AND declared_ink_ratio > 0.72 AND (geometry_reliable OR told OR (font_size <= 3 AND has_recorded_box))
      AND NOT (NOT geometry_reliable AND regexp_matches(trimmed, '^[0-9]{{1,4}}$')) AND NOT has_exact_visible_text_match AND later_occlusion_ratio < 0.98 THEN 35 ELSE 0 END AS k1,
    CASE WHEN len >= 4 AND median_font_size > 0 AND font_size > 0 AND font_size < CASE WHEN strong THEN 8 ELSE 3 END AND (geometry_reliable OR height <= 18) AND font_size < median_font_size * 0.35 THEN 20 ELSE 0 END AS k2,
    CASE WHEN len >= 2 AND ratio < 0.35 AND NOT (ratio >= 0.18 AND coded AND NOT strong) THEN 25 ELSE 0 END AS k3,
    CASE WHEN len >= 8 AND outside THEN 30 WHEN len >= 8 AND shown < 0.5 THEN 25 ELSE 0 END AS k4,
    CASE WHEN rendering_mode = 3 THEN 50 WHEN fill_alpha <= 0.15 AND told THEN 35 ELSE 0 END AS k5,
    CASE WHEN hidden_by_clipping AND len >= 4 THEN 50 ELSE 0 END AS k6, CASE WHEN hidden_by_optional_content AND len >= 4 THEN 50 ELSE 0 END AS k7,
    CASE WHEN NOT (has_nearby_replacement_text AND later_occlusion_ratio >= 0.98 AND occlusion_change_ratio < 0.5 AND font_size >= 6 AND NOT strong)
      AND ((len >= 4 AND later_occlusion_ratio >= 0.98 AND occlusion_change_ratio >= 0.985 AND coalesce(declared_ink_ratio <= 0.01 OR declared_ink_ratio >= 0.9, false))
        OR (later_occlusion_ratio >= 0.9 AND occlusion_change_ratio >= 0.2 AND told)) THEN 40 ELSE 0 END AS k8
  FROM joined
), scored AS (
  SELECT *, k1 + k2 + k3 + k5 + k6 + k7 + k8 + CASE WHEN u_has_tags THEN 50 ELSE 0 END + CASE WHEN u_has_zw THEN 40 ELSE 0 END + CASE WHEN u_has_bidi THEN 35 ELSE 0 END AS alone FROM tests
), detections AS (
  SELECT *, 'p' || page_number || '-op' || operation_index AS id, least(100, alone + k4 + CASE WHEN told THEN 20 ELSE 0 END) AS score,
    CASE WHEN u_has_tags OR u_has_zw OR u_has_bidi THEN substr(u_display, 1, 800) ELSE trimmed END AS display_text FROM scored WHERE alone > 0 OR (k4 > 0 AND told)
), rated AS (SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'caution' ELSE 'info' END AS severity FROM detections)"""


def _signal(kind: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = scoring.with_language(prepared(spark, sf_dir))
        test, score = scoring.tests(F.col)[kind]
        return df.select("page_number", "operation_index", F.when(test, score).otherwise(0).alias("score"))

    return run, f"WITH {TESTS_SQL} SELECT page_number, operation_index, {name} AS score FROM tests"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections with their signals in order."""
    df = scoring.score_candidates(prepared(spark, sf_dir))
    kinds = F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["kind"], s["score"])), ",")
    return df.select("page_number", "operation_index", "id", "display_text", "score", "severity", kinds.alias("signals"))


SCORED_SQL = f"""WITH {TESTS_SQL} SELECT page_number, operation_index, id, display_text, score, severity,
  concat_ws(',', CASE WHEN u_has_tags THEN 'unicode-tags:50' END, CASE WHEN u_has_zw THEN 'zero-width-encoding:40' END, CASE WHEN u_has_bidi THEN 'bidi-control:35' END,
    CASE WHEN k1 > 0 THEN 'low-contrast:' || k1 END, CASE WHEN k2 > 0 THEN 'tiny-text:' || k2 END, CASE WHEN k3 > 0 THEN 'compressed-text:' || k3 END, CASE WHEN k4 > 0 THEN 'edge-or-outside:' || k4 END,
    CASE WHEN k5 > 0 THEN 'transparent-text:' || k5 END, CASE WHEN k6 > 0 THEN 'clipped-text:' || k6 END, CASE WHEN k7 > 0 THEN 'hidden-layer:' || k7 END, CASE WHEN k8 > 0 THEN 'occluded-text:' || k8 END,
    CASE WHEN told THEN 'instruction-language:20' END) AS signals FROM rated"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.instruction_context(candidates(spark, sf_dir), PAGE).select("page_number", "operation_index", "instruction_context")


def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.median_font_size(candidates(spark, sf_dir), PAGE)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity counts; a hundred pages count as a document."""
    found = scoring.score_candidates(prepared(spark, sf_dir)).withColumn("document", F.floor(F.col("page_number") / 100))
    return scoring.severity_summary(found, ["document"])


SUMMARY_SQL = f"""WITH {TESTS_SQL} SELECT page_number // 100 AS document, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'caution') AS n_caution,
  count(*) FILTER (severity = 'info') AS n_info, count(*) AS n_findings FROM rated GROUP BY 1"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.score_candidates(prepared(spark, sf_dir)).withColumn("is_extracted", F.lit(False)).withColumn("document", F.floor(F.col("page_number") / 100))
    return scoring.ranked(found, PAGE)


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("page_number", "operation_index", "score", "rank")


RANK = "row_number() OVER (PARTITION BY page_number ORDER BY score DESC, operation_index)::INT AS rank"
ORDER_SQL = f"WITH {TESTS_SQL} SELECT page_number, operation_index, score, {RANK} FROM rated"


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.page_navigation(_ranked(spark, sf_dir), ["document"])


NAVIGATION_SQL = f"""WITH {TESTS_SQL}, ranks AS (SELECT page_number // 100 AS document, page_number, operation_index, {RANK} FROM rated),
pages AS (SELECT document, page_number, min_by(operation_index, rank) AS first_operation, count(*) AS n_findings FROM ranks GROUP BY ALL)
SELECT *, coalesce(lead(page_number) OVER w, first_value(page_number) OVER (PARTITION BY document ORDER BY page_number)) AS next_page,
  coalesce(lag(page_number) OVER w, first_value(page_number) OVER (PARTITION BY document ORDER BY page_number DESC)) AS previous_page
FROM pages WINDOW w AS (PARTITION BY document ORDER BY page_number)"""

SIGNALS = (
    ("k1_low_contrast", "low-contrast", "k1"), ("k2_tiny_text", "tiny-text", "k2"), ("k3_compressed_text", "compressed-text", "k3"), ("k4_edge_or_outside", "edge-or-outside", "k4"),
    ("k5_transparent_text", "transparent-text", "k5"), ("k6_clipped_text", "clipped-text", "k6"), ("k7_hidden_layer", "hidden-layer", "k7"), ("k8_occluded_text", "occluded-text", "k8"),
)

QUERIES = {name: _signal(kind, k) for name, kind, k in SIGNALS} | {
    "k12_k16_detections": (scored, SCORED_SQL),
    "w1_instruction_context": (context, f"WITH {CONTEXT_SQL} SELECT page_number, operation_index, instruction_context FROM contexts"),
    "a1_median_font_size": (median, f"WITH {CONTEXT_SQL} SELECT * FROM usual"),
    "a3_severity_summary": (summary, SUMMARY_SQL),
    "o1_ranked_detections": (order, ORDER_SQL),
    "f13_page_navigation": (navigation, NAVIGATION_SQL),
}
