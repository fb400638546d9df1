"""Queries on paints, replacements, matches, extracted items, links and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.geometry import box
from umbra.functions.instruction import GENERAL, sql_folded, sql_test
from umbra.functions.text import SPACE
from umbra.operators import evidence as ev
from umbra.operators.scoring import score_candidates
from umbra.plans import recipes as r
from umbra.plans.scoring_queries import PAGE, TESTS_SQL, prepared


def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.later_paints(*r.drawn(spark, sf_dir), PAGE)


LATER_SQL = f"WITH {r.DRAWN_SQL} SELECT t.page_number, t.operation_index, paint_index FROM texts t JOIN paints p ON p.page_number = t.page_number AND paint_index > t.operation_index"


def _occluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.occlusion(*r.drawn(spark, sf_dir), PAGE)


def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occluded(spark, sf_dir).select("page_number", "operation_index", "later_occlusion_ratio", F.array_join("later_occluder_indices", ",").alias("occluders"))


OCCLUSION_SQL = f"WITH {r.OCCLUDED_SQL} SELECT page_number, operation_index, later_occlusion_ratio, array_to_string(later_occluder_indices, ',') AS occluders FROM occluded"


def replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.replacement_text(_occluded(spark, sf_dir), PAGE).select("page_number", "operation_index", "has_nearby_replacement_text")


REPLACEMENT_SQL = f"""WITH {r.OCCLUDED_SQL}
SELECT page_number, operation_index, c.later_occlusion_ratio >= 0.98 AND len(c.later_occluder_indices) > 0 AND c.height > 0 AND EXISTS (
  SELECT 1 FROM occluded o WHERE o.page_number = c.page_number AND o.operation_index - list_max(c.later_occluder_indices) BETWEEN 1 AND 20
    AND NOT o.hidden_by_clipping AND NOT o.hidden_by_optional_content AND o.rendering_mode <> 3 AND o.fill_alpha > 0.5 AND o.later_occlusion_ratio < 0.5
    AND greatest(c.font_size, o.font_size) > 0 AND least(c.font_size, o.font_size) >= greatest(c.font_size, o.font_size) * 0.85
    AND abs(c.x - o.x) <= greatest(12, c.height * 0.75) AND o.y - (c.y + c.height) BETWEEN c.height * -0.25 AND c.height * 1.5) AS has_nearby_replacement_text
FROM occluded c"""


def redraws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.redraw_groups(_occluded(spark, sf_dir), PAGE).select("page_number", "occluders", F.array_join("members", ",").alias("members"))


TRIMMED = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"
REDRAWS_SQL = f"""WITH {r.OCCLUDED_SQL} SELECT page_number, array_to_string(later_occluder_indices, ',') AS occluders, array_to_string(list_sort(list(operation_index)), ',') AS members
FROM occluded WHERE later_occlusion_ratio >= 0.85 AND len(later_occluder_indices) > 0 AND length({TRIMMED}) + length(regexp_replace({TRIMMED}, '[^\U00010000-\U0010ffff]', '', 'g')) >= 2 GROUP BY page_number, later_occluder_indices"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are the texts again, without those of every seventh part; contrasts by the line's place."""
    texts, _ = r.drawn(spark, sf_dir)
    items = texts.where("box.x % 7 != 3").select("page_number", F.col("text").alias("str"), F.when(F.col("box.y") > 0, F.col("box")).alias("box"), F.when(F.col("box.height") % 4 == 0, F.array(F.lit("#000000"))).otherwise(F.array(F.lit("#ffffff"), F.lit("#000000"))).alias("contrasts"))
    return ev.exact_visible_match(texts, items, PAGE).select("page_number", "operation_index", "has_exact_visible_text_match")


MATCHES_SQL = f"""WITH {r.DRAWN_SQL}, keyed AS (SELECT *, regexp_replace(text, '{SPACE}+', '', 'g') AS key FROM texts),
items AS (SELECT page_number, key, CASE WHEN height % 4 = 0 THEN ['#000000'] ELSE ['#ffffff', '#000000'] END AS contrasts FROM keyed WHERE x % 7 <> 3 AND y > 0 AND key <> ''),
sets AS (SELECT page_number, key, count(*) AS n, list(contrasts) AS all_contrasts FROM items GROUP BY ALL), counts AS (SELECT page_number, key, count(*) AS n FROM keyed WHERE key <> '' GROUP BY ALL)
SELECT k.page_number, k.operation_index, coalesce(fill_color IS NOT NULL AND c.n = s.n AND len(list_filter(all_contrasts, lambda l: NOT list_contains(l, fill_color))) = 0, false) AS has_exact_visible_text_match
FROM keyed k LEFT JOIN counts c ON c.page_number = k.page_number AND c.key = k.key LEFT JOIN sets s ON s.page_number = k.page_number AND s.key = k.key"""


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = r.drawn(spark, sf_dir)
    edges = texts.where("box.x % 5 != 0").select("page_number", "operation_index", (F.col("box.x") / 1024).alias("min_x"), (F.col("box.y") / 1024).alias("min_y"), ((F.col("box.x") + F.col("box.width") - 40) / 1024).alias("max_x"), F.when(F.col("box.y") % 11 != 0, F.col("box.y") / 1024 + 0.25).alias("max_y"))
    b = ev.by_recorded_box(texts.select("page_number", "operation_index", "page_width", "page_height"), edges, PAGE)
    return b.select("page_number", "operation_index", *(F.col(f"recorded_box.{c}").alias(c) for c in ("x", "y", "width", "height")))


RECORDED_SQL = f"""WITH {r.DRAWN_SQL} SELECT page_number, operation_index, CASE WHEN ok THEN x / 1024 * 600 END AS x, CASE WHEN ok THEN y / 1024 * 800 END AS y,
  CASE WHEN ok THEN greatest(0, ((x + width - 40) / 1024 - x / 1024) * 600) END AS width, CASE WHEN ok THEN greatest(0, (y / 1024 + 0.25 - y / 1024) * 800) END AS height
FROM (SELECT *, x % 5 <> 0 AND y % 11 <> 0 AS ok FROM texts)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = r.drawn(spark, sf_dir)
    return texts.select("page_number", F.col("operation_index").alias("item_index"), F.col("text").alias("str"), "box").withColumn("item_index", F.floor(F.col("item_index") / 10).cast("int"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted items are the texts by place; detections are those of high severity."""
    found = score_candidates(prepared(spark, sf_dir)).where("severity = 'high'").select("page_number", "display_text")
    out = ev.extracted_detections(_items(spark, sf_dir), found, PAGE)
    kinds = F.array_join(F.transform("signals", lambda s: s["kind"]), ",")
    return out.select("page_number", "id", "operation_index", "display_text", F.col("box.x").alias("x"), F.col("box.width").alias("width"), "score", "severity", kinds.alias("kinds"))


def _extracted_sql() -> str:
    from umbra.functions import invisible as inv

    squeezed = lambda c: f"lower(regexp_replace({c}, '{SPACE}+', '', 'g'))"
    return f"""WITH {TESTS_SQL}, items AS (SELECT page_number, operation_index // 10 AS item_index, text AS str, x, y, width, height FROM candidates WHERE NOT is_paint),
odd AS (SELECT page_number, item_index, CASE WHEN item_index - lag(item_index) OVER (PARTITION BY page_number ORDER BY item_index) <= 3 THEN 0 ELSE 1 END AS fresh FROM items WHERE regexp_matches(str, '{inv.TAGS}|[{inv.OBFUSCATORS}{inv.DIRECTION}]')),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY page_number ORDER BY item_index) - 1 AS g FROM odd),
spans AS (SELECT page_number, g, min(item_index) AS a, max(item_index) AS b FROM grouped GROUP BY ALL),
reading AS (SELECT s.page_number, g, string_agg(str, '' ORDER BY item_index) AS raw, min(x) FILTER (item_index BETWEEN a AND b) AS x0, max(x + width) FILTER (item_index BETWEEN a AND b) AS x1
  FROM spans s JOIN items i ON i.page_number = s.page_number AND item_index BETWEEN a - 1 AND b + 1 GROUP BY ALL),
{r.inspect_sql('reading', 'raw', 'e_')}, shown0 AS (SELECT page_number, display_text FROM rated WHERE severity = 'high'), {r.inspect_sql('shown0', 'display_text', 'd_')},
shown AS (SELECT DISTINCT page_number, {squeezed('d_semantic')} AS own FROM d_done WHERE length({squeezed('d_semantic')}) >= 2),
fresh AS (SELECT e.*, {sql_test(sql_folded('e_semantic'), GENERAL)} AS told FROM e_done e WHERE (e_has_tags OR e_has_zw OR e_has_bidi) AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.page_number = e.page_number AND s.own = {squeezed('e_semantic')})),
totals AS (SELECT *, least(100, CASE WHEN e_has_tags THEN 50 ELSE 0 END + CASE WHEN e_has_zw THEN 40 ELSE 0 END + CASE WHEN e_has_bidi THEN 35 ELSE 0 END + CASE WHEN told THEN 20 ELSE 0 END) AS score FROM fresh)
SELECT page_number, 'p' || page_number || '-unicode-' || g AS id, (g + 1000000)::INT AS operation_index, substr(e_display, 1, 800) AS display_text, x0 AS x, x1 - x0 AS width, score,
  CASE WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'caution' ELSE 'info' END AS severity,
  concat_ws(',', CASE WHEN e_has_tags THEN 'unicode-tags' END, CASE WHEN e_has_zw THEN 'zero-width-encoding' END, CASE WHEN e_has_bidi THEN 'bidi-control' END, CASE WHEN told THEN 'instruction-language' END) AS kinds FROM totals"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.page_texts(_items(spark, sf_dir), PAGE)


PAGE_TEXTS_SQL = f"WITH {r.DRAWN_SQL} SELECT page_number, string_agg(text, ' ' ORDER BY operation_index) AS page_text FROM texts GROUP BY page_number"


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A link on every page, over all of it, to the page itself or the next; its image is small on every fourth."""
    texts, _ = r.drawn(spark, sf_dir)
    clear = texts.where("text NOT LIKE '%llm%'").withColumn("fill_alpha", F.when(F.col("operation_index") % 2 == 0, 0.0).otherwise(F.col("fill_alpha")))
    target = F.col("page_number") + F.col("page_number") % 2
    said = page_texts(spark, sf_dir).select(F.col("page_number").alias("destination_page"), F.col("page_text").alias("destination_text"))
    pages = clear.select("page_number").distinct().select("page_number", F.col("page_number").alias("link_id"), target.alias("destination_page"))
    whole = box(F.lit(-100), F.lit(-100), F.lit(900), F.lit(1100))
    links = pages.join(said, "destination_page").withColumn("box", whole)
    images = pages.select("page_number", F.when(F.col("page_number") % 4 != 0, box(F.lit(-90), F.lit(-100), F.lit(900), F.lit(1100))).otherwise(box(F.lit(0), F.lit(0), F.lit(50), F.lit(50))).alias("box"))
    return clear, images, links


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.preview_groups(*_links(spark, sf_dir), PAGE).select("page_number", "link_id", "destination_page", F.array_join("operation_indices", ",").alias("operations"))


def _previews_cte() -> str:
    from umbra.functions import invisible as inv

    plain = lambda c: f"lower(regexp_replace({c}, '(?:{SPACE}|[\\pP\\pS])+', '', 'g'))"
    return f"""{r.DRAWN_SQL}, clear AS (SELECT * EXCLUDE (fill_alpha), CASE WHEN operation_index % 2 = 0 THEN 0.0 ELSE fill_alpha END AS fill_alpha, {TRIMMED} AS trimmed FROM texts WHERE text NOT LIKE '%llm%'),
said AS (SELECT page_number, string_agg(text, ' ' ORDER BY operation_index) AS page_text FROM texts GROUP BY page_number),
links AS (SELECT DISTINCT c.page_number, c.page_number + c.page_number % 2 AS destination_page, page_text FROM clear c JOIN said s ON s.page_number = c.page_number + c.page_number % 2 WHERE c.page_number % 4 <> 0),
inside AS (SELECT l.*, operation_index, trimmed FROM links l JOIN clear c USING (page_number) WHERE fill_alpha <= 0.01 AND rendering_mode <> 3 AND NOT hidden_by_clipping AND NOT hidden_by_optional_content AND NOT regexp_matches(text, '{inv.TAGS}|[{inv.OBFUSCATORS}{inv.DIRECTION}]')),
joined AS (SELECT page_number, destination_page, page_text, list(operation_index ORDER BY operation_index) AS ops, string_agg(trimmed, ' ' ORDER BY operation_index) AS said FROM inside GROUP BY ALL HAVING count(*) >= 2),
groups AS (SELECT * FROM joined WHERE NOT {sql_test(sql_folded('said'), GENERAL)} AND length({plain('said')}) >= 16 AND contains({plain('page_text')}, {plain('said')}))"""


PREVIEWS_SQL = f"WITH {_previews_cte()} SELECT page_number, page_number AS link_id, destination_page, array_to_string(ops, ',') AS operations FROM groups"


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections are the clear texts of small size; those suppressed come back if the linked page is odd."""
    clear, images, links = _links(spark, sf_dir)
    groups = ev.preview_groups(clear, images, links, PAGE).withColumn("doc", F.lit(0))
    rows = clear.withColumn("doc", F.lit(0))
    found = rows.where("font_size <= 9").select("doc", "page_number", "operation_index", F.concat_ws("-", "page_number", "operation_index").alias("id"))
    return ev.kept_detections(found, rows, groups, ["doc", "page_number"], ["doc"]).select("page_number", "operation_index", "id")


def _fallback_sql() -> str:
    from umbra.functions import invisible as inv

    return f"""WITH {_previews_cte()}, found AS (SELECT page_number, operation_index, page_number || '-' || operation_index AS id FROM clear WHERE font_size <= 9),
gone AS (SELECT DISTINCT page_number, destination_page, unnest(ops) AS operation_index FROM groups),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.page_number = f.page_number AND g.operation_index = f.operation_index)),
odd AS (SELECT page_number FROM clear WHERE fill_alpha <= 0.15 OR rendering_mode = 3 OR hidden_by_clipping OR hidden_by_optional_content OR regexp_matches(text, '{inv.TAGS}|[{inv.OBFUSCATORS}{inv.DIRECTION}]') UNION SELECT page_number FROM kept)
SELECT * FROM kept UNION SELECT f.* FROM found f JOIN gone g USING (page_number, operation_index) WHERE g.destination_page IN (SELECT page_number FROM odd)"""


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = r.drawn(spark, sf_dir)
    c = F.col("operation_index")
    links = texts.select(
        F.floor(F.col("page_number") / 100).alias("doc_id"), "page_number", c.alias("ord"), F.when(c % 5 == 0, "Widget").otherwise("Link").alias("subtype"),
        F.when(c % 7 == 0, F.array(F.lit(1.0))).when(c % 11 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(None), F.lit(3.0))).otherwise(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))).alias("rect"),
        (F.col("page_number") + c % 90 - 45).alias("dest_page"), F.when(c % 13 == 0, "http://x").alias("url"), F.when(c % 17 == 0, "http://y").alias("unsafe_url"),
    )
    pages = links.select("doc_id", "page_number").distinct()
    return ev.link_destinations(links, pages, ["doc_id"]).select("doc_id", "page_number", "ord", "dest_page")


DESTINATIONS_SQL = f"""WITH {r.DRAWN_SQL}, l AS (SELECT page_number // 100 AS doc_id, page_number, operation_index AS ord, page_number + operation_index % 90 - 45 AS dest_page FROM texts)
SELECT doc_id, page_number, ord, dest_page FROM l JOIN (SELECT doc_id, max(page_number) AS last FROM l GROUP BY doc_id) USING (doc_id)
WHERE ord % 5 <> 0 AND ord % 7 <> 0 AND ord % 11 <> 0 AND ord % 13 <> 0 AND ord % 17 <> 0 AND dest_page BETWEEN 1 AND last"""

QUERIES = {
    "j1_recorded_boxes": (recorded, RECORDED_SQL),
    "j2_later_paints": (later, LATER_SQL),
    "j3_occlusion": (occlusion, OCCLUSION_SQL),
    "j4_replacement_text": (replacement, REPLACEMENT_SQL),
    "j5_exact_visible_match": (matches, MATCHES_SQL),
    "j6_link_destinations": (destinations, DESTINATIONS_SQL),
    "j7_page_texts": (page_texts, PAGE_TEXTS_SQL),
    "x7_redraw_groups": (redraws, REDRAWS_SQL),
    "u7_extracted_unicode": (extracted, _extracted_sql()),
    "d1_preview_groups": (previews, PREVIEWS_SQL),
    "d3_preview_fallback": (fallback, _fallback_sql()),
}
