"""Queries on boxes, matrices, colours, sampled pixels, properties and text streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import geometry as g
from umbra.functions.instruction import GENERAL, sql_folded, sql_test
from umbra.operators import pixels, properties, text_content
from umbra.plans import recipes as r
from umbra.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lineitem and two boxes: a, and b, which is null on every ninth part."""
    t = table(spark, sf_dir, "lineitem")
    p, s, n, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity")
    b = F.when(p % 9 != 0, g.box(p % 100 + n, s % 100, q * 2 + n, n * 3))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", g.box(p % 100, s % 100 + 1, q * 2, n * 4 - 4).alias("a"), b.alias("b"))


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINES = f"""lines AS (SELECT {KEYS}, p % 100 AS ax, s % 100 + 1 AS ay, q * 2 AS aw, (n * 4 - 4)::DOUBLE AS ah, CASE WHEN p % 9 <> 0 THEN p % 100 + n END AS bx, s % 100 AS bb, q * 2 + n AS bw, (n * 3)::DOUBLE AS bh, p, s, n, q
  FROM (SELECT *, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity AS q FROM lineitem)),
boxes AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, bb + bh) - greatest(ay, bb)) AS meet FROM lines)"""
_KEYS = KEYS.split(", ")


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_KEYS, g.agree(F.col("b"), F.col("a")).alias("agrees"))


AGREEMENT_SQL = f"""WITH {LINES} SELECT {KEYS}, coalesce(bx IS NOT NULL AND aw * ah > 0 AND bw * bh > 0 AND meet / least(aw * ah, bw * bh) >= 0.5 AND least(aw, bw) / greatest(aw, bw) >= 0.5 AND least(ah, bh) / greatest(ah, bh) >= 0.5, false) AS agrees FROM boxes"""


def coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.coalesce("b", "a")
    e = g.expanded(a)
    return _lines(spark, sf_dir).select(*_KEYS, g.area(a).alias("area"), g.intersection(a, b).alias("meet"), g.coverage(a, b).alias("covered"), e["x"].alias("x"), e["width"].alias("width"))


COVERAGES_SQL = f"""WITH {LINES}, m AS (SELECT *, CASE WHEN bx IS NULL THEN aw * ah ELSE meet END AS met, greatest(3, least(aw, ah) * 0.035::DOUBLE) AS by_ FROM boxes)
SELECT {KEYS}, aw * ah AS area, met AS meet, CASE WHEN aw * ah > 0 THEN met / (aw * ah) ELSE 0 END AS covered, ax - by_ AS x, aw + by_ * 2 AS width FROM m"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along (3, 4), (-4, 3) or no direction, of boxes of which some are tall."""
    n = F.col("l_linenumber") % 3
    pick = lambda a, b, c: F.when(n == 0, a).when(n == 1, b).otherwise(c).cast("double")
    tall = g.box(F.lit(0), F.lit(0), F.col("a.height") + 1, F.col("a.width"))
    return _lines(spark, sf_dir).select(*_KEYS, g.extent_along(tall, pick(3, 0, 5), pick(4, 0, 0)).alias("extent"))


EXTENTS_SQL = f"""WITH {LINES}, e AS (SELECT *, ah + 1 AS w, aw AS h, CASE n % 3 WHEN 0 THEN (3 * (ah + 1) + 4 * aw) / 5 WHEN 2 THEN 5 * (ah + 1) / 5 END AS projected FROM lines)
SELECT {KEYS}, CASE WHEN projected IS NULL THEN w WHEN h >= w * 2.5 AND projected < h * 0.5 THEN h ELSE projected END AS extent FROM e"""


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box under the product of a viewport and a text matrix, and the box of an extracted item."""
    d = lambda *v: F.array(*((x if not isinstance(x, (int, float)) else F.lit(x)).cast("double") for x in v))
    view = d(1.5, 0, 0, -1.5, 0, 800)
    own = d(F.col("l_linenumber"), 0, 0, F.col("l_linenumber") * 2, F.col("a.x"), F.col("a.y"))
    rows = _lines(spark, sf_dir).select(*_KEYS, g.transform_box(g.multiply(view, own), F.col("a")).alias("t"), g.text_item_box(view, own, F.col("a.width") - 20).alias("i"))
    return rows.select(*_KEYS, *(F.col(f"t.{c}").alias(f"t_{c}") for c in ("x", "y", "width", "height")), *(F.col(f"i.{c}").alias(f"i_{c}") for c in ("x", "y", "width", "height")))


MATRICES_SQL = f"""WITH {LINES} SELECT {KEYS}, 1.5::DOUBLE * n * ax + 1.5::DOUBLE * ax AS t_x, -3.0::DOUBLE * n * (ay + ah) + (-1.5::DOUBLE * ay + 800) AS t_y, 1.5::DOUBLE * n * aw AS t_width, 3.0::DOUBLE * n * ah AS t_height,
  CASE WHEN aw > 20 THEN 1.5::DOUBLE * ax END AS i_x, CASE WHEN aw > 20 THEN -1.5::DOUBLE * ay + 800 - 3.0::DOUBLE * n END AS i_y, CASE WHEN aw > 20 THEN (aw - 20) * 1.5::DOUBLE END AS i_width, CASE WHEN aw > 20 THEN 3.0::DOUBLE * n END AS i_height FROM lines"""


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = g.percent_box(F.col("a"), F.lit(512), F.lit(1024))
    return _lines(spark, sf_dir).select(*_KEYS, *(o[c].alias(c) for c in ("x", "y", "width", "height")))


OVERLAYS_SQL = f"WITH {LINES} SELECT {KEYS}, 100 * ax / 512 AS x, 100 * ay / 1024 AS y, greatest(1, 100 * aw / 512) AS width, greatest(1, 100 * ah / 1024) AS height FROM lines"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours from hex strings and numbers, a pattern's only colour, and their distance."""
    p, s = F.col("p_partkey"), F.col("p_partkey") % 7
    code = F.lpad(F.lower(F.hex(p * 7919 % 16777216)), 6, "0")
    text = F.when(s == 0, F.concat(F.lit("#"), F.substring(code, 1, 3))).when(s == 1, F.lit("transparent")).when(s == 2, F.upper(F.concat(F.lit("#"), code))).when(s == 3, F.lit("red")).otherwise(F.concat(F.lit("#"), code))
    numbers = F.when(s == 0, F.array(p % 3 / 2)).when(s == 1, F.array(p % 256, p % 300 - 20, p % 31).cast("array<double>")).when(s == 2, F.array(p % 2, p % 2, F.lit(1)).cast("array<double>")).otherwise(F.array(p % 5 / 4, p % 9 / 8, F.lit(0.5)))
    rows = table(spark, sf_dir, "part").select("p_partkey", g.hex_colour(text).alias("hex"), g.number_colour(numbers).alias("number"))
    only = g.one_colour(F.array("hex", F.when(F.col("p_partkey") % 2 == 0, F.col("hex")).otherwise(F.col("number"))))
    return rows.select("p_partkey", "hex", "number", only.alias("only"), g.colour_distance(g.channels(F.col("hex")), g.channels(F.col("number"))).alias("distance"))


COLOURS_SQL = """WITH t AS (
  SELECT p_partkey, p_partkey % 7 AS s, lower(printf('%06x', p_partkey * 7919 % 16777216)) AS code FROM part
), h AS (
  SELECT *, CASE s WHEN 0 THEN '#' || code[1] || code[1] || code[2] || code[2] || code[3] || code[3] WHEN 1 THEN '#ffffff' WHEN 3 THEN NULL ELSE '#' || code END AS hex,
    CASE s WHEN 0 THEN [p_partkey % 3 / 2, p_partkey % 3 / 2, p_partkey % 3 / 2] WHEN 1 THEN [p_partkey % 256, p_partkey % 300 - 20, p_partkey % 31] WHEN 2 THEN [p_partkey % 2, p_partkey % 2, 1.0::DOUBLE]
      ELSE [p_partkey % 5 / 4, p_partkey % 9 / 8, 0.5::DOUBLE] END AS v FROM t
), c AS (SELECT *, list_transform(v, lambda x: greatest(0, least(255, floor(x * CASE WHEN list_max(v) > 1 THEN 1.0::DOUBLE ELSE 255.0::DOUBLE END + 0.5::DOUBLE)))::INT) AS w FROM h),
n AS (SELECT p_partkey, hex, printf('#%02x%02x%02x', w[1], w[2], w[3]) AS number, w FROM c)
SELECT p_partkey, hex, number, CASE WHEN p_partkey % 2 = 0 THEN hex WHEN hex IS NULL OR hex = number THEN number END AS only,
  sqrt((('0x' || hex[2:3])::INT - w[1]) ** 2 + (('0x' || hex[4:5])::INT - w[2]) ** 2 + (('0x' || hex[6:7])::INT - w[3]) ** 2)::DOUBLE AS distance FROM n"""


def _raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An 80 by 60 raster for each nation, and ten boxes on each."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("page_number"))
    p = n.crossJoin(spark.range(80 * 60)).select("page_number", (F.col("id") % 80).cast("int").alias("x"), F.floor(F.col("id") / 80).cast("int").alias("y"))
    k = F.col("page_number")
    ink = (F.col("x") * 7 + F.col("y") * 13 + k) % 11 < 4
    tone = lambda f: F.when(ink, (F.col("x") * f + k * 31) % 256).otherwise(240 - k % 3 * 16).cast("int")
    pixel = p.select("page_number", "x", "y", tone(3).alias("r"), tone(5).alias("g"), tone(2).alias("b"), F.when((F.col("x") + F.col("y")) % 17 == 0, 100).otherwise(255).alias("a"))
    i = F.col("id")
    boxes = n.crossJoin(spark.range(10)).select("page_number", i.cast("int").alias("operation_index"), g.box(i * 9 - 5, i * 6 - 4, i * 3 + 4, i + 3).alias("box"), F.when(i % 4 == 3, F.lit(None)).when(i % 2 == 0, "#f0f0f0").otherwise("#203040").alias("fill_color"))
    return pixel, boxes


RASTER = """pixel AS (
  SELECT page_number, x, y, CASE WHEN ink THEN (x * 3 + k * 31) % 256 ELSE 240 - k % 3 * 16 END AS r, CASE WHEN ink THEN (x * 5 + k * 31) % 256 ELSE 240 - k % 3 * 16 END AS g, CASE WHEN ink THEN (x * 2 + k * 31) % 256 ELSE 240 - k % 3 * 16 END AS b, CASE WHEN (x + y) % 17 = 0 THEN 100 ELSE 255 END AS a
  FROM (SELECT *, (x * 7 + y * 13 + k) % 11 < 4 AS ink FROM (SELECT n_nationkey::INT AS page_number, n_nationkey::INT AS k, (id % 80)::INT AS x, (id // 80)::INT AS y FROM nation, range(4800) AS t(id)))
), boxes AS (SELECT n_nationkey::INT AS page_number, id::INT AS operation_index, (id * 9 - 5)::DOUBLE AS bx, (id * 6 - 4)::DOUBLE AS by_, (id * 3 + 4)::DOUBLE AS bw, (id + 3)::DOUBLE AS bh, CASE WHEN id % 4 <> 3 THEN CASE WHEN id % 2 = 0 THEN 240 ELSE 32 END END AS cr, CASE WHEN id % 2 = 0 THEN 240 ELSE 48 END AS cg, CASE WHEN id % 2 = 0 THEN 240 ELSE 64 END AS cb FROM nation, range(10) AS t(id))"""


def surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pixels.surroundings(*_raster(spark, sf_dir), ["page_number"], 80, 60)
    return out.select("page_number", "operation_index", *(F.col(f"surrounding_color.{c}").alias(c) for c in "rgb"), "surrounding_confidence", "declared_ink_ratio")


SURROUNDINGS_SQL = f"""WITH {RASTER}, pad AS (SELECT *, least(14, greatest(4, ceil(bh * 0.75::DOUBLE))) AS pad FROM boxes),
clip AS (SELECT *, greatest(0, floor(bx - pad)) AS l, greatest(0, floor(by_ - pad)) AS t, least(80, ceil(bx + bw + pad)) AS rr, least(60, ceil(by_ + bh + pad)) AS bt FROM pad),
strides AS (SELECT *, greatest(1, floor(sqrt(greatest(0, rr - l) * greatest(0, bt - t) / 3500)))::INT AS stride FROM clip),
met AS (SELECT s.*, p.*, (p.y * 80 + p.x) AS place, p.x >= bx AND p.x <= bx + bw AND p.y >= by_ AND p.y <= by_ + bh AS inside FROM strides s JOIN pixel p ON p.page_number = s.page_number AND p.x >= l AND p.x < rr AND p.y >= t AND p.y < bt AND (p.x - l) % stride = 0 AND (p.y - t) % stride = 0 AND p.a >= 220),
outer_ AS (SELECT page_number, operation_index, r // 16 AS qr, g // 16 AS qg, b // 16 AS qb, count(*) AS n, min(place) AS first FROM met WHERE NOT inside GROUP BY ALL),
top AS (SELECT page_number, operation_index, arg_max({{'r': qr, 'g': qg, 'b': qb, 'n': n}}, n * 1000000 - first) AS d, sum(n) AS total FROM outer_ GROUP BY ALL),
inner_ AS (SELECT page_number, operation_index, CASE WHEN any_value(cr) IS NOT NULL THEN avg(CASE WHEN (r - cr) ** 2 + (g - cg) ** 2 + (b - cb) ** 2 < 3025 THEN 1.0 ELSE 0.0 END) END AS ink FROM met WHERE inside GROUP BY ALL)
SELECT b.page_number, b.operation_index, d.r * 16 + 8 AS r, d.g * 16 + 8 AS g, d.b * 16 + 8 AS b, coalesce(d.n / total, 0) AS surrounding_confidence, ink AS declared_ink_ratio
FROM boxes b LEFT JOIN top USING (page_number, operation_index) LEFT JOIN inner_ USING (page_number, operation_index)"""


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.strong_contrast(*_raster(spark, sf_dir), ["page_number"], 80, 60)


_SPOT = """spot AS (SELECT *, greatest(0, floor(bx)) AS l, greatest(0, floor(by_)) AS t FROM boxes), size AS (SELECT *, least(80 - l, greatest(1, ceil(bw))) AS w, least(60 - t, greatest(1, ceil(bh))) AS h FROM spot),
strides AS (SELECT *, greatest(1, floor(sqrt(w * h / 3000)))::INT AS stride FROM size)"""
_MET = "p.page_number = s.page_number AND p.x >= l AND p.x < l + w AND p.y >= t AND p.y < t + h AND (p.x - l) % stride = 0 AND (p.y - t) % stride = 0"
CONTRASTS_SQL = f"""WITH {RASTER}, {_SPOT}, met AS (SELECT s.page_number, operation_index, count(*) AS n, count(*) FILTER ((r - cr) ** 2 + (g - cg) ** 2 + (b - cb) ** 2 >= 4900) AS k FROM strides s JOIN pixel p ON {_MET} AND p.a >= 220 GROUP BY ALL)
SELECT b.page_number, b.operation_index, coalesce(k >= 8 AND k / n >= 0.4, false) AS strong_contrast FROM boxes b LEFT JOIN met USING (page_number, operation_index)"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the raster without its first rows of ink."""
    base, boxes = _raster(spark, sf_dir)
    again = base.withColumn("r", F.when(F.col("x") % 5 < 2, F.lit(0)).otherwise(F.col("r")))
    return pixels.redraw_difference(base, again, boxes, ["page_number"], 80, 60)


DIFFERENCES_SQL = f"""WITH {RASTER}, {_SPOT}, met AS (SELECT s.page_number, operation_index, avg(CASE WHEN x % 5 < 2 AND r >= 28 THEN 1.0 ELSE 0.0 END) AS change FROM strides s JOIN pixel p ON {_MET} GROUP BY ALL)
SELECT b.page_number, b.operation_index, coalesce(change, 0) AS occlusion_change_ratio FROM boxes b LEFT JOIN met USING (page_number, operation_index)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties from events: a hundred events are a document; wording and invisible characters by event."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    names = [*properties.NAMES, "Custom"]
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    value = F.when(k % 13 == 0, F.lit("Microsoft Office PowerPoint")).when(k % 17 == 0, F.lit(None)).when(k % 7 == 0, pick(r.PHRASES, F.floor(k / 7))).when(k % 5 == 0, pick(r.TEXTS, F.floor(k / 5))).otherwise(F.concat("event_type", k % 3))
    return e.select(F.floor(k / 100).alias("doc_id"), k.alias("ord"), F.when(k % 2 == 0, "info").otherwise("xmp").alias("origin"), pick(names, F.floor(k / 2)).alias("source"), value.alias("value"))


_NAMES = [*properties.NAMES, "Custom"]
ENTRIES = f"""entries AS (SELECT event_id // 100 AS doc_id, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'xmp' END AS origin, [{', '.join(map(r.q, _NAMES))}][((event_id // 2) % {len(_NAMES)} + 1)::INT] AS source,
  CASE WHEN event_id % 13 = 0 THEN 'Microsoft Office PowerPoint' WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN [{', '.join(map(r.q, r.PHRASES))}][((event_id // 7) % {len(r.PHRASES)} + 1)::INT]
    WHEN event_id % 5 = 0 THEN [{', '.join(map(r.q, r.TEXTS))}][((event_id // 5) % {len(r.TEXTS)} + 1)::INT] ELSE event_type || (event_id % 3) END AS value FROM events),
firsts AS (SELECT doc_id, CASE WHEN origin = 'xmp' THEN 'XMP: ' || source ELSE source END AS s, substr(value, 1, 20000) AS v, min((CASE WHEN origin = 'info' THEN 0 ELSE 1 END) * 1000000000000 + ord) AS at_ FROM entries WHERE value IS NOT NULL AND value <> '' GROUP BY ALL),
vals AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY at_, s, v) - 1)::INT AS position, CASE s {' '.join(f"WHEN {r.q(a)} THEN {r.q(b)}" for a, b in properties.NAMES.items())} ELSE s END AS source, v AS value FROM firsts)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.property_values(_entries(spark, sf_dir))


def property_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.property_detections(_entries(spark, sf_dir)).drop("signals")


PROPERTY_SQL = f"""WITH {ENTRIES}, {r.inspect_sql('vals', 'value', 'u_')}, told AS (SELECT *, {sql_test(sql_folded('u_semantic'), GENERAL)} AS told FROM u_done),
totals AS (SELECT *, least(100, CASE WHEN u_has_tags THEN 50 ELSE 0 END + CASE WHEN u_has_zw THEN 40 ELSE 0 END + CASE WHEN u_has_bidi THEN 35 ELSE 0 END + CASE WHEN told THEN 25 ELSE 0 END) AS score FROM told)
SELECT doc_id, 'metadata-' || position AS id, source, substr(u_display, 1, 800) AS text, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'caution' ELSE 'info' END AS severity FROM totals WHERE score > 0"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.made_by_slides(_entries(spark, sf_dir))


SLIDES_SQL = f"""WITH {ENTRIES} SELECT doc_id, coalesce(bool_or(CASE WHEN origin = 'info' THEN regexp_matches(source, '(?i)creator|producer') ELSE regexp_matches(source, '(?i)creator.?tool|producer') END AND regexp_matches(value, '{properties.SLIDES}')), false) AS is_slides FROM entries GROUP BY doc_id"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as chunks of a page's text stream: items, styles and language put together."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct(F.col("text").alias("str"), F.array(F.lit(1.0)).alias("transform"), F.length("text").cast("double").alias("width"))
    chunks = c.select("conv_id", F.col("turn").alias("chunk_seq"), F.when(F.col("turn") % 3 == 2, F.array().cast("array<struct<str:string,transform:array<double>,width:double>>")).otherwise(F.array(item, item)).alias("items"), F.create_map(F.concat(F.lit("f"), F.col("turn") % 2), "role").alias("styles"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("l"), F.col("turn"))).alias("lang"))
    m = text_content.merged_chunks(chunks, ["conv_id"])
    return m.select("conv_id", F.array_join(F.transform("items", lambda i: i["str"]), "|").alias("items"), F.try_element_at("styles", F.lit("f0")).alias("f0"), F.try_element_at("styles", F.lit("f1")).alias("f1"), "lang")


STREAMS_SQL = """SELECT conv_id, coalesce(string_agg(text || '|' || text, '|' ORDER BY turn) FILTER (turn % 3 <> 2), '') AS items, arg_max(role, turn) FILTER (turn % 2 = 0) AS f0, arg_max(role, turn) FILTER (turn % 2 = 1) AS f1,
  'l' || min(turn) FILTER (turn % 2 = 1) AS lang FROM conversations GROUP BY conv_id"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select("event_id", F.when(k % 5 == 0, F.lit('{"str": 1, "transform": [1], "width": 2}')).when(k % 5 == 1, F.lit('{"str": "a", "transform": 3, "width": 2}')).when(k % 5 == 2, F.lit("not json")).otherwise(F.concat(F.lit('{"str": "s'), k, F.lit('", "transform": [1.5, 2], "width": '), k, F.lit("}"))).alias("json"))
    return text_content.shaped_items(raw, ["event_id"]).select("event_id", "str", F.size("transform").alias("n"), "width")


SHAPES_SQL = "SELECT event_id, 's' || event_id AS str, 2 AS n, event_id::DOUBLE AS width FROM events WHERE event_id % 5 > 2"

QUERIES = {
    "g1_g2_matrices": (matrices, MATRICES_SQL),
    "g6_box_agreement": (agreement, AGREEMENT_SQL),
    "g7_extent_along": (extents, EXTENTS_SQL),
    "f9_coverage": (coverages, COVERAGES_SQL),
    "f14_overlay_box": (overlays, OVERLAYS_SQL),
    "c1_c3_colours": (colours, COLOURS_SQL),
    "x1_x3_surroundings": (surroundings, SURROUNDINGS_SQL),
    "x4_redraw_difference": (differences, DIFFERENCES_SQL),
    "x5_strong_contrast": (contrasts, CONTRASTS_SQL),
    "m1_m2_property_values": (values, f"WITH {ENTRIES} SELECT * FROM vals"),
    "m3_property_detections": (property_detections, PROPERTY_SQL),
    "f8_slide_program": (slides, SLIDES_SQL),
    "s5_text_streams": (streams, STREAMS_SQL),
    "s6_item_shapes": (shapes, SHAPES_SQL),
}
