"""Scoring of text candidates: evidence columns in, signals, score and severity out, in one projection.

A candidate row has page_number, operation_index, text, box struct<x,y,width,height>,
has_recorded_box, hidden_by_clipping, geometry_reliable, font_size, horizontal_scale,
transform_scale_ratio, glyph_width_ratio, fill_color, fill_alpha, rendering_mode,
hidden_by_optional_content, surrounding_color struct<r,g,b>, surrounding_confidence,
declared_ink_ratio, has_exact_visible_text_match, later_occlusion_ratio,
occlusion_change_ratio, has_nearby_replacement_text; beside it stand median_font_size,
page_width, page_height and instruction_context (defaults to the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.geometry import channels, colour_distance
from umbra.functions.instruction import folded, has_instruction, has_strong_instruction
from umbra.functions.invisible import inspect
from umbra.functions.text import trim, where_once

#: Kind of signal, whether it is about visibility, and a label; fixed values of the report format.
KINDS = (
    ("low-contrast", True, "Almost the colour of its background"),
    ("tiny-text", True, "Extremely small"),
    ("compressed-text", True, "Extremely condensed"),
    ("edge-or-outside", True, "Mostly or wholly off the page"),
    ("transparent-text", True, "Transparent or not drawn"),
    ("clipped-text", True, "Clipped away"),
    ("hidden-layer", True, "On a layer that is off"),
    ("occluded-text", True, "Covered by later objects"),
    ("unicode-tags", True, "Invisible Unicode tags"),
    ("zero-width-encoding", True, "Unusual zero-width characters"),
    ("bidi-control", True, "Odd direction controls"),
    ("instruction-language", False, "Wording like an instruction to a model"),
    ("metadata-instruction", False, "Instruction wording in document properties"),
)
VISIBLE = [k for k, visible, _ in KINDS if visible]


def severity(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 35, "caution").otherwise("info")


def total(signals: Column) -> Column:
    """Sum of the signals' scores, 100 at most."""
    return F.least(F.lit(100), F.aggregate(signals, F.lit(0), lambda a, s: a + s["score"]))


def compact_identifier(text: Column) -> Column:
    """Reference numbers and codes, which are often condensed."""
    # fixed values
    coded = F.rlike(text, F.lit("(?i)(?:reference|ref\\.?|invoice|id|no\\.?|number|番号|コード)")) | F.rlike(text, F.lit("[A-Z0-9][A-Z0-9._/-]{7,}"))
    return (F.regexp_count(text, F.lit("[0-9]")) >= 4) & coded


def tests(c) -> dict[str, tuple[Column, Column]]:
    """Kind to (condition, score) of the signals of drawing; ``c`` gives a column by name."""
    length = F.length(trim(c("text")))
    told, strong = c("instruction"), c("strong_instruction")
    yes = lambda x: F.coalesce(x, F.lit(False))
    reliable = c("geometry_reliable")
    distance = colour_distance(channels(c("fill_color")), c("surrounding_color"))
    ink = c("declared_ink_ratio")
    numeric_label = ~reliable & F.rlike(trim(c("text")), F.lit("^[0-9]{1,4}$"))
    low = (
        (distance < 28) & (length >= 2) & (c("surrounding_confidence") >= 0.55) & (ink > 0.72)
        & (reliable | told | ((c("font_size") <= 3) & c("has_recorded_box"))) & ~numeric_label & ~c("has_exact_visible_text_match") & (c("later_occlusion_ratio") < 0.98)
    )
    size, usual = c("font_size"), c("median_font_size")
    b, right, bottom = c("box"), c("box")["x"] + c("box")["width"], c("box")["y"] + c("box")["height"]
    tiny = (length >= 4) & (usual > 0) & (size > 0) & (size < F.when(strong, 8).otherwise(3)) & (reliable | (b["height"] <= 18)) & (size < usual * 0.35)
    ratio = F.least(c("horizontal_scale") / 100, c("transform_scale_ratio"), F.when(reliable | told, c("glyph_width_ratio")).otherwise(1.0))
    squeezed = (length >= 2) & (ratio < 0.35) & ~((ratio >= 0.18) & compact_identifier(c("text")) & ~strong)
    outside = (right <= 0) | (bottom <= 0) | (b["x"] >= c("page_width")) | (b["y"] >= c("page_height"))
    seen = lambda start, end, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), end) - F.greatest(F.lit(0.0), start))
    shown = seen(b["x"], right, c("page_width")) * seen(b["y"], bottom, c("page_height")) / F.greatest(F.lit(1.0), b["width"] * b["height"])
    covered, changed = c("later_occlusion_ratio"), c("occlusion_change_ratio")
    extreme = (length >= 4) & (covered >= 0.98) & (changed >= 0.985) & yes((ink <= 0.01) | (ink >= 0.9))
    directive = (covered >= 0.9) & (changed >= 0.2) & told
    revised = c("has_nearby_replacement_text") & (covered >= 0.98) & (changed < 0.5) & (size >= 6) & ~strong
    undrawn = c("rendering_mode") == 3
    return {
        "low-contrast": (yes(low), F.lit(35)),
        "tiny-text": (yes(tiny), F.lit(20)),
        "compressed-text": (yes(squeezed), F.lit(25)),
        "edge-or-outside": (yes((length >= 8) & (outside | (shown < 0.5))), F.when(outside, 30).otherwise(25)),
        "transparent-text": (yes(undrawn | ((c("fill_alpha") <= 0.15) & told)), F.when(undrawn, 50).otherwise(35)),
        "clipped-text": (yes(c("hidden_by_clipping") & (length >= 4)), F.lit(50)),
        "hidden-layer": (yes(c("hidden_by_optional_content") & (length >= 4)), F.lit(50)),
        "occluded-text": (yes(~revised & (extreme | directive)), F.lit(40)),
    }


def with_language(candidates: DataFrame, normalise: bool = True) -> DataFrame:
    """Add the inspection of text (u_) and whether the context holds instructions."""
    df = inspect(candidates, "text", "u_", normalise)
    df = inspect(df, "instruction_context", "x_", normalise).withColumn("x_folded", folded(F.col("x_semantic")))
    df = df.withColumns({"instruction": has_instruction(F.col("x_folded")), "strong_instruction": has_strong_instruction(F.col("x_folded"))})
    return df.drop(*(c for c in df.columns if c.startswith("x_")))


def score_candidates(candidates: DataFrame, normalise: bool = True) -> DataFrame:
    """One row per candidate that is a detection: its columns with id, display_text, score, severity, signals.

    A candidate is one if it has a visibility signal other than the page's edge, or that
    one together with instruction wording. Instruction wording raises a score but never
    makes one. Signals keep their order: Unicode first, then drawing, then wording.
    """
    df = with_language(candidates, normalise)
    made = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).alias("kind"), score.alias("score"))) for k, (test, score) in tests(F.col).items())))
    df = df.withColumn("seen", F.concat("u_signals", made))
    told = F.when((F.size("seen") > 0) & F.col("instruction"), F.array(F.struct(F.lit("instruction-language").alias("kind"), F.lit(20).alias("score")))).otherwise(F.array().cast("array<struct<kind:string,score:int>>"))
    df = df.withColumn("signals", F.concat("seen", told))
    alone = F.exists("seen", lambda s: s["kind"] != "edge-or-outside")
    df = where_once(df, alone | ((F.size("seen") > 0) & F.col("instruction"))).withColumn("score", total(F.col("signals")))
    shown = F.when(F.size("u_signals") > 0, F.substring("u_display", 1, 800)).otherwise(trim(F.col("text")))
    return df.withColumns(
        {
            "id": F.concat(F.lit("p"), F.col("page_number"), F.lit("-op"), F.col("operation_index")),
            "display_text": shown,
            "severity": severity(F.col("score")),
        }
    ).select(*candidates.columns, "id", "display_text", "score", "severity", "signals")


def instruction_context(candidates: DataFrame, page: list[str]) -> DataFrame:
    """Add instruction_context: the texts of a candidate's run, up to five, those to the left first.

    Neighbours in drawing order are of one run if they are at most 12 operations apart
    and alike in colour, opacity, mode and size.
    """
    w = Window.partitionBy(*page).orderBy("operation_index")
    before = lambda n: F.lag(n).over(w)
    larger, smaller = F.greatest("font_size", before("font_size")), F.least("font_size", before("font_size"))
    gap = F.col("operation_index") - before("operation_index")
    same = (
        (gap > 0) & (gap <= 12) & F.col("fill_color").eqNullSafe(before("fill_color")) & (F.abs(F.col("fill_alpha") - before("fill_alpha")) <= 0.1)
        & (F.col("rendering_mode") == before("rendering_mode")) & (larger > 0) & (smaller >= larger * 0.8)
    )
    df = candidates.withColumn("__run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    r = Window.partitionBy(*page, "__run").orderBy("operation_index")
    left = F.collect_list(trim(F.col("text"))).over(r.rowsBetween(-4, 0))
    right = F.collect_list(trim(F.col("text"))).over(r.rowsBetween(1, 4))
    five = F.slice(F.concat(left, right), F.lit(1), F.lit(5))
    return df.withColumn("instruction_context", F.substring(F.array_join(five, " "), 1, 800)).drop("__run")


def median_font_size(candidates: DataFrame, page: list[str]) -> DataFrame:
    """page, median_font_size over drawn, visible texts; 0 where a page has none."""
    counts = (F.col("fill_alpha") > 0.5) & (F.col("rendering_mode") != 3) & (F.col("font_size") > 0)
    return candidates.groupBy(*page).agg(F.coalesce(F.median(F.when(counts, F.col("font_size"))), F.lit(0.0)).alias("median_font_size"))


def severity_summary(detections: DataFrame, document: list[str]) -> DataFrame:
    """Counts of each severity and of all, by document."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}")
    return detections.groupBy(*document).agg(*(count(s) for s in ("high", "caution", "info")), F.count("*").alias("n_findings"))


def ranked(detections: DataFrame, page: list[str]) -> DataFrame:
    """Add rank: by score, then drawn before extracted, then drawing order."""
    order = [F.desc("score"), "is_extracted", "operation_index"]
    return detections.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy(*order)))


def page_navigation(detections: DataFrame, document: list[str]) -> DataFrame:
    """Pages with findings, with the next and previous one, around the ends, and the first finding."""
    pages = detections.groupBy(*document, "page_number").agg(F.min_by("operation_index", "rank").alias("first_operation"), F.count("*").alias("n_findings"))
    w = Window.partitionBy(*document).orderBy("page_number")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pages.withColumns(
        {
            "next_page": F.coalesce(F.lead("page_number").over(w), F.first("page_number").over(whole)),
            "previous_page": F.coalesce(F.lag("page_number").over(w), F.last("page_number").over(whole)),
        }
    )
