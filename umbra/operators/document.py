"""From the drawing operations of documents to their detections, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.operators.drawing import finished_texts, interpret
from umbra.operators.evidence import by_recorded_box, occlusion, replacement_text
from umbra.operators.scoring import instruction_context, median_font_size, score_candidates

BOXES = "doc_id string, page_number int, operation_index int, min_x double, min_y double, max_x double, max_y double"
PAGE = ["doc_id", "page_number"]


def document_candidates(operations: DataFrame, boxes: DataFrame | None = None, layers: DataFrame | None = None, scale: float = 1.5) -> DataFrame:
    """Text candidates of operations (doc_id, page_number, page_width, page_height, operation_index, fn, args).

    ``boxes`` are recorded boxes, without which no paint has a place and no text is
    covered. Evidence from rasters is neutral: no background, nothing changed by a redraw.
    Rows with an error, repeated files apart, are left out; no rows give none.
    """
    good = operations.where("page_number IS NOT NULL")
    boxes = operations.sparkSession.createDataFrame([], BOXES) if boxes is None else boxes
    sizes = good.groupBy(*PAGE).agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    events = by_recorded_box(interpret(good, PAGE, layers).join(sizes, PAGE), boxes, PAGE)
    view = F.array(*(F.lit(v).cast("double") for v in (scale, 0, 0, -scale, 0)), F.col("page_height"))
    paints = events.where("kind IN ('path', 'image') AND recorded_box IS NOT NULL").select(*PAGE, "operation_index", F.col("recorded_box").alias("box"), F.col("fill_alpha").alias("alpha"), "kind")
    texts = replacement_text(occlusion(finished_texts(events, view), paints, PAGE), PAGE)
    neutral = {
        "surrounding_color": F.lit(None).cast("struct<r:int,g:int,b:int>"), "surrounding_confidence": F.lit(0.0), "declared_ink_ratio": F.lit(None).cast("double"),
        "has_exact_visible_text_match": F.lit(False), "occlusion_change_ratio": F.lit(0.0),
    }
    return texts.withColumns(neutral)


def document_detections(candidates: DataFrame) -> DataFrame:
    """Detections of candidates (see :func:`document_candidates`) with their context and page's usual size."""
    rows = instruction_context(candidates, PAGE)
    return score_candidates(rows.join(median_font_size(rows, PAGE), PAGE))
