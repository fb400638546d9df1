"""Evidence from rasters, as joins of boxes with a table of pixels (page, x, y, r, g, b, a).

Boxes read a grid of their surroundings with a stride that keeps some thousands of
points for each, so the rows that meet are bounded by the number of boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.geometry import channels, colour_distance

OPAQUE = 220


def _met(boxes: DataFrame, pixel: DataFrame, page: list[str], area: tuple[Column, Column, Column, Column], points: int) -> DataFrame:
    """Boxes joined with the pixels of an area (left, top, right, bottom), thinned to about ``points``."""
    names = ("__l", "__t", "__r", "__b")
    rows = boxes.withColumns(dict(zip(names, area, strict=True)))
    size = F.greatest(F.lit(0.0), F.col("__r") - F.col("__l")) * F.greatest(F.lit(0.0), F.col("__b") - F.col("__t"))
    rows = rows.withColumn("__s", F.greatest(F.lit(1), F.floor(F.sqrt(size / points))).cast("int"))
    inside = (F.col("x") >= F.col("__l")) & (F.col("x") < F.col("__r")) & (F.col("y") >= F.col("__t")) & (F.col("y") < F.col("__b"))
    on_grid = ((F.col("x") - F.col("__l")) % F.col("__s") == 0) & ((F.col("y") - F.col("__t")) % F.col("__s") == 0)
    return rows.join(pixel, page).where(inside & on_grid)


def _own_area(width: int, height: int) -> tuple[Column, Column, Column, Column]:
    b = F.col("box")
    left, top = F.greatest(F.lit(0.0), F.floor(b["x"])).cast("double"), F.greatest(F.lit(0.0), F.floor(b["y"])).cast("double")
    return left, top, F.least(F.lit(float(width)), left + F.greatest(F.lit(1), F.ceil(b["width"]))), F.least(F.lit(float(height)), top + F.greatest(F.lit(1), F.ceil(b["height"])))


def surroundings(pixel: DataFrame, boxes: DataFrame, page: list[str], width: int, height: int) -> DataFrame:
    """page, operation_index, surrounding_color, surrounding_confidence, declared_ink_ratio.

    Opaque pixels around a box are put in buckets of 16 levels; the fullest (the first
    met on ties) is the background. Inside the box the share of pixels near the text's
    own colour is its ink; null where the colour is unknown or no pixel counts.
    """
    b = F.col("box")
    pad = F.least(F.lit(14.0), F.greatest(F.lit(4.0), F.ceil(b["height"] * 0.75).cast("double")))
    clamp = lambda v, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), v.cast("double")))
    area = (clamp(F.floor(b["x"] - pad), width), clamp(F.floor(b["y"] - pad), height), clamp(F.ceil(b["x"] + b["width"] + pad), width), clamp(F.ceil(b["y"] + b["height"] + pad), height))
    met = _met(boxes, pixel, page, area, 3500).where(F.col("a") >= OPAQUE)
    inside = (F.col("x") >= b["x"]) & (F.col("x") <= b["x"] + b["width"]) & (F.col("y") >= b["y"]) & (F.col("y") <= b["y"] + b["height"])
    key = [*page, "operation_index"]
    level = lambda c: F.floor(F.col(c) / 16).cast("int")
    buckets = met.where(~inside).groupBy(*key, level("r").alias("r"), level("g").alias("g"), level("b").alias("b")).agg(F.count("*").alias("n"), F.min(F.col("y") * width + F.col("x")).alias("at"))
    best = buckets.groupBy(*key).agg(F.max(F.struct("n", (-F.col("at")).alias("m"), "r", "g", "b")).alias("top"), F.sum("n").alias("all"))
    centre = lambda c: F.least(F.lit(255), F.col(f"top.{c}") * 16 + 8).alias(c)
    outer = best.select(*key, F.struct(centre("r"), centre("g"), centre("b")).alias("surrounding_color"), (F.col("top.n") / F.col("all")).alias("surrounding_confidence"))
    near = colour_distance(F.struct("r", "g", "b"), channels(F.col("fill_color"))) < 55
    ink = met.where(inside).groupBy(*key).agg(F.avg(F.when(near, 1.0).when(~near, 0.0)).alias("declared_ink_ratio"))
    out = boxes.select(*key).join(outer, key, "left").join(ink, key, "left")
    return out.withColumn("surrounding_confidence", F.coalesce("surrounding_confidence", F.lit(0.0)))


def redraw_difference(base: DataFrame, again: DataFrame, boxes: DataFrame, page: list[str], width: int, height: int) -> DataFrame:
    """page, operation_index, occlusion_change_ratio: the share of a box's pixels that differ between two rasters."""
    other = again.select(*page, "x", "y", F.struct("r", "g", "b").alias("c"))
    both = base.select(*page, "x", "y", F.struct("r", "g", "b").alias("d")).join(other, [*page, "x", "y"])
    key = [*page, "operation_index"]
    change = _met(boxes, both, page, _own_area(width, height), 3000).groupBy(*key).agg(F.avg(F.when(colour_distance(F.col("c"), F.col("d")) >= 28, 1.0).otherwise(0.0)).alias("occlusion_change_ratio"))
    return boxes.select(*key).join(change, key, "left").withColumn("occlusion_change_ratio", F.coalesce("occlusion_change_ratio", F.lit(0.0)))


def strong_contrast(pixel: DataFrame, boxes: DataFrame, page: list[str], width: int, height: int) -> DataFrame:
    """page, operation_index, strong_contrast: eight pixels or more, and 40 % of the opaque ones, are far from the text's colour."""
    key = [*page, "operation_index"]
    far = colour_distance(F.struct("r", "g", "b"), channels(F.col("fill_color"))) >= 70
    met = _met(boxes, pixel, page, _own_area(width, height), 3000).where(F.col("a") >= OPAQUE)
    counts = met.groupBy(*key).agg(F.count("*").alias("n"), F.count(F.when(far, 1)).alias("k"))
    out = boxes.select(*key).join(counts, key, "left")
    return out.select(*key, F.coalesce((F.col("k") >= 8) & (F.col("k") >= F.col("n") * 0.4), F.lit(False)).alias("strong_contrast"))
