"""Matrices, boxes and colours as column expressions. A box is struct<x, y, width, height>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))))


def multiply(a: Column, b: Column) -> Column:
    """Product of two affine matrices given as six numbers each."""
    g = lambda m, i: m[i]
    linear = [g(a, r) * g(b, 2 * c) + g(a, r + 2) * g(b, 2 * c + 1) for c in (0, 1) for r in (0, 1)]
    shift = [g(a, r) * g(b, 4) + g(a, r + 2) * g(b, 5) + g(a, r + 4) for r in (0, 1)]
    return F.array(*linear, *shift)


def apply_point(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def hull(points: list[tuple[Column, Column]]) -> Column:
    """The smallest upright box around points."""
    xs, ys = zip(*points, strict=True)
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))


def transform_box(m: Column, b: Column) -> Column:
    right, top = b["x"] + b["width"], b["y"] + b["height"]
    return hull([apply_point(m, x, y) for x in (b["x"], right) for y in (b["y"], top)])


def area(b: Column) -> Column:
    return F.greatest(b["width"], F.lit(0.0)) * F.greatest(b["height"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    return side("x", "width") * side("y", "height")


def coverage(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` that lies in ``outer``; 0 for an empty box."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def expanded(b: Column) -> Column:
    by = F.greatest(F.lit(3.0), F.least(b["width"], b["height"]) * 0.035)
    return box(b["x"] - by, b["y"] - by, b["width"] + by * 2, b["height"] + by * 2)


def agree(recorded: Column, calculated: Column) -> Column:
    """Whether a recorded box (may be null) and a calculated one are about the same."""
    full = lambda b: b["width"] * b["height"]
    ratio = lambda n: F.least(recorded[n], calculated[n]) / F.nullif(F.greatest(recorded[n], calculated[n]), F.lit(0.0))
    share = intersection(recorded, calculated) / F.nullif(F.least(full(recorded), full(calculated)), F.lit(0.0))
    good = (full(recorded) > 0) & (full(calculated) > 0) & (share >= 0.5) & (ratio("width") >= 0.5) & (ratio("height") >= 0.5)
    return F.coalesce(good, F.lit(False))


def extent_along(b: Column, dx: Column, dy: Column) -> Column:
    """Size of a box along a direction; tall boxes with little of it count by their height."""
    length = F.sqrt(dx * dx + dy * dy)
    projected = (F.abs(dx) * b["width"] + F.abs(dy) * b["height"]) / F.nullif(length, F.lit(0.0))
    tall = (b["height"] >= b["width"] * 2.5) & (projected < b["height"] * 0.5)
    return F.when(~(length > 0) | F.isnan(length), b["width"]).when(tall, b["height"]).otherwise(projected)


def text_item_box(viewport: Column, transform: Column, width: Column) -> Column:
    """Box of an extracted text item, or null where width or scale is not positive."""
    m = multiply(viewport, transform)
    scale = lambda t: F.sqrt(t[0] * t[0] + t[1] * t[1])
    along = lambda i: m[i] / F.nullif(scale(m), F.lit(0.0)) * width * scale(viewport)
    corners = [(m[4] + (along(0) if right else 0) + (m[2] if up else 0), m[5] + (along(1) if right else 0) + (m[3] if up else 0)) for right in (False, True) for up in (False, True)]
    return F.when((width > 0) & (scale(m) > 0) & (scale(viewport) > 0), hull(corners))


def percent_box(b: Column, width: Column, height: Column) -> Column:
    """Box as percent of its page, for an overlay; at least 1 % wide and high."""
    return box(100 * b["x"] / width, 100 * b["y"] / height, F.greatest(F.lit(1.0), 100 * b["width"] / width), F.greatest(F.lit(1.0), 100 * b["height"] / height))


def hex_colour(text: Column) -> Column:
    """#rrggbb from #rrggbb, #rgb or "transparent" (white); else null."""
    short = F.regexp_replace(text, "^#([0-9A-Fa-f])([0-9A-Fa-f])([0-9A-Fa-f])$", "#$1$1$2$2$3$3")
    return F.when(text == "transparent", "#ffffff").when(F.rlike(short, F.lit("^#[0-9A-Fa-f]{6}$")), F.lower(short))


def number_colour(numbers: Column) -> Column:
    """#rrggbb from three numbers or more, or a single gray; above 1 they count to 255, else to 1."""
    scale = F.when(F.exists(numbers, lambda n: n > 1), 1.0).otherwise(255.0)
    byte = lambda n: F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(n * scale + 0.5))).cast("long")), 2, "0"))
    rgb = F.concat(F.lit("#"), byte(F.get(numbers, F.lit(0))), byte(F.get(numbers, F.lit(1))), byte(F.get(numbers, F.lit(2))))
    gray = F.concat(F.lit("#"), F.repeat(byte(F.get(numbers, F.lit(0))), F.lit(3)))
    return F.when(F.size(numbers) >= 3, rgb).when(F.size(numbers) == 1, gray)


def one_colour(colours: Column) -> Column:
    """The only colour of a list (nulls aside), or null."""
    distinct = F.array_distinct(F.array_compact(colours))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def channels(colour: Column) -> Column:
    """struct<r, g, b> of #rrggbb, null for anything else."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    return F.when(F.rlike(colour, F.lit("^#[0-9A-Fa-f]{6}$")), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def colour_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two struct<r, g, b>."""
    return F.sqrt(sum(((a[c] - b[c]).cast("double") * (a[c] - b[c]).cast("double") for c in "rgb"), F.lit(0.0)))
