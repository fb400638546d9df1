"""Drawing operations of a page folded into texts and paints.

The fold keeps registers and two stacks, which no window function can, so the
operations of a page go through one Python generator in order; what an operation does is
read once for each different one. Geometry that needs no memory is left to column
expressions afterwards.
"""

from __future__ import annotations

import gc
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from umbra.functions.geometry import agree, extent_along, multiply, transform_box
from umbra.functions.text import trim, where_once

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
FILLS = {"fill", "eoFill", "fillStroke", "eoFillStroke", "closeFillStroke", "closeEOFillStroke"}
IMAGES = {"paintImageXObject", "paintInlineImageXObject", "paintImageMaskXObject", "paintSolidColorImageMask", "paintImageXObjectRepeat", "paintImageMaskXObjectRepeat", "shadingFill"}
EVENT = (
    "{page}, operation_index int, kind string, text string, advance double, font_size double, horizontal_scale double, rise double, ctm array<double>, text_matrix array<double>, "
    "text_x double, text_y double, fill_color string, fill_color_kind string, fill_alpha double, rendering_mode int, hidden_by_clipping boolean, hidden_by_optional_content boolean"
)


def product(a: tuple, b: tuple) -> tuple:
    """The affine matrix that applies ``b`` first, then ``a``."""
    p, q, r, s, t, u = a
    return (
        p * b[0] + r * b[1] + 0.0, q * b[0] + s * b[1] + 0.0,
        p * b[2] + r * b[3] + 0.0, q * b[2] + s * b[3] + 0.0,
        p * b[4] + r * b[5] + t, q * b[4] + s * b[5] + u,
    )


def number(x) -> bool:
    return type(x) is int or type(x) is float


_scan = json.JSONDecoder().scan_once


def parsed(raw: str | None) -> list:
    """Arguments as lists; ``json.loads`` without its search for white space where there is none."""
    if not raw:
        return []
    if raw[0] == "[":
        try:
            found, end = _scan(raw, 0)
        except StopIteration:
            end = -1
        if end == len(raw):
            return found
    return json.loads(raw)


def matrix_of(args: list) -> tuple | None:
    """Six numbers, flat or in one list; else nothing."""
    found = args[0] if len(args) == 1 and isinstance(args[0], list) else args
    return tuple(map(float, found[:6])) if len(found) >= 6 and all(map(number, found[:6])) else None


def colour_of(args: list) -> str | None:
    """#rrggbb of a colour operation's arguments; a bare single number is none."""
    value = args[0] if len(args) == 1 else args
    if isinstance(value, str):
        digits = value[1:].lower() if value.startswith("#") else ""
        if len(digits) in (3, 6) and all(c in "0123456789abcdef" for c in digits):
            return "#" + (digits if len(digits) == 6 else "".join(c + c for c in digits))
        return "#ffffff" if value == "transparent" else None
    levels = [v for v in value if number(v)] if isinstance(value, list) else []
    if len(levels) == 1:
        levels *= 3
    if len(levels) < 3:
        return None
    scale = 1 if max(levels) > 1 else 255
    red, green, blue = (max(0, min(255, math.floor(v * scale + 0.5))) for v in levels[:3])
    return f"#{red:02x}{green:02x}{blue:02x}"


def pattern_colour(args: list) -> str | None:
    """The only fill colour of a pattern's own operations, or nothing."""
    inner = next((a for a in args if isinstance(a, dict) and isinstance(a.get("ops"), list)), {"ops": []})
    found = {c for fn, own in inner["ops"] if fn in ("setFillRGBColor", "setFillGray") and (c := colour_of(own))}
    return found.pop() if len(found) == 1 else None


def glyph_run(args: list) -> tuple[str, float]:
    """Text and advance (in text space units of 1) of a run of glyphs and kerning numbers."""
    run = args[0] if args and isinstance(args[0], list) else args
    glyphs = [g for g in run if isinstance(g, dict)]
    text = "".join(g["unicode"] if g.get("unicode") is not None else " " if g.get("isSpace") else "" for g in glyphs)
    return text, (sum(g.get("width") or 0 for g in glyphs) - sum(n for n in run if number(n))) / 1000


def empty_clip(args: list) -> bool:
    bounds = args[2] if len(args) > 2 else None
    if not isinstance(bounds, list) or len(bounds) < 4 or not all(number(b) and math.isfinite(b) for b in bounds[:4]):
        return False
    return min(abs(bounds[2] - bounds[0]), abs(bounds[3] - bounds[1])) <= 1e-6


@dataclass(slots=True)
class Registers:
    """What save and restore keep."""

    ctm: tuple = IDENTITY
    text_matrix: tuple = IDENTITY
    x: float = 0.0
    y: float = 0.0
    line_x: float = 0.0
    line_y: float = 0.0
    leading: float = 0.0
    size: float = 0.0
    scale: float = 100.0
    rise: float = 0.0
    mode: int = 0
    colour: str | None = "#000000"
    colour_kind: str = "solid"
    alpha: float = 1.0
    clipped: bool = False

    def copy(self) -> Registers:
        return Registers(
            self.ctm, self.text_matrix, self.x, self.y, self.line_x, self.line_y, self.leading, self.size,
            self.scale, self.rise, self.mode, self.colour, self.colour_kind, self.alpha, self.clipped,
        )


class Page:
    """The state of a page between operations."""

    def __init__(self, layers: dict[str, bool]):
        self.now, self.saved, self.visible, self.clip, self.layers = Registers(), [], [True], False, layers

    def run(self, fn: str, args: list):
        """Apply one operation; gives ("text", text, advance), ("paint", kind) or nothing."""
        apply, value = reading(fn, args)
        return apply(self, value)


def give(page: Page, made: tuple | None):
    return made


def put(page: Page, values: dict) -> None:
    for name, value in values.items():
        setattr(page.now, name, value)


def save(page: Page, matrix: tuple | None) -> None:
    page.saved.append(page.now.copy())
    if matrix:
        transform(page, matrix)


def restore(page: Page, _) -> None:
    if page.saved:
        page.now = page.saved.pop()


def transform(page: Page, matrix: tuple) -> None:
    page.now.ctm = product(page.now.ctm, matrix)


def restart(page: Page, matrix: tuple | None) -> None:
    n = page.now
    n.x = n.y = n.line_x = n.line_y = 0.0
    if matrix:
        n.text_matrix = matrix


def move(page: Page, by: tuple[float, float]) -> None:
    n = page.now
    n.x = n.line_x = n.line_x + by[0]
    n.y = n.line_y = n.line_y + by[1]


def lead_and_move(page: Page, by: tuple[float, float]) -> None:
    page.now.leading = -by[1]
    move(page, by)


def next_line(page: Page, _) -> None:
    move(page, (0.0, page.now.leading))


def clip(page: Page, _) -> None:
    page.clip = True


def mark(page: Page, layer) -> None:
    own = layer if isinstance(layer, bool) else page.layers.get(str(layer), True)
    page.visible.append(page.visible[-1] and own)


def unmark(page: Page, _) -> None:
    if len(page.visible) > 1:
        page.visible.pop()


def path(page: Page, value: tuple[bool, tuple | None]) -> tuple | None:
    if page.clip:
        page.now.clipped = page.now.clipped or value[0]
        page.clip = False
    return value[1]


def reading(fn: str, args: list) -> tuple[Callable, object]:
    """What one operation does, read from its arguments alone: a function of the page and a value, and that value."""
    first = args[0] if args else None
    amount = float(first) if number(first) else 0.0
    match fn:
        case "save":
            return save, None
        case "paintFormXObjectBegin":
            return save, matrix_of([first] if isinstance(first, list) else args) if args else None
        case "restore" | "paintFormXObjectEnd":
            return restore, None
        case "transform":
            m = matrix_of(args)
            return (transform, m) if m else (give, None)
        case "beginText":
            return restart, IDENTITY
        case "setTextMatrix":
            return restart, matrix_of(args)
        case "moveText" | "setLeadingMoveText":
            dy = float(args[1]) if len(args) > 1 and number(args[1]) else 0.0
            return lead_and_move if fn == "setLeadingMoveText" else move, (amount, dy)
        case "nextLine":
            return next_line, None
        case "setLeading":
            return put, {"leading": amount}
        case "setFont":
            return put, {"size": abs(float(args[1])) if len(args) > 1 and number(args[1]) else 0.0}
        case "setHScale":
            return put, {"scale": abs(amount) or 100.0}
        case "setTextRise":
            return put, {"rise": amount}
        case "setTextRenderingMode":
            return put, {"mode": int(amount)}
        case "setFillRGBColor" | "setFillGray":
            return put, {"colour": colour_of(args), "colour_kind": "solid"}
        case "setFillColorN":
            return put, {"colour": pattern_colour(args), "colour_kind": "pattern"}
        case "setFillTransparent":
            return put, {"colour": "#ffffff", "alpha": 0.0}
        case "setGState":
            entries = [e for e in (first if isinstance(first, list) else args) if isinstance(e, list) and len(e) > 1]
            return put, {"alpha": float(v) for k, v, *_ in entries if k == "ca" and number(v)}
        case "clip" | "eoClip":
            return clip, None
        case "beginMarkedContent":
            return mark, True
        case "beginMarkedContentProps":
            return mark, args[1] if first == "OC" and len(args) > 1 else True
        case "endMarkedContent":
            return unmark, None
        case "showText":
            return give, ("text", *glyph_run(args))
        case "constructPath":
            return path, (empty_clip(args), ("paint", "path") if first in FILLS else None)
        case _:
            return give, ("paint", "image") if fn in IMAGES else None


def event(page: Page, made: tuple) -> tuple:
    """The row, but for its index, of what an operation gave; a text moves the cursor on, drawn or blank."""
    r = page.now
    kind, text, advance = made if made[0] == "text" else (made[1], None, None)
    row = (kind, text, advance, r.size, r.scale, r.rise, r.ctm, r.text_matrix, r.x, r.y, r.colour, r.colour_kind, r.alpha, r.mode, r.clipped, not page.visible[-1])
    if text is not None:
        r.x += advance * r.size * r.scale / 100
    return row


def fold_page(ops: list[tuple[int, str, str]], layers: dict[str, bool]) -> list[tuple]:
    """Rows of texts and paints of a page's (index, function, JSON arguments) in order."""
    page = Page(layers)
    return [(index, *event(page, made)) for index, fn, raw in ops if (made := page.run(fn, parsed(raw))) is not None]


class Readings(dict):
    """:func:`reading` of "arguments NUL function", kept for short ones until there are ``most``; JSON holds no NUL."""

    most = 100_000

    def __missing__(self, code: str) -> tuple:
        raw, _, fn = code.partition("\0")
        found = reading(fn, parsed(raw))
        if len(code) < 200:
            if len(self) >= self.most:
                self.clear()
            self[code] = found
        return found


def matrices(found: tuple, kind: pa.DataType) -> pa.Array:
    """Matrices of six numbers as lists."""
    values = pa.array(np.fromiter(chain.from_iterable(found), np.float64, 6 * len(found)))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * len(found) + 1, 6, dtype=np.int32)), values).cast(kind)


def interpret(operations: DataFrame, page: list[str], layers: DataFrame | None = None, run: Column | None = None) -> DataFrame:
    """Texts and paints of operations (page, operation_index, fn, args as JSON), one row each.

    ``layers`` (page[0], layer, visible) has the layers that are off; of repeated rows of one the one that hides counts. Operations are
    dealt by page, sorted, and folded as they stream by, so memory does not grow with a
    page. Repeated indices keep their order by fn and args. With ``run`` a row stands for
    a run of operations: an array of (operation_index, fn, args) made of the row's columns
    after rows are dealt and sorted by operation_index, so only short rows are shuffled;
    runs of a page must not overlap.
    """
    kinds = ", ".join(f"`{c}` {operations.schema[c].dataType.simpleString()}" for c in page)
    schema = EVENT.format(page=kinds)
    if layers is not None:
        off = layers.where("layer IS NOT NULL").groupBy(page[0], "layer").agg(F.bool_and("visible").alias("visible")).groupBy(page[0]).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layer", "visible")))).alias("__layers"))
        rows = operations.join(off, page[0], "left")
    else:
        rows = operations.withColumn("__layers", F.lit(None).cast("string"))
    order = ["operation_index"] if run is not None else ["operation_index", "fn", "args"]
    if run is None:
        rows = rows.select(*page, *order, "__layers")
        run = F.array(F.struct(*order))
    rows = rows.repartition(*page).sortWithinPartitions(*page, *order).select(*page, "__layers", run.alias("__run"))
    width = len(page)
    kinds_of = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema).fields]
    names = [*page, *(part.split(" ")[0] for part in EVENT.split(", ")[1:])]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, known = None, Page({}), Readings()
        for batch in batches:
            gc.disable()  # rows are many and hold no cycles
            sizes = pc.fill_null(pc.list_value_length(batch.column(width + 1)), 0).to_pylist()
            index, fn, args = batch.column(width + 1).flatten().flatten()
            text = lambda c: pc.fill_null(c.cast(pa.large_string()), "")
            codes = pc.binary_join_element_wise(text(args), text(fn), pa.scalar("\0", pa.large_string())).dictionary_encode()
            read = [known[c] for c in codes.dictionary.to_pylist()]
            steps = [read[i] for i in codes.indices.to_numpy().tolist()]
            owners, places, out = [], [], []
            keys = zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True)
            stop = 0
            for row, (own, off, size) in enumerate(zip(keys, batch.column(width).to_pylist(), sizes, strict=True)):
                if own != key:
                    key, state = own, Page(json.loads(off) if off else {})
                start, stop = stop, stop + size
                for at in range(start, stop):
                    apply, value = steps[at]
                    made = apply(state, value)
                    if made is not None:
                        owners.append(row)
                        places.append(at)
                        out.append(event(state, made))
            owners = pa.array(owners, pa.int64())
            columns = [batch.column(k).take(owners).cast(kinds_of[k]) for k in range(width)]
            columns.append(index.take(pa.array(places, pa.int64())).cast(pa.int32()))
            for values, kind in zip(zip(*out, strict=True) if out else [()] * 16, kinds_of[width + 1 :], strict=True):
                columns.append(matrices(values, kind) if pa.types.is_list(kind) else pa.array(values, kind))
            gc.enable()
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(fold, schema)


def finished_texts(events: DataFrame, viewport: Column) -> DataFrame:
    """Candidate geometry from texts with recorded_box (may be null): box, reliability, effective size and ratios."""
    ones = lambda *v: F.array(*((x if isinstance(x, Column) else F.lit(x)).cast("double") for x in v))
    rows = where_once(events, (F.col("kind") == "text") & (trim(F.col("text")) != ""))
    hs = F.col("horizontal_scale") / 100
    rows = rows.withColumn("__e", multiply(F.col("ctm"), F.col("text_matrix"))).withColumn("__d", multiply(viewport, F.col("__e")))
    own = F.struct(F.col("text_x").alias("x"), (F.col("text_y") + F.col("rise")).alias("y"), F.abs(F.col("advance") * F.col("font_size")).alias("width"), F.abs("font_size").alias("height"))
    rows = rows.withColumn("__f", transform_box(multiply(F.col("__d"), ones(hs, 0, 0, 1, 0, 0)), own))
    rec = F.col("recorded_box")
    empty = rec.isNotNull() & ((rec["width"] * rec["height"] <= 0.5) | (rec["width"] <= 0) | (rec["height"] <= 0))
    rows = rows.withColumns({"recorded_box_empty": empty, "box": F.when(rec.isNotNull() & ~empty, rec).otherwise(F.col("__f"))})
    e, dx, dy = F.col("__e"), F.col("__d")[0] * hs, F.col("__d")[1] * hs
    sx, sy = F.sqrt(e[0] * e[0] + e[1] * e[1]) * hs, F.sqrt(e[2] * e[2] + e[3] * e[3])
    natural = F.abs(F.col("advance") * F.col("font_size") * F.greatest(F.lit(0.0001), F.sqrt(dx * dx + dy * dy)))
    return rows.withColumns(
        {
            "has_recorded_box": rec.isNotNull(),
            "geometry_reliable": agree(rec, F.col("__f")),
            "transform_scale_ratio": F.coalesce(sx / F.nullif(sy, F.lit(0.0)), F.lit(0.0)),
            "glyph_width_ratio": F.coalesce(F.least(F.lit(2.0), extent_along(F.col("box"), dx, dy) / F.nullif(natural, F.lit(0.0))), F.lit(1.0)),
            "font_size": F.col("font_size") * F.greatest(F.lit(0.0001), sy),
        }
    ).drop("__e", "__d", "__f", "ctm", "text_matrix", "text_x", "text_y", "rise", "advance", "kind")
