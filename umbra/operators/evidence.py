"""Evidence that relates texts of a page to its paints, other texts, extracted items and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.geometry import box, coverage, expanded
from umbra.functions.instruction import folded, has_instruction
from umbra.functions.invisible import contains_invisible, inspect
from umbra.functions.text import comparable, let, nfkc, squeeze, trim, utf16_length, where_once
from umbra.operators.scoring import severity, total

GRID = (16, 8)
SOLID = 0.85


def by_recorded_box(drafts: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Drafts with the recorded box of their operation (page-normalised edges), scaled to the page; null where it is missing or empty."""
    edges = boxes.select(*page, "operation_index", "min_x", "min_y", "max_x", "max_y")
    rows = drafts.join(edges, [*page, "operation_index"], "left")
    finite = F.lit(True)
    for c in ("min_x", "min_y", "max_x", "max_y"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    wide, high = F.col("page_width"), F.col("page_height")
    found = box(F.col("min_x") * wide, F.col("min_y") * high, F.greatest(F.lit(0.0), (F.col("max_x") - F.col("min_x")) * wide), F.greatest(F.lit(0.0), (F.col("max_y") - F.col("min_y")) * high))
    return rows.withColumn("recorded_box", F.when(finite, found)).drop("min_x", "min_y", "max_x", "max_y")


def later_paints(candidates: DataFrame, paints: DataFrame, page: list[str]) -> DataFrame:
    """Pairs of a candidate and each paint drawn after it: page, operation_index, paint_index."""
    p = paints.select(*page, F.col("operation_index").alias("paint_index"))
    return candidates.select(*page, "operation_index").join(p, page).where("paint_index > operation_index")


def occlusion(candidates: DataFrame, paints: DataFrame, page: list[str]) -> DataFrame:
    """Add later_occlusion_ratio and later_occluder_indices.

    A grid of 16 by 8 points in each box is tested against the paints drawn later that
    are nearly opaque. The paints of a page are gathered once, so a page is one join
    row and no pair of text and paint is shuffled.
    """
    solid = paints.where(F.col("alpha") >= SOLID).select(*page, F.struct("operation_index", "box").alias("p"))
    of_page = solid.groupBy(*page).agg(F.array_sort(F.collect_list("p")).alias("__paints"))
    rows = candidates.join(of_page, page, "left")
    later = F.filter(F.coalesce("__paints", F.array().cast(of_page.schema["__paints"].dataType)), lambda p: p["operation_index"] > F.col("operation_index"))
    wide, high = GRID

    def covers(p: Column, x: Column, y: Column) -> Column:
        b = p["box"]
        return (x >= b["x"]) & (x <= b["x"] + b["width"]) & (y >= b["y"]) & (y <= b["y"] + b["height"])

    # paints that miss the box are dropped before the points are tried
    b = F.col("box")
    touching = F.filter(later, lambda p: (p["box"]["x"] <= b["x"] + b["width"]) & (p["box"]["x"] + p["box"]["width"] >= b["x"]) & (p["box"]["y"] <= b["y"] + b["height"]) & (p["box"]["y"] + p["box"]["height"] >= b["y"]))
    cells = F.sequence(F.lit(0), F.lit(wide * high - 1))
    at = lambda i: (b["x"] + b["width"] * (i % wide + 0.5) / wide, b["y"] + b["height"] * (F.floor(i / wide) + 0.5) / high)

    def of(found: Column) -> Column:
        hit = F.filter(cells, lambda i: F.exists(found, lambda p: covers(p, *at(i))))
        used = F.filter(found, lambda p: F.exists(cells, lambda i: covers(p, *at(i))))
        return F.struct((F.size(hit) / (wide * high)).alias("ratio"), F.array_sort(F.array_distinct(F.transform(used, lambda p: p["operation_index"]))).alias("by"))

    nothing = F.struct(F.lit(0.0).alias("ratio"), F.array().cast("array<int>").alias("by"))
    found = F.when((b["width"] > 0) & (b["height"] > 0) & F.col("__paints").isNotNull(), let(touching, of)).otherwise(nothing)
    rows = rows.withColumn("__o", found)
    return rows.withColumns({"later_occlusion_ratio": F.col("__o.ratio"), "later_occluder_indices": F.col("__o.by")}).drop("__o", "__paints")


def replacement_text(candidates: DataFrame, page: list[str]) -> DataFrame:
    """Add has_nearby_replacement_text: a covered text that is drawn anew, alike and close by, shortly after its last cover."""
    own = candidates.where((F.col("later_occlusion_ratio") >= 0.98) & (F.size("later_occluder_indices") > 0) & (F.col("box.height") > 0))
    own = own.select(*page, "operation_index", F.array_max("later_occluder_indices").alias("last"), F.col("box").alias("b"), F.col("font_size").alias("f"))
    shown = candidates.where(~F.col("hidden_by_clipping") & ~F.col("hidden_by_optional_content") & (F.col("rendering_mode") != 3) & (F.col("fill_alpha") > 0.5) & (F.col("later_occlusion_ratio") < 0.5))
    shown = shown.select(*page, F.col("operation_index").alias("other"), F.col("box").alias("o"), F.col("font_size").alias("g"))
    gap = F.col("o.y") - (F.col("b.y") + F.col("b.height"))
    near = (
        F.col("other").between(F.col("last") + 1, F.col("last") + 20) & (F.greatest("f", "g") > 0) & (F.least("f", "g") >= F.greatest("f", "g") * 0.85)
        & (F.abs(F.col("b.x") - F.col("o.x")) <= F.greatest(F.lit(12.0), F.col("b.height") * 0.75)) & gap.between(F.col("b.height") * -0.25, F.col("b.height") * 1.5)
    )
    # what follows within 20 operations lies in one of two buckets of 20, so a page is not paired with itself
    bucket = lambda c: F.floor(c / 20)
    own = own.withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col("last") + 1), bucket(F.col("last") + 20)))))
    shown = shown.withColumn("__b", bucket(F.col("other")))
    marked = own.join(shown, [*page, "__b"]).where(near).select(*page, "operation_index").distinct().withColumn("has_nearby_replacement_text", F.lit(True))
    rows = candidates.drop("has_nearby_replacement_text").join(marked, [*page, "operation_index"], "left")
    return rows.withColumn("has_nearby_replacement_text", F.coalesce("has_nearby_replacement_text", F.lit(False)))


def exact_visible_match(candidates: DataFrame, items: DataFrame, page: list[str]) -> DataFrame:
    """Add has_exact_visible_text_match.

    Extracted items are matched by text without white space. A text matches if it is
    drawn as often as it is extracted and every item's box has strong contrast against
    the text's colour; ``items`` has str, box (null boxes do not count) and ``contrasts``,
    the colours that each box contrasts with.
    """
    drawn = candidates.withColumn("__key", squeeze(nfkc(F.col("text"))))
    counts = drawn.where("__key != ''").groupBy(*page, "__key").agg(F.count("*").alias("__drawn"))
    there = items.where("box IS NOT NULL").withColumn("__key", squeeze(nfkc(F.col("str")))).where("__key != ''")
    sets = there.groupBy(*page, "__key").agg(F.count("*").alias("__items"), F.collect_list("contrasts").alias("__contrasts"))
    keys = counts.join(sets, [*page, "__key"]).where("__drawn = __items").drop("__drawn", "__items")
    rows = drawn.join(keys, [*page, "__key"], "left")
    match = F.forall("__contrasts", lambda c: F.array_contains(c, F.col("fill_color")))
    return rows.withColumn("has_exact_visible_text_match", F.coalesce(F.col("fill_color").isNotNull() & match, F.lit(False))).drop("__key", "__contrasts")


def redraw_groups(candidates: DataFrame, page: list[str]) -> DataFrame:
    """Sets of occluders that a page is drawn again without: page, occluders, members."""
    wanted = (F.col("later_occlusion_ratio") >= 0.85) & (F.size("later_occluder_indices") > 0) & (utf16_length(trim(F.col("text"))) >= 2)
    rows = where_once(candidates, wanted).select(*page, F.array_join("later_occluder_indices", ",").alias("occluders"), "operation_index")
    return rows.groupBy(*page, "occluders").agg(F.array_sort(F.collect_list("operation_index")).alias("members"))


def extracted_detections(items: DataFrame, detections: DataFrame, page: list[str]) -> DataFrame:
    """Detections from extracted items with invisible Unicode that no drawn detection shows.

    ``items`` has item_index, str, box; ``detections`` display_text. Suspicious items at
    most three apart form a group, which is read with one item before and after it.
    """
    w = Window.partitionBy(*page).orderBy("item_index")
    odd = where_once(items, contains_invisible(F.col("str"))).select(*page, "item_index")
    odd = odd.withColumn("g", F.sum(F.when(F.col("item_index") - F.lag("item_index").over(w) <= 3, 0).otherwise(1)).over(w) - 1)
    groups = odd.groupBy(*page, "g").agg(F.min("item_index").alias("first"), F.max("item_index").alias("last"))
    reach = groups.withColumn("item_index", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)))
    near = reach.join(items.select(*page, "item_index", "str", "box"), [*page, "item_index"])
    inside = F.when(F.col("item_index").between(F.col("first"), F.col("last")), F.col("box"))
    read = near.groupBy(*page, "g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_index", "str"))), lambda s: s["str"]), "").alias("raw"),
        F.min(inside["x"]).alias("x0"), F.min(inside["y"]).alias("y0"), F.max(inside["x"] + inside["width"]).alias("x1"), F.max(inside["y"] + inside["height"]).alias("y1"),
    )
    seen = where_once(inspect(read, "raw"), F.size("u_signals") > 0)
    key = lambda c: F.lower(squeeze(c))
    seen = seen.withColumn("__own", key(F.col("u_semantic")))
    shown = inspect(detections.select(*page, "display_text"), "display_text", "d_").select(*page, key(F.col("d_semantic")).alias("__own")).where(F.length("__own") >= 2).distinct()
    fresh = seen.join(shown.withColumn("__shown", F.lit(True)), [*page, "__own"], "left").where("__shown IS NULL")
    told = F.when(has_instruction(folded(F.col("u_semantic"))), F.array(F.struct(F.lit("instruction-language").alias("kind"), F.lit(20).alias("score")))).otherwise(F.array().cast("array<struct<kind:string,score:int>>"))
    out = fresh.withColumn("signals", F.concat("u_signals", told)).withColumn("score", total(F.col("signals")))
    own = F.coalesce(F.when(F.col("x0").isNotNull(), box(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    return out.select(
        *page, F.concat(F.lit("p"), F.col("page_number"), F.lit("-unicode-"), F.col("g")).alias("id"), (F.col("g") + 1_000_000).cast("int").alias("operation_index"),
        F.substring("u_display", 1, 800).alias("display_text"), own.alias("box"), "score", severity(F.col("score")).alias("severity"), "signals",
    )


def auxiliary_only(c=F.col) -> Column:
    """Transparent, and hidden in no other way."""
    return (c("fill_alpha") <= 0.01) & (c("rendering_mode") != 3) & ~c("hidden_by_clipping") & ~c("hidden_by_optional_content") & ~contains_invisible(c("text"))


def preview_groups(candidates: DataFrame, images: DataFrame, links: DataFrame, page: list[str]) -> DataFrame:
    """Transparent texts that copy a linked slide: page, link_id, destination_page, operation_indices.

    A link (link_id, box, destination_page, destination_text) needs an image of about its
    own box, two texts or more inside it that are hidden by transparency alone, no
    instruction wording, and sixteen characters that all stand on the linked page.
    """
    i = images.select(*page, F.col("box").alias("i"))
    l = links.select(*page, "link_id", "destination_page", "destination_text", F.col("box").alias("l"))
    pictured = l.join(i, page).where((coverage(F.col("l"), F.col("i")) >= 0.82) & (coverage(F.col("i"), F.col("l")) >= 0.82)).dropDuplicates([*page, "link_id"]).drop("i")
    c = candidates.where(auxiliary_only()).select(*page, "operation_index", "text", F.col("box").alias("b"))
    inside = pictured.withColumn("l", expanded(F.col("l"))).join(c, page).where(coverage(F.col("b"), F.col("l")) >= 0.97)
    groups = inside.groupBy(*page, "link_id").agg(F.first("destination_page").alias("destination_page"), F.first("destination_text").alias("destination_text"), F.array_sort(F.collect_list(F.struct("operation_index", trim(F.col("text")).alias("t")))).alias("m"))
    said = groups.where(F.size("m") >= 2).withColumn("said", F.array_join(F.transform("m", lambda x: x["t"]), " "))
    said = said.withColumns({"__plain": comparable(nfkc(F.col("said"))), "__there": comparable(nfkc(F.coalesce("destination_text", F.lit("")))), "__told": has_instruction(folded(F.col("said")))})
    good = ~F.col("__told") & (utf16_length(F.col("__plain")) >= 16) & F.contains(F.col("__there"), F.col("__plain"))
    return where_once(said, good).select(*page, "link_id", "destination_page", F.transform("m", lambda x: x["operation_index"]).alias("operation_indices"))


def suppressed_operations(groups: DataFrame, page: list[str]) -> DataFrame:
    return groups.select(*page, F.explode("operation_indices").alias("operation_index")).distinct()


def needs_fallback(candidates: DataFrame, detections: DataFrame, page: list[str]) -> DataFrame:
    """Pages whose own texts are odd enough that copies of them are not excused."""
    odd = (F.col("fill_alpha") <= 0.15) | (F.col("rendering_mode") == 3) | F.col("hidden_by_clipping") | F.col("hidden_by_optional_content") | contains_invisible(F.col("text"))
    return where_once(candidates, odd).select(*page).union(detections.select(*page)).distinct()


def kept_detections(detections: DataFrame, candidates: DataFrame, groups: DataFrame, page: list[str], document: list[str]) -> DataFrame:
    """Detections without suppressed ones, but with those whose linked page is odd itself.

    One join is enough: what would be restored holds transparent texts, so its page is odd already.
    """
    gone = suppressed_operations(groups, page)
    kept = detections.join(gone, [*page, "operation_index"], "left_anti")
    odd = needs_fallback(candidates, kept, page).withColumnRenamed("page_number", "destination_page")
    back = groups.join(odd, [*document, "destination_page"], "left_semi")
    restored = detections.join(suppressed_operations(back, page), [*page, "operation_index"], "left_semi")
    return kept.unionByName(restored).dropDuplicates([*page, "id"])


def link_destinations(links: DataFrame, pages: DataFrame, document: list[str]) -> DataFrame:
    """Internal links with a page to go to: subtype Link, no address, a rectangle of four finite numbers, a page from 1 to the last."""
    fine = (F.col("subtype") == "Link") & F.col("url").isNull() & F.col("unsafe_url").isNull() & (F.size("rect") >= 4)
    fine = fine & F.forall(F.slice("rect", 1, 4), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    last = pages.groupBy(*document).agg(F.max("page_number").alias("__last"))
    return links.where(F.coalesce(fine, F.lit(False))).join(last, document).where(F.col("dest_page").between(1, F.col("__last"))).drop("__last")


def page_texts(items: DataFrame, page: list[str]) -> DataFrame:
    """The items of each page as one text, a blank between them."""
    return items.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_index", "str"))), lambda s: s["str"]), " ").alias("page_text"))

