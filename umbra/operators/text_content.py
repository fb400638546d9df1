"""Extracted text streams: chunks of a page put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "struct<str:string,transform:array<double>,width:double>"


def merged_chunks(chunks: DataFrame, page: list[str]) -> DataFrame:
    """One row per page of chunks (chunk_seq, items array, styles map, lang): items in order, styles with later ones winning, the first language given."""
    rows = chunks.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "items", F.map_entries("styles").alias("styles"), "lang"))).alias("c"))
    styles = F.flatten(F.transform("c", lambda c: c["styles"]))
    latest = F.filter(styles, lambda s, i: ~F.exists(F.slice(styles, i + 2, F.greatest(F.size(styles) - i - 1, F.lit(0))), lambda t: t["key"] == s["key"]))
    return rows.select(*page, F.flatten(F.transform("c", lambda c: c["items"])).alias("items"), F.map_from_entries(latest).alias("styles"), F.get(F.filter(F.transform("c", lambda c: c["lang"]), F.isnotnull), F.lit(0)).alias("lang"))


def shaped_items(raw: DataFrame, page: list[str], column: str = "json") -> DataFrame:
    """Items of JSON lines that have a text, a transform list and a width; all others are dropped."""
    v = F.try_parse_json(column)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    good = (kind("$.str") == "STRING") & F.startswith(kind("$.transform"), F.lit("ARRAY")) & F.rlike(kind("$.width"), F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"))
    rows = raw.where(F.coalesce(good, F.lit(False)))
    return rows.select(*page, F.try_variant_get(v, "$.str", "string").alias("str"), F.try_variant_get(v, "$.transform", "array<double>").alias("transform"), F.try_variant_get(v, "$.width", "double").alias("width"))
