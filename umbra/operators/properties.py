"""Document properties: values flattened, inspected and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.instruction import folded, has_instruction
from umbra.functions.invisible import inspect
from umbra.functions.text import INLINE, where_once
from umbra.operators.scoring import severity, total

#: Readable names of the standard properties, as the report shows them; fixed values.
NAMES = {"Title": "タイトル", "Author": "作成者", "Subject": "件名", "Keywords": "キーワード", "Creator": "作成アプリ", "Producer": "PDF生成ソフト"}
MOST_CHARS = 20_000
SLIDES = f"(?i)microsoft{INLINE}{{0,12}}powerpoint|powerpoint{INLINE}{{0,12}}microsoft"


def property_values(entries: DataFrame) -> DataFrame:
    """doc_id, position, source, value: of entries (doc_id, ord, origin info/xmp, source, value) the distinct ones, info first.

    Values are cut at 20,000 characters, null and empty ones dropped; position counts from 0.
    """
    rows = entries.select("doc_id", "ord", (F.col("origin") != "info").alias("late"), F.when(F.col("origin") == "xmp", F.concat(F.lit("XMP: "), F.col("source"))).otherwise(F.col("source")).alias("source"), F.substring("value", 1, MOST_CHARS).alias("value"))
    first = rows.where("value IS NOT NULL AND value != ''").groupBy("doc_id", "source", "value").agg(F.min(F.struct("late", "ord")).alias("at"))
    w = Window.partitionBy("doc_id").orderBy("at", "source", "value")
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return first.select("doc_id", (F.row_number().over(w) - 1).alias("position"), F.coalesce(F.try_element_at(names, F.col("source")), F.col("source")).alias("source"), "value")


def property_detections(entries: DataFrame, normalise: bool = True) -> DataFrame:
    """Property values with invisible Unicode or instruction wording: doc_id, id, source, text, score, severity, signals."""
    df = inspect(property_values(entries), "value", "u_", normalise)
    told = F.when(has_instruction(folded(F.col("u_semantic"))), F.array(F.struct(F.lit("metadata-instruction").alias("kind"), F.lit(25).alias("score")))).otherwise(F.array().cast("array<struct<kind:string,score:int>>"))
    df = where_once(df.withColumn("signals", F.concat("u_signals", told)), F.size("signals") > 0).withColumn("score", total(F.col("signals")))
    return df.select("doc_id", F.concat(F.lit("metadata-"), F.col("position")).alias("id"), "source", F.substring("u_display", 1, 800).alias("text"), "score", severity(F.col("score")).alias("severity"), "signals")


def made_by_slides(entries: DataFrame) -> DataFrame:
    """doc_id, is_slides: whether a creator or producer property names the slide program."""
    key = F.when(F.col("origin") == "info", F.rlike("source", F.lit("(?i)creator|producer"))).otherwise(F.rlike("source", F.lit("(?i)creator.?tool|producer")))
    return entries.groupBy("doc_id").agg(F.coalesce(F.bool_or(key & F.rlike("value", F.lit(SLIDES))), F.lit(False)).alias("is_slides"))
