"""Candidate dumps as JSON, and detection reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.scoring import KINDS

BOX = "struct<x:double,y:double,width:double,height:double>"
CANDIDATE = (
    f"pageNumber int, operationIndex int, text string, box {BOX}, hasRecordedBox boolean, recordedBoxEmpty boolean, hiddenByClipping boolean, geometryReliable boolean, fontSize double, "
    "horizontalScale double, transformScaleRatio double, glyphWidthRatio double, fillColor string, fillColorKind string, fillAlpha double, renderingMode int, hiddenByOptionalContent boolean, "
    "surroundingColor array<int>, surroundingConfidence double, declaredInkRatio double, hasExactVisibleTextMatch boolean, laterOcclusionRatio double, occlusionChangeRatio double, "
    "laterOccluderIndices array<int>, hasNearbyReplacementText boolean"
)
DUMP = f"candidates array<struct<pageNumber:int,candidates:array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>>>"


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of dump files, one document per file: doc_id (the file's path) and the candidate columns."""
    raw = spark.read.schema(DUMP).option("multiLine", "true").json(path).withColumn("doc_id", F.input_file_name())
    rows = raw.select("doc_id", F.explode("candidates").alias("p")).select("doc_id", F.explode("p.candidates").alias("c"))
    names = [part.strip().split(" ")[0] for part in CANDIDATE.replace(BOX, "b").split(", ")]
    out = rows.select("doc_id", *(F.col(f"c.{n}").alias(snake(n)) for n in names))
    shade = F.col("surrounding_color")
    return out.withColumn("surrounding_color", F.when(F.size(shade) == 3, F.struct(shade[0].alias("r"), shade[1].alias("g"), shade[2].alias("b"))))


def labelled(signals: Column) -> Column:
    """Signals with a label for readers."""
    labels = F.create_map(*(F.lit(x) for kind, _, label in KINDS for x in (kind, label)))
    return F.transform(signals, lambda s: F.struct(s["kind"].alias("kind"), F.try_element_at(labels, s["kind"]).alias("label"), s["score"].alias("score")))


def report(documents: DataFrame, detections: DataFrame, properties: DataFrame) -> DataFrame:
    """One JSON report per document (doc_id, file_name, page_count): detections by page, property findings and the summary; no previews."""
    detections, properties = (df.withColumn("signals", labelled(F.col("signals"))) for df in (detections, properties))
    pages = detections.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "operation_index", "id", "display_text", "box", "score", "severity", "signals"))).alias("d"))
    pages = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.transform("d", lambda x: x.dropFields("o")).alias("detections")))).alias("pages"))
    found = properties.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "source", "text", "score", "severity", "signals"))).alias("document_detections"))
    every = detections.select("doc_id", "severity").unionByName(properties.select("doc_id", "severity"))
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    sums = every.groupBy("doc_id").agg(F.struct(count("high"), count("caution"), count("info")).alias("summary"))
    rows = documents.join(pages, "doc_id", "left").join(found, "doc_id", "left").join(sums, "doc_id", "left")
    name = F.concat(F.regexp_replace("file_name", r"(?i)\.pdf$", ""), F.lit("-report.json"))
    none = F.struct(*(F.lit(0).cast("long").alias(s) for s in ("high", "caution", "info")))
    body = F.struct("file_name", "page_count", F.coalesce("pages", F.array().cast(pages.schema["pages"].dataType)).alias("pages"), F.coalesce("document_detections", F.array().cast(found.schema["document_detections"].dataType)).alias("document_detections"), F.coalesce("summary", none).alias("summary"))
    return rows.select("doc_id", name.alias("report_name"), F.to_json(body, {"pretty": "true"}).alias("report"))
