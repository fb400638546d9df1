"""A folder that documents are dropped into, read as a stream and analysed by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from umbra.operators.document import document_candidates, document_detections
from umbra.operators.properties import property_detections
from umbra.sources.pdf import read_operations


def watch_properties(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Property entries as JSON lines (doc_id, ord, origin, source, value): detections are appended to ``out`` once per file."""
    entries = spark.readStream.schema("doc_id string, ord int, origin string, source string, value string").json(folder)

    def batch(df: DataFrame, epoch: int) -> None:
        # a file name per epoch makes a repeated epoch overwrite itself
        property_detections(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_pdfs(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """PDF files dropped into a folder: their detections are appended to ``out``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

    def batch(df: DataFrame, epoch: int) -> None:
        document_detections(document_candidates(read_operations(df))).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
