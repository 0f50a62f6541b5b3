"""PDF files that arrive in a folder, audited as a stream: stateless for each file, so no watermark and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources import pdf

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_events(spark: SparkSession, folder: str, most_bytes: int = 100 << 20, most_pages: int = 1000, files_per_batch: int = 1000) -> DataFrame:
    """pdf.EVENTS of each file once, as it arrives."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.filter(F.col("length") <= most_bytes).select("path", "content").mapInArrow(pdf._decoding(None, most_pages), pdf.EVENTS)


def run_once(events: DataFrame, out: str, checkpoint: str) -> None:
    """Append what is new to Parquet files, then stop. The checkpoint makes each file count once, restarts included."""
    events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
