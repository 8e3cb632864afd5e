"""Streams of arriving files and records through the same parsers and checks as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellwright.operators.quality import mask
from cellwright.sources.parsers import parse_sources
from cellwright.sources.readers import detect_content_type

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_elements(spark: SparkSession, folder: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """Elements of files as they arrive in a folder, bad files as error rows; a narrow stream without state."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return parse_sources(files.select(F.col("path").alias("source_id"), detect_content_type(F.col("path")).alias("content_type"), "content"))


def mask_counts(rows: DataFrame, column: str, time: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of a column's masks by time window; what comes later than ``late`` is not counted.

    The state is one counter a window and mask, and goes when the watermark passes the window.
    """
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), mask(F.col(column)).alias("mask")).agg(F.count("*").alias("n")).select("window.start", "window.end", "mask", "n")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what has arrived to Parquet, exactly once by the checkpoint, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
