"""Continuous ingestion of files: each batch goes through the same steps as a one-off run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash


def file_stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """New files below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def without_copies(files: DataFrame, within: str = "1 day") -> DataFrame:
    """Files whose content has not been met within a span of time; the state is dropped after it."""
    return files.withColumn("hash", content_hash(F.col("content"))).withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["hash"])


def ingest_stream(files: DataFrame, step: Callable[[DataFrame], None], checkpoint: str, available_now: bool = True):
    """Run ``step``, which must bear to see a batch again, on each batch of files."""
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: step(batch))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
