"""Incremental ingest: only files that have not been seen, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame], suffix: str = ".npy") -> None:
    """Convert the files of a folder that no earlier run has taken, and append the rows as Parquet."""
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    query = convert(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
