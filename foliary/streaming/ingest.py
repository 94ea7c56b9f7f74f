"""Incremental ingest that takes each content once, however often a stream brings it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incoming_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of files with their content hash, the key of all further tables."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("doc_hash", F.sha2("content", 256))


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """One row a key within the delay; state older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str):
    """Appends the first row of each key that the stream brings. Keys are the query's state, spread over its partitions, so a batch
    costs what it holds and never reads the target; the checkpoint numbers batches, and the sink takes each once, so a restart adds
    nothing twice."""
    return stream.dropDuplicates([key]).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
