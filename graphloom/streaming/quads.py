"""Streams of statements: files that arrive are parsed as they come; handlers get batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ntriples


def stream_lines(spark: SparkSession, path: str, mode: str = "DROPMALFORMED", files_per_batch: int = 100, flatten: bool = False) -> DataFrame:
    """Quads of the N-Triples or N-Quads files that arrive in a folder, as a streaming DataFrame."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return ntriples.parse_lines(lines, mode, flatten=flatten)


def for_each(quads: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Call handler(batch, number) for every batch; an error in it stops the stream. Returns the running query."""
    writer = quads.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_to(quads: DataFrame, path: str, checkpoint: str, buckets: int = 16, once: bool = True):
    """Append a stream to Parquet files of quads, split by predicate; each file arrives once (checkpointed sink)."""
    out = quads.withColumn("b", F.pmod(F.xxhash64("p"), F.lit(buckets)).cast("int"))
    writer = out.writeStream.format("parquet").partitionBy("b").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts(quads: DataFrame) -> DataFrame:
    """Running number of statements by graph and predicate; for output mode complete or update."""
    return quads.groupBy("g", "p").agg(F.count("*").alias("n"))


def matching(quads: DataFrame, predicate: str, right: DataFrame, on: str = "s") -> DataFrame:
    """Statements of a predicate joined with a static relation on their subject (s) or object (o)."""
    return quads.where(F.col("p") == predicate).join(right, on)
