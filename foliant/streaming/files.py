"""Invoices as a stream of text files: each micro-batch is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.engine import Engine


def read(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, path, text, arrived of each text file that appears in a folder."""
    texts = spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.col("_metadata.file_path")
    return texts.select(F.xxhash64(name).alias("doc_id"), name.alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def extract(spark: SparkSession, folder: str, engine: Engine, out: str, checkpoint: str) -> StreamingQuery:
    """Responses of all files there are, as Parquet; a file counts once, however often the query is started."""
    return engine.local(read(spark, folder)).select("doc_id", "path", "status", "message", "fields", "unmapped_fields", "line_items").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_by_window(responses: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """How many files of each status arrived in each window; rows later than `late` are left out of it."""
    return responses.withWatermark("arrived", late).groupBy(F.window("arrived", window), "status").agg(F.count("*").alias("n")).select("window.start", "window.end", "status", "n")
