"""Streaming sources: message topics and growing folders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.sources import paths

# Topic names and their partition counts.
TOPICS = {
    "stock-news-sentiment": 8,
    "stock-ohlc-data": 10,
    "stock-company-info": 4,
    "stock-market-status": 2,
    "stock-data-dlq": 4,
}


# Rows and seconds after which a batch is due, for the lake and for the tables.
LAKE_FLUSH = (1000, 60)
SQL_FLUSH = (100, 30)


def kafka_messages(
    spark: SparkSession, brokers: str, topic: str, max_offsets: int | None = None, flush: tuple[int, int] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A topic from its earliest offset, as (key, value) text. Needs the Kafka connector on the classpath.

    ``flush`` = (rows, seconds): a batch waits for so many rows, but no longer than that.
    """
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
        .option("startingOffsets", "earliest").options(**(options or {}))
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    if flush:
        reader = reader.option("minOffsetsPerTrigger", flush[0]).option("maxTriggerDelay", f"{flush[1]}s")
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def text_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Message values from a growing folder of text files, one message per line."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def parquet_folder(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Only files not seen before are read at each trigger."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as a stream: one file, or a folder of parts."""
    schema = spark.read.parquet(path).schema
    if paths.is_folder(spark, path):
        return parquet_folder(spark, path, schema)
    folder, name = path.rsplit("/", 1)
    return parquet_folder(spark, folder, schema, name)


def decoded(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON values as ``data``, beside the raw ``value``; unreadable ones have a NULL record."""
    return messages.withColumn("data", F.from_json("value", schema, {"mode": "PERMISSIVE"}))


def valid(messages: DataFrame, required: str) -> DataFrame:
    return messages.filter(F.col("data")[required].isNotNull()).select("data.*")


def malformed(messages: DataFrame, required: str) -> DataFrame:
    """The dead letters: raw values whose record or required field could not be read."""
    return messages.filter(F.col("data").isNull() | F.col("data")[required].isNull()).select("value")
