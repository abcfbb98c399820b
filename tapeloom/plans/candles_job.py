"""Candle warehouse job: facts and the time dimension from one lake range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import candles, merge
from tapeloom.plans.news_job import time_dimension
from tapeloom.sinks import lake as lake_sink
from tapeloom.sources import paths
from tapeloom.sources.readers import lake_range


def merge_dimension(spark: SparkSession, path: str, staged: DataFrame, key: str) -> None:
    """Insert what the dimension lacks; the first load creates it."""
    if not paths.exists(spark, path):
        staged.dropDuplicates([key]).write.parquet(path)
        return
    current = spark.read.parquet(path)
    # Only the missing rows are written, so the dimension itself is not rewritten.
    merge.new_rows(staged, current, [key]).select(*current.columns).write.mode("append").parquet(path)


def run(spark: SparkSession, lake_path: str, warehouse: str, start: str, end: str) -> None:
    """Load ``[start, end)``. Facts replace their days, so overlapping runs do not repeat rows."""
    days = lake_range(spark, lake_path, start, end)
    lake_sink.write_lake(candles.candle_facts(days), f"{warehouse}/fact_candles", mode="overwrite")
    merge_dimension(spark, f"{warehouse}/dim_time", time_dimension(days), "time_id")


def star(facts: DataFrame, companies: DataFrame, time: DataFrame) -> DataFrame:
    """Facts with their dimensions. Whether a dimension is broadcast is left to its measured size."""
    return facts.join(companies, F.col("candle_company_id") == F.col("company_id")).join(
        time, F.col("candle_time_id") == F.col("time_id")
    )
