"""Landing of daily bars and exports of the processed collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.timing import epoch_ms_to_date
from tapeloom.operators.documents import drop_if_present
from tapeloom.sinks import lake as lake_sink


def land_bars(landed: DataFrame, lake_path: str) -> None:
    """Landed bar files into the lake, by the day of the bar; landing a day again replaces it."""
    clean = drop_if_present(landed, "timestamp").withColumn("ticker", F.col("ticker").cast("string"))
    lake_sink.write_lake(clean.withColumn("ingest_date", epoch_ms_to_date(F.col("t"))), lake_path, mode="overwrite")


def export_all(bars: DataFrame, news: DataFrame, path: str, as_of, days_back: int = 30, partition_by: str = "day") -> None:
    """Everything processed in the ``days_back`` days up to ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"INTERVAL {int(days_back)} DAYS")
    lake_sink.export_bars(bars, path, start, end, partition_by)
    lake_sink.export_news(news, path, start, end)
