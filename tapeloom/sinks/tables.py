"""Table sinks, keyed message rows, CSV, JSON bundles and routed collections."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Sink = Callable[[DataFrame], None]


def jdbc_sink(url: str, table: str, properties: Mapping[str, str], mode: str = "append", connections: int = 16) -> Sink:
    """Database table; at most ``connections`` tasks write at a time. Overwrite keeps the DDL."""

    def write(df: DataFrame) -> None:
        (
            df.write.mode(mode).format("jdbc").option("url", url).option("dbtable", table)
            .option("numPartitions", connections).option("batchsize", 10_000)
            .option("truncate", mode == "overwrite").options(**properties).save()
        )

    return write


def parquet_sink(path: str, mode: str = "append") -> Sink:
    def write(df: DataFrame) -> None:
        df.write.mode(mode).parquet(path)

    return write


def csv_sink(path: str, mode: str = "overwrite") -> Sink:
    def write(df: DataFrame) -> None:
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)

    return write


def keyed_messages(df: DataFrame, key: Column, source: str, now: Column | None = None) -> DataFrame:
    """Rows as (key, value) with a JSON value that carries a send time and its source."""
    stamp = F.current_timestamp() if now is None else now
    body = F.struct(*[F.col(c) for c in df.columns], stamp.alias("_kafka_timestamp"), F.lit(source).alias("_kafka_source"))
    return df.select(F.coalesce(key.cast("string"), F.lit("UNKNOWN")).alias("key"), F.to_json(body).alias("value"))


def kafka_sink(brokers: str, topic: str, options: Mapping[str, str] | None = None) -> Sink:
    def write(df: DataFrame) -> None:
        df.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).options(
            **(options or {})
        ).save()

    return write


def routed(df: DataFrame, route: Column, collections: Mapping[str, str]) -> DataFrame:
    """Adds the ``collection`` of each row; rows of an unknown type have none."""
    table = F.create_map(*[F.lit(x) for pair in collections.items() for x in pair])
    return df.withColumn("collection", F.try_element_at(table, route))


def write_routed(df: DataFrame, path: str, mode: str = "append", dead_path: str | None = None) -> int:
    """One pass writes every collection into its own folder. Returns the number of rows without a collection.

    These are counted on the way and left out; with ``dead_path`` they are written there.
    """
    told = Observation()
    unknown = F.col("collection").isNull()
    counted = df.observe(told, F.count_if(unknown).alias("unknown"))
    counted.filter(~unknown).write.mode(mode).partitionBy("collection").parquet(path)
    if dead_path:
        df.filter(unknown).drop("collection").write.mode(mode).parquet(dead_path)
    return told.get["unknown"]


def bundled(df: DataFrame, max_bytes: int) -> DataFrame:
    """`df` with ``slice`` and ``bundle``: rows of a slice in turn, a new bundle per ``max_bytes`` of JSON lines.

    A slice is a partition of the input, so no more rows meet than a task has read. A bundle
    holds the rows that begin within its bytes: at most ``max_bytes`` and the rest of one row.
    """
    sized = df.withColumns({
        "_at": F.monotonically_increasing_id(), "_bytes": F.octet_length(F.to_json(F.struct(*df.columns))) + 1,
    }).withColumn("slice", F.shiftright("_at", 33).cast("int"))
    before = W.partitionBy("slice").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("_bytes").over(before), F.lit(0))
    return sized.withColumn("bundle", F.floor(begins / max_bytes).cast("int")).drop("_at", "_bytes")


def write_json_bundles(df: DataFrame, path: str, max_bytes: int = 2 * 1024 * 1024) -> None:
    """JSON lines, one file per bundle below ``slice=…/bundle=…``.

    Files are many, so tasks put them in their places when they end, not the driver one by one. A task that
    is repeated replaces its files by those of the same names; _SUCCESS says that all are there.
    """
    writer = bundled(df, max_bytes).repartition("slice", "bundle").write.mode("overwrite").partitionBy("slice", "bundle")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def alert_channel(alerts: DataFrame, payload: list[str]) -> DataFrame:
    """Alerts as messages on the channel of their type."""
    return alerts.select(
        F.concat(F.lit("alerts:"), F.col("alert_type")).alias("channel"),
        F.to_json(F.struct(*payload)).alias("data"),
    )


def subscribe(messages: DataFrame, alert_types: list[str]) -> DataFrame:
    return messages.filter(F.col("channel").isin([f"alerts:{t}" for t in alert_types]))
