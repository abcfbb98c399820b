"""Writing Parquet: day-partitioned lake, exports, compaction, versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import prices
from tapeloom.functions.timing import iso_week_parts
from tapeloom.sources import paths

TARGET_FILE_BYTES = 256 * 1024 * 1024
ROWS_PER_FILE = 2_000_000
#: Folder of a table in which a compaction stages its partitions; readers pass over it.
STAGED = "_compacting"


def spread_by(df: DataFrame, *partitions: str) -> DataFrame:
    """Bring rows of one output partition together without putting a big one into one task.

    AQE splits partitions of a rebalance that exceed the advisory size and joins small ones,
    so a day with a third of all rows is written by many tasks and a small day by one.
    """
    return df.hint("rebalance", *partitions)


def write_lake(
    df: DataFrame, path: str, partitions: Sequence[str] = ("ingest_date",), mode: str = "append",
    rows_per_file: int = ROWS_PER_FILE, spread: bool = True,
) -> None:
    """Hive-partitioned Parquet; 'overwrite' replaces only the partitions that ``df`` has.

    Without ``spread`` rows stay in their tasks: no shuffle, and a file per task and partition.
    """
    writer = (
        (spread_by(df, *partitions) if spread else df).write.mode(mode).partitionBy(*partitions)
        .option("compression", "snappy").option("maxRecordsPerFile", rows_per_file)
    )
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def dead_letters(df: DataFrame, date_col: str = "ingest_date") -> tuple[DataFrame, DataFrame]:
    """Rows with a date, and those without."""
    return df.filter(F.col(date_col).isNotNull()), df.filter(F.col(date_col).isNull())


EXPORT_PARTITIONS = {"day": ("date",), "week": ("year", "week"), "month": ("year", "month")}


def with_export_partitions(df: DataFrame, ts: Column, partition_by: str = "day") -> DataFrame:
    """Partition columns of an export: date, ISO year and week, or year and two-digit month."""
    d = ts.cast("date")
    if partition_by == "day":
        return df.withColumn("date", d)
    if partition_by == "week":
        return df.withColumns(iso_week_parts(d))
    if partition_by == "month":
        return df.withColumns({"year": F.year(d), "month": F.date_format(d, "MM")})
    raise ValueError(f"unknown granularity {partition_by!r}")


def export_bars(
    enriched: DataFrame, path: str, start, end, partition_by: str = "day", processed: str = "processed_at"
) -> None:
    """Processed bars within ``[start, end]``, both inclusive, by day, week or month."""
    ti = F.col("technical_indicators")
    ts = F.timestamp_millis("t")
    chosen = enriched.filter(F.col(processed).between(start, end)).select(
        ts.alias("timestamp"), "ticker",
        F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"),
        F.col("v").alias("volume"), F.col("vw").alias("vwap"),
        prices.notional(F.col("h"), F.col("l"), F.col("c"), F.col("v")).alias("volume_weighted_price"),
        ti["price_range"].alias("price_range"), ti["price_range_pct"].alias("price_range_pct"),
        F.col(processed).alias("processed_at"),
    )
    shaped = with_export_partitions(chosen, F.col("timestamp"), partition_by)
    write_lake(shaped, f"{path}/ohlc", EXPORT_PARTITIONS[partition_by], "overwrite")


def export_news(enriched: DataFrame, path: str, start, end, processed: str = "processed_at") -> None:
    """Processed articles within ``[start, end]``, both inclusive, by day of publication."""
    s = F.col("sentiment_summary")
    chosen = enriched.filter(F.col(processed).between(start, end)).select(
        F.col("published_at").alias("timestamp"),
        F.try_element_at(s["tickers"], F.lit(1))["ticker"].alias("ticker"),
        "title", "url", s["overall_score"].alias("sentiment_score"),
        s["overall_sentiment"].alias("overall_sentiment"), "source", F.col(processed).alias("processed_at"),
    )
    shaped = with_export_partitions(chosen, F.col("timestamp"))
    write_lake(shaped, f"{path}/news_sentiment", EXPORT_PARTITIONS["day"], "overwrite")


def small_file_partitions(spark: SparkSession, path: str, min_files: int = 5) -> DataFrame:
    """Partition folders with at least ``min_files`` files, their file count and bytes.

    Only file metadata is read.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    return (
        files.groupBy(folder.alias("folder"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        .filter(F.col("files") >= min_files)
    )


def into_files(rows: DataFrame, text: Column, files: dict[str, int]) -> DataFrame:
    """Rows of a stored table dealt to as many writers per value of ``text`` as ``files`` says; a big partition is never one task."""
    many = {k: n for k, n in files.items() if n > 1}
    salt = F.lit(0)
    if many:
        counts = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
        at = F.xxhash64("_metadata.file_path", "_metadata.row_index")
        salt = F.pmod(at, F.coalesce(F.try_element_at(counts, text), F.lit(1)).cast("long"))
    return rows.withColumn("_salt", salt).repartition(sum(files.values()), text, "_salt").drop("_salt")


def compact(
    spark: SparkSession, path: str, partition: str = "ingest_date", min_files: int = 5,
    target_bytes: int = TARGET_FILE_BYTES,
) -> int:
    """Rewrite partitions of many small files into files of about ``target_bytes``.

    The rows are staged beside the table first and then take the place of the partitions, so
    a failure on the way leaves the old files or a complete staged copy. Returns the number
    of partitions rewritten. The driver sees one row per such partition.
    """
    finish_compaction(spark, path)
    crowded = small_file_partitions(spark, path, min_files)
    value = F.regexp_extract("folder", f"{partition}=([^/]+)", 1)
    sizes = {x["value"]: (x["files"], x["bytes"]) for x in crowded.select(value.alias("value"), "files", "bytes").collect()}
    # A partition that needs as many files as it has gains nothing.
    todo = {k: -(-b // target_bytes) for k, (n, b) in sizes.items() if -(-b // target_bytes) < n}
    if not todo:
        return 0
    table = spark.read.parquet(path)
    text = F.col(partition).cast("string")
    rows = table.filter(text.isin(list(todo)))
    staged = f"{path.rstrip('/')}/{STAGED}"
    into_files(rows, text, todo).write.mode("overwrite").partitionBy(partition).parquet(staged)
    finish_compaction(spark, path)
    return len(todo)


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Put the partitions of a complete staged copy into their places; what is incomplete is thrown away.

    Rows are written once, by the staging. A partition is missing only between the removal
    of its old files and one rename, and a compaction that stopped there is finished by the
    next one, or by calling this.
    """
    staged = f"{path.rstrip('/')}/{STAGED}"
    if paths.exists(spark, f"{staged}/_SUCCESS"):
        for name in paths.children(spark, staged):
            if "=" in name:
                paths.delete(spark, f"{path}/{name}")
                paths.rename(spark, f"{staged}/{name}", f"{path}/{name}")
    paths.delete(spark, staged)


def publish_days(spark: SparkSession, landing: str, path: str, start: str, end: str) -> None:
    """Days ``[start, end)`` of a stream's landing folder, one folder per batch, as compact lake days.

    A day is always written from all its batches and replaces the day in the lake, so
    publishing may be repeated, also after late batches.
    """
    d = F.col("ingest_date")
    days = spark.read.parquet(landing).filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))
    write_lake(days.drop("batch_id"), path, mode="overwrite")


def replace_table(df: DataFrame, path: str) -> None:
    """Replace an unpartitioned table, even one that ``df`` reads.

    The new content is written beside the old and then takes its place by two renames.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    if paths.exists(spark, path):
        paths.delete(spark, old)
        paths.rename(spark, path, old)
    paths.rename(spark, fresh, path)
    paths.delete(spark, old)


def recover_table(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement that stopped between its renames."""
    if not paths.exists(spark, path) and paths.exists(spark, f"{path}.old"):
        source = f"{path}.new" if paths.exists(spark, f"{path}.new/_SUCCESS") else f"{path}.old"
        paths.rename(spark, source, path)


def truncate(spark: SparkSession, path: str, *dependents: str) -> None:
    """Empty a table, and on request those that refer to it, keeping their schemas."""
    for p in (path, *dependents):
        schema = spark.read.parquet(p).schema
        replace_table(spark.createDataFrame([], schema), p)
