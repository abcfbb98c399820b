"""Batch readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import schemas
from tapeloom.sources import paths


def lake_range(spark: SparkSession, path: str, start: str, end: str, partition: str = "ingest_date") -> DataFrame:
    """Rows of the half-open date range; only its partitions are listed and read."""
    d = F.col(partition)
    return spark.read.parquet(path).filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))


def parquet_as(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet under a given schema; columns the files lack are NULL."""
    return spark.read.schema(schema).parquet(path)


def employees(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.EMPLOYEE)


def csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the relational tables from CSV with a header."""
    return (
        spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST")
        .schema(schemas.relational_schema(table)).csv(path)
    )


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of documents. A file is one task: keep them bounded."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_files(spark: SparkSession, locations: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines from many files or globs; locations and files that are gone are skipped."""
    wanted = [locations] if isinstance(locations, str) else locations
    present = [p for p in wanted if paths.matches(spark, p)]
    if not present:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreMissingFiles", True).json(present)


def exported(
    spark: SparkSession, base: str, data_type: str, partition: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """An export read back, optionally one partition of it; nothing exported is an empty frame."""
    path = f"{base.rstrip('/')}/{data_type}"
    if not paths.exists(spark, path):
        return spark.createDataFrame([], schema or T.StructType())
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    for name, value in (partition or {}).items():
        df = df.filter(F.col(name) == F.lit(value).cast(df.schema[name].dataType))
    return df


def jdbc_table(
    spark: SparkSession, url: str, table: str, columns: Sequence[str], properties: Mapping[str, str],
    split: tuple[str, int, int, int],
) -> DataFrame:
    """Columns of a database table, read in parallel by ``split`` = (column, low, high, parts)."""
    column, low, high, parts = split
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
        .option("partitionColumn", column).option("lowerBound", low)
        .option("upperBound", high).option("numPartitions", parts).load().select(*columns)
    )


def company_extract(companies: DataFrame) -> DataFrame:
    """The seven columns the lake keeps of the relational companies, all as text."""
    return companies.select(*[F.col(f.name).cast("string").alias(f.name) for f in schemas.COMPANY_LAKE.fields])
