"""A table stored in page order, with a directory of where its rows lie.

Rows are dealt by ranges of their order into parts of about ``rows_per_part`` rows, and the
directory keeps, for each part, how many rows come before it. A page opens the parts that
hold it and nothing else, near or deep, and nothing is counted for a request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of the stored rows beside the table's own: the part, and what tells equal rows apart.
PART, TIE = "page_part", "page_tie"


def write_pages(df: DataFrame, path: str, order: Sequence[str], rows_per_part: int = 500_000) -> None:
    """Store ``df`` for ``read_page``. Rows equal in ``order`` keep the places they get here, so pages never overlap."""
    spark, n = df.sparkSession, F.count(F.lit(1))
    parts = max(1, -(-df.count() // rows_per_part))
    tied = df.withColumn(TIE, F.monotonically_increasing_id())  # also spreads a group of equal rows over parts
    ranged = tied.repartitionByRange(parts, *order, TIE).withColumn(PART, F.spark_partition_id())
    ranged.sortWithinPartitions(PART, *order, TIE).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    stored = spark.read.schema(ranged.schema).parquet(f"{path}/rows").groupBy(PART).agg(n.alias("n"))
    # One row per part reaches these windows, never the data.
    upto = W.orderBy(PART)
    ends = stored.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(W.partitionBy())})
    ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, order: Sequence[str], page_id: int, n: int = 1000) -> DataFrame:
    """Page ``page_id`` (from 1) of ``n`` rows, with ``page_id`` and ``page_count`` on every row; beyond the end none."""
    skip = (page_id - 1) * n
    holding = (
        spark.read.parquet(f"{path}/directory")
        .filter((F.col("before") < skip + n) & (F.col("before") + F.col("n") > skip)).collect()  # at most n parts
    )
    columns = spark.read.parquet(f"{path}/columns")
    numbers = [F.lit(page_id).cast("long").alias("page_id")]
    if not holding:
        return columns.select(*numbers, F.lit(None).cast("long").alias("page_count"), "*")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/{PART}={x[PART]}" for x in holding])
    before = F.create_map(*[F.lit(y) for x in holding for y in (x[PART], x["before"])])
    rank = F.row_number().over(W.partitionBy(PART).orderBy(*order, TIE))
    placed = rows.withColumn("page_place", F.element_at(before, F.col(PART)) + rank)
    pages = F.lit(-(-holding[0]["total"] // n)).cast("long").alias("page_count")
    return placed.filter((F.col("page_place") > skip) & (F.col("page_place") <= skip + n)).select(*numbers, pages, *columns.columns)
