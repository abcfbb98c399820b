"""News stored for searches by a pattern on tickers.

Three tables: the articles by day and cell, postings that say in which day and cell, and as
which row, each ticker is mentioned, and the dictionary of tickers. A pattern is matched
against the dictionary, once per ticker and not once per mention; the postings of the
tickers found name the days and cells to open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tapeloom.sinks.lake import spread_by

DAY, CELL, ROW = "index_day", "index_cell", "index_row"
UNDATED = "undated"


def _day(time: Column) -> Column:
    """Folder name of the day of a compact time."""
    return F.coalesce(F.concat(F.lit("d"), F.substring(time, 1, 8)), F.lit(UNDATED))


def write_index(
    articles: DataFrame, path: str, tickers: str = "ticker_sentiment", time: str = "time_published", rows_per_cell: int = 100_000
) -> None:
    """Store articles for ``search``; ``tickers`` is an array of mentions, ``time`` a compact time.

    A day of many articles has many cells, so no cell exceeds about ``rows_per_cell`` rows.
    """
    spark = articles.sparkSession
    dated = articles.withColumns({DAY: _day(F.col(time)), ROW: F.monotonically_increasing_id()})
    cells = articles.groupBy(_day(F.col(time)).alias(DAY)).agg(F.ceil(F.count(F.lit(1)) / rows_per_cell).alias("_cells"))
    placed = dated.join(cells, DAY).withColumn(CELL, F.pmod(F.xxhash64(ROW), F.col("_cells")).cast("int")).drop("_cells")
    spread_by(placed, DAY, CELL).write.mode("overwrite").partitionBy(DAY, CELL).parquet(f"{path}/articles")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    stored = _stored(spark, path, "articles")
    names = F.array_distinct(F.transform(tickers, lambda m: m["ticker"]))
    postings = stored.select(F.explode(names).alias("ticker"), DAY, CELL, ROW).filter(F.col("ticker").isNotNull())
    # Sorted, so that the footers of the files tell which of them hold a ticker.
    spread_by(postings, DAY).sortWithinPartitions(DAY, "ticker").write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/postings")
    _stored(spark, path, "postings").groupBy("ticker").agg(F.count(F.lit(1)).alias("articles")).write.mode("overwrite").parquet(f"{path}/tickers")


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the store, which may be without files."""
    fields = spark.read.parquet(f"{path}/columns").schema
    schema = fields if name == "articles" else StructType([StructField("ticker", StringType()), *[fields[x] for x in (DAY, CELL, ROW)]])
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Days of a range of compact times; what has no day is in no range."""
    if start is not None:
        df = df.filter((F.col(DAY) >= f"d{start[:8]}") & (F.col(DAY) != UNDATED))
    if end is not None:
        df = df.filter((F.col(DAY) <= f"d{end[:8]}") & (F.col(DAY) != UNDATED))
    return df


def search(
    spark: SparkSession, path: str, pattern: str | None = None, start: str | None = None, end: str | None = None,
    time: str = "time_published",
) -> DataFrame:
    """Articles whose mentions match a case-insensitive pattern, within a range of compact times; as ``documents.find_news``.

    The driver sees the days that hold hits and the cell numbers of a day: both bounded by
    the folders of the table. As literals they keep other folders from being opened.
    """
    articles = _between(_stored(spark, path, "articles"), start, end)
    if start is not None:
        articles = articles.filter(F.col(time) >= start)
    if end is not None:
        articles = articles.filter(F.col(time) <= end)
    if pattern:
        tickers = spark.read.parquet(f"{path}/tickers").filter(F.rlike("ticker", F.lit(f"(?i){pattern}"))).select("ticker")
        hits = _between(_stored(spark, path, "postings"), start, end).join(tickers, "ticker").select(DAY, CELL, ROW)
        where = hits.agg(F.collect_set(DAY).alias("days"), F.collect_set(CELL).alias("cells")).first()
        opened = articles.filter(F.col(DAY).isin(where["days"]) & F.col(CELL).isin(where["cells"]))
        articles = opened.join(hits, [DAY, CELL, ROW], "left_semi")
    return articles.drop(DAY, CELL, ROW)
