"""Top-k, leaderboards, latest values and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leaderboard(values: DataFrame, name: str, value: str, ts: str, n: int = 10, ascending: bool = False) -> DataFrame:
    """Best ``n`` tickers by their latest value; ties follow the name, in the same direction."""
    latest = values.groupBy("ticker").agg(F.max_by(value, ts).alias(name))
    order = [F.asc(name), F.asc("ticker")] if ascending else [F.desc(name), F.desc("ticker")]
    return latest.orderBy(*order).limit(n)


def leaderboards(values: DataFrame, boards: Sequence[tuple[str, str, bool]], ts: str, n: int = 10) -> DataFrame:
    """Several boards (name, column, ascending) from one aggregate: (board, ticker, value), each as ``leaderboard``."""
    latest = values.groupBy("ticker").agg(F.max_by(F.struct(*sorted({c for _, c, _ in boards})), ts).alias("_latest"))
    entries = F.array(*[
        F.struct(F.lit(name).alias("board"), F.lit(up).alias("up"), F.col("_latest")[c].cast("double").alias("value"))
        for name, c, up in boards
    ])
    rows = latest.select("ticker", F.explode(entries).alias("_e")).select("ticker", "_e.*")
    rising, falling = (lambda c: F.when(F.col("up"), F.col(c))), (lambda c: F.when(~F.col("up"), F.col(c)))
    order = [rising("value").asc(), falling("value").desc(), rising("ticker").asc(), falling("ticker").desc()]
    return first_rows(rows, ["board"], order, n).select("board", "ticker", "value")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key by ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key by ``order``.

    The rank filter is pushed below the shuffle, so of a key with many copies every task
    sends one row.
    """
    return first_rows(df, keys, order, 1)


def live_latest(df: DataFrame, value: str, ts: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Latest value per ticker, unless it has outlived its time to live."""
    latest = df.groupBy("ticker").agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
    return latest.filter(F.col(ts) > as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def page(df: DataFrame, order: Sequence[str], page_id: int, bucket: Column, n: int = 1000) -> DataFrame:
    """One page of the ordered rows, with ``page_id`` and ``page_count`` on every row.

    ``bucket`` is a column that rises with ``order``: a count per bucket tells which buckets
    hold the page, and only those are ranked, however deep the page is.
    """
    pages = F.ceil(df.agg(F.count(F.lit(1))).scalar() / F.lit(n)).cast("long")
    rows = _rows_between(df, order, bucket, (page_id - 1) * n, n)
    return rows.select(F.lit(page_id).cast("long").alias("page_id"), pages.alias("page_count"), *df.columns)


def _rows_between(df: DataFrame, order: Sequence[str], bucket: Column, skip: int, n: int) -> DataFrame:
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket reaches this window, never the data.
    ends = counts.withColumn("_end", F.sum("_n").over(W.orderBy("_bucket")))
    holding = ends.filter((F.col("_end") > skip) & (F.col("_end") - F.col("_n") < skip + n)).select(
        "_bucket", (F.col("_end") - F.col("_n")).alias("_before")
    )
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    placed = bucketed.join(holding, "_bucket").withColumn("_pos", F.col("_before") + rank)
    return placed.filter((F.col("_pos") > skip) & (F.col("_pos") <= skip + n)).drop("_bucket", "_before", "_pos")


def best_predictions(scored: DataFrame, prediction: str, label: str, tie: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` predictions closest to the truth."""
    return (
        scored.withColumn("abs_err", F.abs(F.col(prediction) - F.col(label))).orderBy("abs_err", *tie).limit(n)
    )


def random_predictions(scored: DataFrame, tie: Sequence[str], seed: int = 42, n: int = 5) -> DataFrame:
    """``n`` rows in an order fixed by the seed and the row's key."""
    from tapeloom.functions.text import stable_fraction

    return (
        scored.withColumn("_u", stable_fraction(seed, *[F.col(c) for c in tie]))
        .orderBy("_u", *tie).limit(n).drop("_u")
    )
