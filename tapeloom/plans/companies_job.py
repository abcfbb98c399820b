"""Company dimension rebuild and the relational load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.operators import documents, joins, merge
from tapeloom.operators.ranking import last_per_key
from tapeloom.sinks import lake as lake_sink
from tapeloom.sources.readers import parquet_as


def run(spark: SparkSession, lake_path: str, warehouse: str) -> DataFrame:
    """Rebuild the dimension; returns the null counts of what was loaded."""
    dim = documents.company_dimension(parquet_as(spark, lake_path, schemas.COMPANY_LAKE))
    lake_sink.replace_table(dim, f"{warehouse}/dim_companies")
    return documents.null_profile(spark.read.parquet(f"{warehouse}/dim_companies"))


def relational_batch(
    companies: DataFrame, markets: DataFrame, known_tickers: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Documents to the five relations, cleaned for loading.

    Companies without a ticker are dropped, the first per ticker is kept, and tickers
    already loaded are left out; status rows need a ticker.
    """
    split = documents.split_companies(companies)
    out = {**split, **documents.split_markets(markets)}
    ordered = split["companies"]
    first = [F.asc_nulls_last(c) for c in ordered.columns if c != "company_ticker"]
    if known_tickers is None:
        out["companies"] = last_per_key(ordered.na.drop(subset=["company_ticker"]), ["company_ticker"], first)
    else:
        out["companies"] = merge.new_rows(ordered, known_tickers, ["company_ticker"], first)
    out["company_status"] = split["company_status"].na.drop(subset=["company_status_ticker"])
    return out


def violations(relations: dict[str, DataFrame]) -> DataFrame:
    """Rows per foreign key that point nowhere."""
    return joins.orphan_report(
        [(f"{c}.{fk}", relations[c], fk, relations[p], pk) for c, fk, p, pk in schemas.FOREIGN_KEYS]
    )
