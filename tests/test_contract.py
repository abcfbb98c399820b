"""The registered queries against DuckDB. TAPELOOM_ALL=1 runs every one of them."""

import os
import pathlib

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "indicators_all", "win8_percent_returns", "agg9_window_statistics", "joi8_next_bar", "agg5_ticker_report",
    "win12_sentiment_anomaly", "joi4_upsert", "job5_foreign_keys", "scl23_lenient_lists", "set7_unique_insert", "mlx5_metrics",
]
NAMES = list(contract.queries()) if os.environ.get("TAPELOOM_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not pathlib.Path(FOLDER).exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for p in sorted(pathlib.Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_entry_has_rows(spark, duck):
    assert len(contract.entry(spark).take(1)) == 1


def test_oracle_keys_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    from tools.check_oracle import rows_of

    df = contract.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in contract.oracle_sql():
        assert got
        return
    cur = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())
