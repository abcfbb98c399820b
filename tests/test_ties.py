"""Ticks of the same time and values equal to a mean: queries and SQL state one rule."""

import duckdb
import pytest

import __spark_entry__ as contract
from tapeloom.operators import indicators
from tapeloom.session import work_dir
from tools.check_oracle import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark):
    """Events three times with shifted keys: each ticker has ticks of the same time, with other prices."""
    folder = work_dir(spark, "t")
    events = spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_id < 200").crossJoin(spark.range(3).withColumnRenamed("id", "r"))
    events.selectExpr(
        "event_id + (2 - r) * 1000 as event_id", "ts", "user_id + 8 * r as user_id", "event_type", "value + r as value", "props"
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["agg9_window_statistics", "win9_trailing_window", "str9_per_tick"])
def test_ticks_of_the_same_time(spark, repeated, name):
    """F5, F8, F9: the SQL took in later ticks of the same time, and any of them as the first."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{repeated}/events.parquet/*.parquet'")
    df = contract.queries()[name](spark, repeated)
    cur = con.execute(contract.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_a_score_equal_to_its_mean_is_a_drop(spark):
    """the error of the mean's sum made it a spike or a drop."""
    means = [0.3 - 1e-16, 0.3, 0.3 + 1e-16, 0.29]
    rows = [(0.3, 12, m, 1.0, 0.0, 1.0) for m in means]
    history = spark.createDataFrame(rows, "score double, hist_n long, hist_mean double, hist_m2 double, hist_lo double, hist_hi double")
    report = indicators.anomaly_report(history.coalesce(1), "score", ["hist_mean"], noise=1e-10).collect()
    assert {r.hist_mean: r.direction for r in report} == dict(zip(means, ["drop"] * 3 + ["spike"], strict=True))
    assert "score - mean > 1e-10" in contract.oracle_sql()["win12_stream"]
