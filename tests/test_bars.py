import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import prices
from tapeloom.operators import candles, joins, learning, ranking

DAY = candles.DAY_MS


def d(day):
    return dt.date(2024, 1, day)


def test_gap_week(spark):
    rows = [("A", d(5), 1.0, 10.0), ("A", d(8), 2.0, 20.0), ("A", d(9), 4.0, 30.0)]
    daily = spark.createDataFrame([(t, x, o, o, o, o, v) for t, x, o, v in rows],
                                  "ticker string, d date, o double, h double, l double, c double, v double")
    filled = candles.fill_calendar(daily)
    assert [(r.d.day, r.c, r.v) for r in filled.orderBy("d").collect()] == [
        (5, 1, 10), (6, 1, 0), (7, 1, 0), (8, 2, 20), (9, 4, 30)]
    kept = candles.percent_returns(filled).orderBy("d").collect()
    # From one empty day to the next the volume goes 0 to 0: the 7th is dropped.
    assert [(r.d.day, r.v_ret) for r in kept] == [(6, -1.0), (8, 0.0), (9, 0.5)]
    assert [r.o_ret for r in kept] == [0.0, 1.0, 1.0]


def test_thresholds(spark):
    rows = [(100.0, 103.0, False, 0.0), (100.0, 103.01, True, 0.0), (0.0, 5.0, False, 0.0), (100.0, 96.9, True, 0.0)]
    df = spark.createDataFrame(rows, "o double, c double, alert boolean, z double")
    pct = prices.pct_of_positive(F.col("c") - F.col("o"), F.col("o"))
    for r in df.withColumn("got", prices.is_price_alert(pct)).collect():
        assert r.got == r.alert
    flags = spark.createDataFrame([(105.0, 100.0, 100.0), (105.01, 100.0, 100.0), (5.0, 1.0, 0.0)], "h double, l double, c double")
    got = [r[0] for r in flags.select(prices.volatility_flag(F.col("h"), F.col("l"), F.col("c"))).collect()]
    assert got == ["normal", "high", "normal"]
    zero = spark.createDataFrame([(1.0, 0.0)], "h double, l double")
    assert zero.select(prices.high_low_ratio(F.col("h"), F.col("l"))).first()[0] == 0.0


def test_alerts_follow_their_bars(spark):
    bars = spark.createDataFrame([("A", 1, 100.0, 104.0, 100.0, 104.0, 5.0), ("A", 2, 100.0, 101.0, 100.0, 101.0, 5.0)],
                                 "ticker string, t long, o double, h double, l double, c double, v double")
    out = candles.bars_with_alerts(candles.enrich_bars(bars))
    assert sorted((r.t, r.record_type) for r in out.collect()) == [(1, "alert"), (1, "bar"), (2, "bar")]
    assert candles.price_alerts(candles.enrich_bars(bars)).first().message == "Alert: A moved 4.00%"


def test_rollup_of_identical_bars(spark):
    bars = spark.createDataFrame([("A", 7, 164.5, 165.5, 163.5, 165.0, 1290000.0)] * 5,
                                 "ticker string, t long, o double, h double, l double, c double, v double")
    r = candles.roll_up(bars, ["ticker"]).first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.bar_count) == (164.5, 165.5, 163.5, 165.0, 6450000.0, 5)
    assert (r.avg_price, r.price_change, r.price_change_pct) == (165.0, 0.5, 0.3)


def test_junk_ticker_goes_entirely(spark):
    df = spark.createDataFrame([("A", d(1), 0.01), ("A", d(2), 9.0), ("B", d(1), 0.02)], "ticker string, d date, c double")
    assert {r.ticker for r in candles.drop_junk_tickers(df).collect()} == {"B"}


def test_leaderboards_and_ties(spark):
    rows = [("AAPL", 1, 5.2), ("GOOGL", 1, 3.8), ("MSFT", 1, 9.9), ("MSFT", 2, 4.1), ("TSLA", 1, 4.1)]
    df = spark.createDataFrame(rows, "ticker string, ts int, v double")
    top = lambda asc: [r.ticker for r in ranking.leaderboard(df, "x", "v", "ts", 3, asc).collect()]
    assert top(False) == ["AAPL", "TSLA", "MSFT"]
    assert top(True) == ["GOOGL", "MSFT", "TSLA"]


def test_pages_near_and_deep(spark):
    rng = random.Random(1)
    rows = [(i, "HOT" if rng.random() < 0.6 else "B", rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, t int")
    ranked = sorted(rows, key=lambda r: (r[2], r[0]))
    for p in range(1, 10):
        page = ranking.page(df, ["t", "i"], p, F.floor(F.col("t") / 7), 40).orderBy("t", "i").collect()
        assert [(r.i, r.k, r.t) for r in page] == ranked[(p - 1) * 40:p * 40]
        assert all(r.page_id == p and r.page_count == 8 for r in page)


def test_next_bar_against_loops(spark):
    rng = random.Random(4)
    bars = [("HOT" if rng.random() < 0.7 else "B", rng.randrange(40) * DAY + rng.randrange(3) * 1000, float(i)) for i in range(80)]
    bars = list({(k, t): (k, t, c) for k, t, c in bars}.values())
    points = [("HOT", t) for t in range(0, 40 * DAY, 3 * DAY)] + [("B", 5 * DAY), ("B", 39 * DAY)]
    got = joins.next_bar(
        spark.createDataFrame(points, "ticker string, t long"), spark.createDataFrame(bars, "ticker string, t long, c double"),
        fields=("t", "c")).collect()
    assert len(got) == len(points)
    for r in got:
        reach = sorted((t, c) for k, t, c in bars if k == r.ticker and r.t + 1000 <= t <= r.t + 7 * DAY)
        assert (r.next_t, r.next_c) == (reach[0] if reach else (None, None))


def test_last_bar_against_loops(spark):
    rng = random.Random(6)
    bars = list({t: ("A", t, float(i)) for i, t in enumerate(rng.randrange(90) * DAY for _ in range(25))}.values())
    points = [("A", t) for t in range(0, 120 * DAY, 4 * DAY)] + [("B", 5 * DAY)]
    got = joins.last_bar(
        spark.createDataFrame(points, "ticker string, t long"), spark.createDataFrame(bars, "ticker string, t long, c double"),
        fields=("t", "c")).collect()
    assert len(got) == len(points)
    for r in got:
        reach = sorted((t, c) for k, t, c in bars if k == r.ticker and r.t - 30 * DAY <= t <= r.t)
        assert (r.last_t, r.last_c) == (reach[-1] if reach else (None, None))


def test_look_back_against_loops(spark):
    rng = random.Random(8)
    bars = [("A", i * DAY, float(i)) for i in range(100)] + [("HOT", rng.randrange(90 * DAY), rng.random()) for _ in range(300)]
    targets = [("A", 45 * DAY), ("A", 99 * DAY + 5), ("A", -DAY), ("B", 0)] + [("HOT", rng.randrange(100 * DAY)) for _ in range(40)]
    span = 30 * DAY
    got = joins.look_back(
        spark.createDataFrame(targets, "ticker string, target_t long"),
        spark.createDataFrame(bars, "ticker string, t long, c double"), span, "c").collect()
    want = {}
    for k, at in targets:
        inside = [(t, c) for j, t, c in bars if j == k and at - span <= t <= at]
        if inside:
            want[k, at] = (len(inside), min(inside)[0], max(inside)[0], sum(c for _, c in inside) / len(inside))
    assert {(r.ticker, r.target_t) for r in got} == set(want)
    for r in got:
        assert (r.bars, r.first_t, r.last_t, r.mean_c) == (*want[r.ticker, r.target_t][:3], pytest.approx(want[r.ticker, r.target_t][3]))


def test_orphans_count_rows_of_a_hot_key(spark):
    child = spark.createDataFrame([(1,)] * 50 + [(2,), (3,), (None,)], "fk int")
    parent = spark.createDataFrame([(2,)], "pk int")
    r = joins.orphan_report([("child.fk", child, "fk", parent, "pk")]).first()
    assert (r.orphan_keys, r.orphan_rows) == (2, 51)


def test_orphan_checks_share_a_scan(spark, tmp_path):
    rows = [(1, 5), (1, None), (2, 6)]
    spark.createDataFrame(rows, "a int, b int").write.parquet(f"{tmp_path}/child")
    child, parent = spark.read.parquet(f"{tmp_path}/child"), spark.createDataFrame([(1,), (5,)], "pk int")
    report = joins.orphan_report([("a", child, "a", parent, "pk"), ("b", child, "b", parent, "pk"), ("c", child, "a", child, "a")])
    assert {r.foreign_key: (r.orphan_keys, r.orphan_rows) for r in report.collect()} == {"a": (1, 1), "b": (1, 1), "c": (0, 0)}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # once as a child, once as a parent


@pytest.fixture(scope="module")
def long_series(spark):
    rng = random.Random(8)
    rows, price = [], 100.0
    for i in range(120):
        price *= 1 + rng.uniform(-0.05, 0.05)
        o = price * (1 + rng.uniform(-0.01, 0.01))
        rows.append(("A", i * DAY, o, price * 1.02, price * 0.98, price, 100.0 + rng.randrange(50)))
    return spark.createDataFrame(rows, "ticker string, t long, o double, h double, l double, c double, v double")


def test_training_windows(spark, long_series):
    rows = learning.training_set(long_series).orderBy("d").collect()
    assert len(rows) == 119 - 7
    assert rows[0][learning.TARGET] == rows[1].day6_o_ret
    assert rows[0].day1_v_ret == rows[1].day0_v_ret
    short = long_series.filter(F.col("t") < 9 * DAY)  # eight returns: one too few
    assert learning.training_set(short).count() == 0


def test_model_flow(spark, long_series):
    rows = learning.with_split(learning.training_set(long_series)).cache()
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "validation", "test"}
    for kind, params in (("linear", {}), ("gbt", {"maxIter": 3})):
        model = learning.fit(rows, kind, **params)
        m = {r.split: r for r in learning.metrics(learning.score(model, rows), "split").collect()}
        assert m["train"].mse >= 0 and m["train"].r2 <= 1
    targets = spark.createDataFrame([("A", 60 * DAY - 1), ("A", 3 * DAY)], "ticker string, target_t long")
    returns = candles.percent_returns(candles.fill_calendar(candles.daily_bars(long_series)))
    vectors = learning.vectors_as_of(targets, long_series, returns)
    table = learning.month_backtest(targets, learning.score(model, vectors), long_series).orderBy("target_t").collect()
    assert table[0].pred_price is None and table[0].t == 4 * DAY  # three days are no vector
    assert table[1].pred_price > 0 and table[1].t == 61 * DAY  # midnight is within the gap of one second


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "prediction double, target_open_return double")
    r = learning.metrics(df).first()
    assert (r.rows, r.mse, r.mae) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert r.r2 == pytest.approx(1 - (2 / 3) / (2 / 3))
