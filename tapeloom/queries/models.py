"""Queries over the learning flow. Oracle queries use yesterday's return as the prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.rounding import half_up
from tapeloom.operators import candles, learning, ranking
from tapeloom.queries.registry import query
from tapeloom.session import materialize
from tapeloom.views import BARS, RETURNS, Views, r

_X = [(i, f) for i in range(learning.WINDOW) for f in "ohlcv"]
_W = "(PARTITION BY ticker ORDER BY d)"
_WINDOWS = RETURNS + ", windows AS (SELECT * FROM (SELECT ticker, d, " + ", ".join(
    f"lead({f}_ret, {i}) OVER {_W} AS day{i}_{f}_ret" for i, f in _X
) + f", lead(o_ret, 7) OVER {_W} AS target_open_return, count(*) OVER (PARTITION BY ticker) AS n FROM returns) q WHERE target_open_return IS NOT NULL AND n > 8)"
_TRAINING = _WINDOWS + ", training AS (SELECT * FROM windows WHERE target_open_return BETWEEN -0.9 AND 2.0)"
_ROUNDED = ", ".join(f"{r(c, 6)} AS {c}" for c in [*learning.FEATURES, learning.TARGET])
_U = "CAST(CAST(concat('0x', substr(md5(concat('42|', ticker, '|', CAST(d AS VARCHAR))), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0"
_SPLIT = _TRAINING + f", split AS (SELECT *, CASE WHEN {_U} < 0.6 THEN 'train' WHEN {_U} < 0.8 THEN 'validation' ELSE 'test' END AS split FROM training)"


def _returns(v: Views):
    return candles.percent_returns(candles.fill_calendar(v.daily.select("ticker", "d", *"ohlcv")))


def _training(v: Views):
    return learning.training_set(v.daily_t)


def _round(df, *names: str, digits: int = 6):
    return [half_up(F.col(n), digits).alias(n) for n in names]


@query("win10_feature_windows", f"WITH {_WINDOWS} SELECT ticker, d, {r('day0_o_ret', 6)} AS day0_o_ret, {r('day6_v_ret', 6)} AS day6_v_ret, {r('target_open_return', 6)} AS target_open_return FROM windows")
def win10(v: Views):
    w = learning.feature_windows(_returns(v))
    return w.select("ticker", "d", *_round(w, "day0_o_ret", "day6_v_ret", learning.TARGET))


@query(
    "win11_last_vector",
    f"WITH {RETURNS}, last AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM returns) SELECT ticker, max(d) AS d, "
    + ", ".join(f"{r(f'max(CASE WHEN rn = {7 - i} THEN {f}_ret END)', 6)} AS day{i}_{f}_ret" for i, f in _X)
    + " FROM last WHERE rn <= 7 GROUP BY ticker HAVING count(*) = 7",
)
def win11(v: Views):
    w = learning.latest_vectors(_returns(v))
    return w.select("ticker", "d", *_round(w, *learning.FEATURES))


@query("flt8_label_outliers", f"WITH {_WINDOWS} SELECT ticker, count(*) AS rows FROM windows WHERE target_open_return BETWEEN -0.9 AND 2.0 GROUP BY ticker")
def flt8(v: Views):
    kept = learning.plausible_targets(learning.feature_windows(_returns(v)))
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("mlx1_training_set", f"WITH {_TRAINING} SELECT ticker, d, {_ROUNDED} FROM training")
def mlx1(v: Views):
    t = _training(v)
    return t.select("ticker", "d", *_round(t, *learning.FEATURES, learning.TARGET))


@query("mlx2_split", f"WITH {_SPLIT} SELECT ticker, d, split FROM split")
def mlx2(v: Views):
    return learning.with_split(_training(v)).select("ticker", "d", "split")


@query(
    "mlx3_scaler",
    f"WITH {_SPLIT}, train AS MATERIALIZED (SELECT * FROM split WHERE split = 'train') "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'avg({f})', 4)} AS mean, {r(f'stddev_pop({f})', 4)} AS sd FROM train" for f in learning.FEATURES),
)
def mlx3(v: Views):
    s = learning.scaling(learning.with_split(_training(v)).filter("split = 'train'"))
    return s.select("feature", *_round(s, "mean", "sd", digits=4))


def _persistence(rows):
    return rows.withColumn("prediction", F.col("day6_o_ret"))


@query("mlx4_regressor")
def mlx4(v: Views):
    """Metrics of the fitted model on the three splits."""
    rows = materialize(learning.with_split(_training(v)), "training")
    return learning.metrics(learning.score(learning.fit(rows), rows), "split")


@query(
    "mlx4_normal_equations",
    f"WITH {_SPLIT} SELECT split, count(*) AS rows, TRUE AS unbiased, TRUE AS orthogonal, TRUE AS no_worse_than_mean FROM split GROUP BY split",
)
def mlx4_equations(v: Views):
    """What holds of least squares without a penalty: train residuals are 0 on average and along every feature."""
    rows = materialize(learning.with_split(_training(v)), "training")
    scored = learning.score(learning.fit(rows, regParam=0.0), rows)
    residual = F.col("prediction") - F.col(learning.TARGET)
    on_train = scored.filter("split = 'train'").agg(
        F.avg(residual).alias("mean"), F.greatest(*[F.abs(F.avg(residual * F.col(f))) for f in learning.FEATURES]).alias("along"),
        F.avg(residual * residual).alias("mse"), F.var_pop(learning.TARGET).alias("variance"))
    flags = on_train.select(
        (F.abs("mean") < 1e-6).alias("unbiased"), (F.col("along") < 1e-6).alias("orthogonal"),
        (F.col("mse") <= F.col("variance")).alias("no_worse_than_mean"))
    holds = flags.select(F.struct("*")).scalar()
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(
        "split", "rows", *[holds[c].alias(c) for c in ("unbiased", "orthogonal", "no_worse_than_mean")])


@query(
    "mlx5_metrics",
    f"WITH {_SPLIT}, s AS (SELECT split, day6_o_ret AS p, target_open_return AS y FROM split) SELECT split, count(*) AS rows, {r('avg((p - y) * (p - y))', 4)} AS mse, {r('avg(abs(p - y))', 4)} AS mae, {r('1 - avg((p - y) * (p - y)) / var_pop(y)', 4)} AS r2 FROM s GROUP BY split",
)
def mlx5(v: Views):
    m = learning.metrics(_persistence(learning.with_split(_training(v))), "split")
    return m.select("split", "rows", *_round(m, "mse", "mae", "r2", digits=4))


@query("mlx6_scored_prices")
def mlx6(v: Views):
    """The fitted model on every ticker's newest vector, as a price."""
    rows = materialize(learning.with_split(_training(v)), "training")
    scored = learning.score(learning.fit(rows), learning.latest_vectors(_returns(v)))
    closes = v.daily.groupBy("ticker").agg(F.max_by("c", "d").alias("reference_close"))
    return scored.join(closes, "ticker").select(
        "ticker", "d", "reference_close", "prediction",
        learning.predicted_price(F.col("reference_close"), F.col("prediction")).alias("predicted_price"),
    )


@query(
    "mlx6_price_from_return",
    f"WITH {RETURNS}, last AS (SELECT ticker, max(d) AS d, max_by(c, d) AS c, max_by(o_ret, d) AS ret FROM returns GROUP BY ticker) SELECT ticker, d, {r('c', 4)} AS reference_close, {r('c * (1 + ret)', 4)} AS predicted_price FROM last",
)
def mlx6_price(v: Views):
    scored = _persistence(learning.latest_vectors(_returns(v)))
    closes = v.daily.groupBy("ticker").agg(F.max_by("c", "d").alias("reference_close"))
    priced = scored.join(closes, "ticker").withColumn(
        "predicted_price", learning.predicted_price(F.col("reference_close"), F.col("prediction"))
    )
    return priced.select("ticker", "d", *_round(priced, "reference_close", "predicted_price", digits=4))


_BACKTEST = (
    RETURNS + ", nb AS (SELECT ticker, d, lead(d) OVER w AS nd, lead(c) OVER w AS nc FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d)), "
    "scored AS (SELECT r.ticker, r.d, r.c, r.o_ret AS p, CASE WHEN nd <= r.d + 7 THEN (nc - r.c) / r.c END AS a FROM returns r JOIN nb ON r.ticker = nb.ticker AND r.d = nb.d)"
)


@query(
    "mlx7_backtest",
    f"WITH {_BACKTEST} SELECT ticker, d, {r('p', 6)} AS prediction, {r('a', 6)} AS actual_return, {r('abs(p - a)', 6)} AS abs_error, (p > 0) = (a > 0) AS direction_hit FROM scored",
)
def mlx7(v: Views):
    """Only days with a bar are scored. The calendar's flag tells them, so the bars are built once."""
    daily = learning.with_next_day(v.daily.select("ticker", "d", *"ohlcv"))
    filled = candles.fill_calendar(daily, ("next_d", "next_c", "traded"))
    days = candles.percent_returns(filled).filter("traded").withColumn("prediction", F.col("o_ret"))
    b = learning.against_next_day(days)
    return b.select("ticker", "d", *_round(b, "prediction", "actual_return", "abs_error"), "direction_hit")


@query(
    "mlx7_hourly_backtest",
    f"WITH {BARS}, nb AS (SELECT *, (c - o) / nullif(o, 0) AS p, lead(t) OVER w AS nt, lead(c) OVER w AS nc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY t)), "
    "scored AS (SELECT *, CASE WHEN nt <= t + 604800000 THEN (nc - c) / nullif(c, 0) END AS a FROM nb) "
    f"SELECT ticker, t, {r('p', 6)} AS prediction, {r('a', 6)} AS actual_return, {r('abs(p - a)', 6)} AS abs_error, (p > 0) = (a > 0) AS direction_hit FROM scored",
)
def mlx7_hourly(v: Views):
    """The same on bars of any width: the next bar is found in slices of time, so a hot ticker is split."""
    bars = v.bars.select("ticker", "t", *"ohlcv")
    points = bars.select("ticker", "t", "c", ((F.col("c") - F.col("o")) / F.nullif(F.col("o"), F.lit(0.0))).alias("prediction"))
    b = learning.against_next_bar(points, bars)
    return b.select("ticker", "t", *_round(b, "prediction", "actual_return", "abs_error"), "direction_hit")


_MONTH = "1998-06-01"
_MONTH_SQL = (
    RETURNS + f", targets AS (SELECT ticker, CAST(day AS DATE) AS td FROM (SELECT DISTINCT ticker FROM daily) x CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '{_MONTH}', TIMESTAMP '1998-06-30', INTERVAL 1 DAY)) AS day) y), "
    "reach AS (SELECT t.ticker, td, min(d) AS first_d, max_by(c, d) AS close FROM targets t JOIN daily b ON t.ticker = b.ticker AND b.d < td AND b.d >= td - 30 GROUP BY t.ticker, td), "
    f"vec AS (SELECT ticker, d, o_ret, min(d) OVER (PARTITION BY ticker ORDER BY d ROWS 6 PRECEDING) AS oldest, count(*) OVER (PARTITION BY ticker ORDER BY d ROWS 6 PRECEDING) AS k FROM returns), "
    "newest AS (SELECT t.ticker, td, max_by(o_ret, d) AS ret, max_by(oldest, d) AS oldest FROM targets t JOIN vec b ON t.ticker = b.ticker AND b.d < td AND b.d >= td - 30 AND k = 7 GROUP BY t.ticker, td), "
    "priced AS (SELECT ticker, td, close * (1 + ret) AS pred FROM reach JOIN newest USING (ticker, td) WHERE oldest > first_d), "
    "ahead AS (SELECT t.ticker, td, min(d) AS nd, min_by(c, d) AS nc, min_by(v, d) AS nv FROM targets t JOIN daily b ON t.ticker = b.ticker AND b.d > td AND b.d < td + 7 GROUP BY t.ticker, td)"
)


@query(
    "mlx8_month_backtest",
    f"WITH {_MONTH_SQL} SELECT ticker, epoch_ms(CAST(td AS TIMESTAMP)) - 1 AS target_t, epoch_ms(CAST(nd AS TIMESTAMP)) AS t, {r('nc', 4)} AS c, nv AS v, {r('pred', 4)} AS pred_price FROM targets LEFT JOIN ahead USING (ticker, td) LEFT JOIN priced USING (ticker, td)",
)
def mlx8(v: Views):
    daily = materialize(v.daily.select("ticker", "d", *"ohlcv"), "daily")  # built once, read by every look-up
    bars = daily.select("ticker", (F.unix_date("d").cast("long") * candles.DAY_MS).alias("t"), *"ohlcv")
    targets = learning.month_targets(bars, _MONTH)
    returns = candles.percent_returns(candles.fill_calendar(daily))
    scored = _persistence(learning.vectors_as_of(targets, bars, returns))
    table = learning.month_backtest(targets, scored, bars)
    return table.select("ticker", "target_t", "t", *_round(table, "c", digits=4), "v", *_round(table, "pred_price", digits=4))


@query(
    "top6_best_predictions",
    f"WITH {_TRAINING} SELECT ticker, d, {r('abs(day6_o_ret - target_open_return)', 6)} AS abs_err FROM training ORDER BY abs(day6_o_ret - target_open_return), ticker, d LIMIT 5",
)
def top6(v: Views):
    best = ranking.best_predictions(_persistence(_training(v)), "prediction", learning.TARGET, ["ticker", "d"])
    return best.select("ticker", "d", *_round(best, "abs_err"))


@query("top6_random_predictions", f"WITH {_TRAINING} SELECT ticker, d FROM training ORDER BY {_U}, ticker, d LIMIT 5")
def top6_random(v: Views):
    return ranking.random_predictions(_training(v), ["ticker", "d"]).select("ticker", "d")
