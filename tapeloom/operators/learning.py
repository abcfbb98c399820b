"""Next-day open return: feature windows, split, scaling, model, metrics, back-test."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.text import stable_fraction
from tapeloom.operators import candles, joins

WINDOW = 7
FIELDS = candles.PRICE_FIELDS
FEATURES = [f"day{i}_{f}_ret" for i in range(WINDOW) for f in FIELDS]
TARGET = "target_open_return"
TARGET_LOW, TARGET_HIGH = -0.9, 2.0


def _step() -> Column:
    return F.struct(*[F.col(f"{f}_ret") for f in FIELDS])


def _spread(days: Column) -> list[Column]:
    return [F.get(days, i)[f"{f}_ret"].alias(f"day{i}_{f}_ret") for i in range(WINDOW) for f in FIELDS]


def feature_windows(returns: DataFrame) -> DataFrame:
    """Seven consecutive return rows as 35 columns, and the open return of the row after.

    ``d`` is the first day of the window. Tickers need more than eight return rows.
    """
    ahead = W.partitionBy("ticker").orderBy("d").rowsBetween(0, WINDOW)
    total = F.count(F.lit(1)).over(W.partitionBy("ticker"))
    w = returns.select("ticker", "d", F.collect_list(_step()).over(ahead).alias("_w"), total.alias("_n"))
    full = w.filter((F.size("_w") == WINDOW + 1) & (F.col("_n") > WINDOW + 1))
    return full.select("ticker", "d", *_spread(F.col("_w")), F.get("_w", WINDOW)["o_ret"].alias(TARGET))


def plausible_targets(windows: DataFrame) -> DataFrame:
    return windows.filter(F.col(TARGET).between(TARGET_LOW, TARGET_HIGH))


def training_set(bars: DataFrame, floor: float = 0.01) -> DataFrame:
    """Bars of any width to training rows."""
    daily = candles.drop_junk_tickers(candles.daily_bars(bars), floor)
    returns = candles.percent_returns(candles.fill_calendar(daily))
    return plausible_targets(feature_windows(returns))


def trailing_vectors(returns: DataFrame) -> DataFrame:
    """Per day the seven return rows up to it as 35 columns, and the day of the oldest."""
    back = W.partitionBy("ticker").orderBy("d").rowsBetween(-(WINDOW - 1), 0)
    w = returns.select(
        "ticker", "d", F.collect_list(_step()).over(back).alias("_w"), F.min("d").over(back).alias("oldest_d")
    )
    return w.filter(F.size("_w") == WINDOW).select("ticker", "d", "oldest_d", *_spread(F.col("_w")))


def latest_vectors(returns: DataFrame) -> DataFrame:
    """The newest seven return rows of each ticker, oldest first; tickers with fewer have none."""
    newest = W.partitionBy("ticker").orderBy(F.desc("d"))
    last = returns.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= WINDOW)
    # At most seven rows per ticker are left here.
    rows = last.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("d", _step().alias("x")))).alias("_w"))
    steps = F.transform("_w", lambda e: e["x"])
    return rows.filter(F.size("_w") == WINDOW).select("ticker", F.get("_w", WINDOW - 1)["d"].alias("d"), *_spread(steps))


def with_split(rows: DataFrame, seed: int = 42) -> DataFrame:
    """60/20/20 by a hash of the row's key: the same on every run and after lost tasks."""
    u = stable_fraction(seed, F.col("ticker"), F.col("d"))
    return rows.withColumn("split", F.when(u < 0.6, "train").when(u < 0.8, "validation").otherwise("test"))


def scaling(train: DataFrame, features=FEATURES) -> DataFrame:
    """Mean and population deviation per feature in one pass, one row per feature."""
    stats = train.agg(
        *[F.avg(f).alias(f"{f}_mean") for f in features], *[F.stddev_pop(f).alias(f"{f}_sd") for f in features]
    )
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("mean"), F.col(f"{f}_sd").alias("sd")) for f in features
    ])
    return stats.select(F.explode(pairs).alias("x")).select("x.*")


def fit(rows: DataFrame, kind: str = "linear", **params) -> PipelineModel:
    """Scaler and regressor fitted on the train rows of a split set.

    'gbt' also watches the validation rows and stops when they no longer improve.
    """
    known = rows.filter(F.col("split") != "test").withColumn("is_validation", F.col("split") == "validation")
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
    ]
    if kind == "gbt":
        scaler = Pipeline(stages=stages).fit(known.filter(~F.col("is_validation")))
        tree = GBTRegressor(
            labelCol=TARGET, validationIndicatorCol="is_validation", **{"maxIter": 20, "maxDepth": 4, "seed": 42, **params}
        )
        return PipelineModel([*scaler.stages, tree.fit(scaler.transform(known))])
    stages.append(LinearRegression(labelCol=TARGET, **{"regParam": 1e-4, **params}))
    return Pipeline(stages=stages).fit(known.filter(~F.col("is_validation")))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("raw_features", "features")


def metrics(scored: DataFrame, *keys: str, prediction: str = "prediction", label: str = TARGET) -> DataFrame:
    """Mean squared and absolute error and R² in one pass."""
    err, y = F.col(prediction) - F.col(label), F.col(label)
    mse = F.avg(err * err)
    return scored.groupBy(*keys).agg(
        F.count(err).alias("rows"), mse.alias("mse"), F.avg(F.abs(err)).alias("mae"),
        (1 - mse / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
    )


def predicted_price(close: Column, ret: Column) -> Column:
    return close * (1 + ret)


def against_next_bar(predictions: DataFrame, bars: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Each prediction (ticker, t, c) with the return to the next bar's close, its error and direction."""
    fields = ("t", "o", "h", "l", "c", "v")
    found = joins.next_bar(predictions, bars, fields=fields)
    p = F.col(prediction)
    actual = F.when(F.col("c") != 0, (F.col("next_c") - F.col("c")) / F.nullif(F.col("c"), F.lit(0.0)))
    return found.withColumn("actual_return", actual).withColumns({
        "abs_error": F.abs(p - F.col("actual_return")),
        "direction_hit": (p > 0) == (F.col("actual_return") > 0),
    })


def with_next_day(daily: DataFrame) -> DataFrame:
    """A daily series with the day and close of the next bar, and ``traded`` to tell its days once filled."""
    w = W.partitionBy("ticker").orderBy("d")
    return daily.withColumns({"next_d": F.lead("d").over(w), "next_c": F.lead("c").over(w), "traded": F.lit(True)})


def against_next_day(days: DataFrame, prediction: str = "prediction", horizon: int = 7) -> DataFrame:
    """As ``against_next_bar`` for rows of ``with_next_day``."""
    within = F.col("next_d") <= F.date_add("d", horizon)
    actual = F.when(within & (F.col("c") != 0), (F.col("next_c") - F.col("c")) / F.nullif(F.col("c"), F.lit(0.0)))
    p = F.col(prediction)
    return days.withColumn("actual_return", actual).withColumns({
        "abs_error": F.abs(p - F.col("actual_return")),
        "direction_hit": (p > 0) == (F.col("actual_return") > 0),
    })


def month_targets(bars: DataFrame, first_day: str) -> DataFrame:
    """Per ticker the last millisecond before each day of the month."""
    d = F.lit(first_day).cast("date")
    days = F.explode(F.sequence(d, F.last_day(d))).alias("_day")
    return bars.select("ticker").distinct().select("ticker", days).select(
        "ticker", (F.unix_date("_day").cast("long") * candles.DAY_MS - 1).alias("target_t")
    )


def vectors_as_of(targets: DataFrame, bars: DataFrame, returns: DataFrame) -> DataFrame:
    """Per target the newest vector of its 30-day look-back, with the close at that time.

    A vector counts only if all its days have a predecessor inside the look-back.
    """
    span = 30 * candles.DAY_MS
    begun = targets.withColumn("_from", F.col("target_t") - span)
    # First and last bar of the look-back, then the newest vector within it: three as-of lookups.
    begun = joins.next_bar(begun, bars, "_from", 0, span, ("t",), "_first_").drop("_from")
    priced = joins.last_close_at_or_before(begun, bars, span)
    vectors = trailing_vectors(returns).withColumn("t", F.unix_date("d").cast("long") * candles.DAY_MS)
    found = joins.last_bar(priced, vectors, "target_t", span, ("t", "oldest_d", *FEATURES), "")
    enough = F.col("oldest_d") > F.timestamp_millis("_first_t").cast("date")
    return found.filter(enough).select("ticker", "target_t", "reference_close", *FEATURES)


def month_backtest(targets: DataFrame, scored: DataFrame, bars: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Next bar and predicted price of every target; without a vector the price is NULL."""
    price = predicted_price(F.col("reference_close"), F.col(prediction)).alias("pred_price")
    ahead = joins.next_bar(targets, bars, t="target_t")
    named = ahead.select(
        "ticker", "target_t", *[F.col(f"next_{x}").alias(x) for x in ("t", "o", "h", "l", "c", "v")]
    )
    return named.join(scored.select("ticker", "target_t", price), ["ticker", "target_t"], "left")
