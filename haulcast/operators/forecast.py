"""Weekly demand forecasts: four-week mean and ridge regression, backtest and future.

Windows prepare every feature; one grouped pandas call per series solves the two ridge
regressions and returns their coefficients, which column expressions then apply. A group is
one series of weekly rows, so it is bounded by the number of weeks; series are spread over
the cluster by the group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.config import EngineConfig
from haulcast.operators.ridge import (
    COEFFICIENTS,
    DEFAULT_SPREAD,
    FEATURES,
    MIN_STEP_ROWS,
    NAIVE,
    RIDGE,
    coefficients,
    predicted,
    rolled_forward,
)
from haulcast.operators.series import SERIES
from haulcast.workspace import dataset

# Fixed value: half-width of the forecast interval in spreads.
INTERVAL_Z = 1.64


@dataset
def backtest_inputs(backtest_split: DataFrame, config: EngineConfig) -> DataFrame:
    """Split features with the naive forecast of every row's side of the split.

    The four-week mean is carried forward inside the hold-out, then falls back to the
    hold-out's own mean (the whole series' mean in the simple recipe).
    """
    side = Window.partitionBy(*SERIES, "is_holdout")
    carried = F.last("roll4", ignorenulls=True).over(
        side.orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    base = Window.partitionBy(*SERIES) if config.recipe == "simple" else side
    return backtest_split.withColumn("naive_forecast", F.coalesce(carried, F.avg("y").over(base)))


@dataset
def naive_ma4_backtest(backtest_inputs: DataFrame) -> DataFrame:
    """Hold-out forecasts of the four-week mean."""
    return backtest_inputs.filter("is_holdout").select("week", *SERIES, F.col("naive_forecast").alias("forecast_units"))


@dataset
def naive_ma4_future(future_weeks: DataFrame) -> DataFrame:
    """The mean of the last four weeks, repeated over the horizon."""
    return future_weeks.select("week", *SERIES, F.col("last4_mean").alias("forecast_units"))


def with_interval(raw: DataFrame) -> DataFrame:
    """Forecast and its bounds, none below zero."""
    margin = F.col("spread") * INTERVAL_Z
    levels = {
        "forecast_units": F.col("prediction"),
        "lower_ci": F.col("prediction") - margin,
        "upper_ci": F.col("prediction") + margin,
    }
    floored = (F.greatest(F.lit(0.0), level).alias(name) for name, level in levels.items())
    return raw.select("week", *SERIES, *floored, "model_name", "is_backtest")


@dataset
def ridge_coefficients(backtest_split: DataFrame) -> DataFrame:
    """One row per series: both ridge fits, and the spread of weekly steps before the hold-out.

    A series whose rows are too few for a fit has null coefficients.
    """
    fits = backtest_split.groupBy(*SERIES).applyInPandas(coefficients, COEFFICIENTS)
    trained = ~F.col("is_holdout")
    steps = F.stddev_pop(F.when(trained, F.col("y") - F.col("lag_1")))
    spreads = backtest_split.groupBy(*SERIES).agg(
        F.when(F.count_if(trained) > MIN_STEP_ROWS, steps).otherwise(DEFAULT_SPREAD).alias("step_spread")
    )
    return fits.join(spreads, [*SERIES])


def both_models(naive: Column, ridge: Column, naive_spread: Column, ridge_spread: Column) -> Column:
    """The two models' predictions as rows."""
    models = ((NAIVE, naive, naive_spread), (RIDGE, ridge, ridge_spread))
    return F.inline(
        F.array(*(F.struct(p.alias("prediction"), s.alias("spread"), F.lit(m).alias("model_name")) for m, p, s in models))
    )


@dataset
def raw_backtest(backtest_inputs: DataFrame, ridge_coefficients: DataFrame) -> DataFrame:
    """Hold-out predictions of both models with their spread; without a fit both are the four-week mean."""
    held_out = backtest_inputs.filter("is_holdout").join(ridge_coefficients, [*SERIES])
    ridge = predicted("train", [F.col(f) for f in FEATURES])
    spread = F.coalesce("train_spread", "step_spread")
    naive = F.col("naive_forecast")
    rows = held_out.select("week", *SERIES, both_models(naive, F.coalesce(ridge, naive), spread, spread))
    return rows.withColumn("is_backtest", F.lit(1.0))


@dataset
def raw_future(series_last_state: DataFrame, ridge_coefficients: DataFrame, config: EngineConfig) -> DataFrame:
    """Predictions of both models over the coming weeks with their spread.

    The simple recipe has no recursive future: there, and without a fit, the ridge model repeats the mean too.
    """
    flat = F.array_repeat("last4_mean", config.horizon_weeks)
    spread = F.coalesce("train_spread", "step_spread")
    ahead, ahead_spread = flat, spread
    if config.recipe == "full":
        rolled = rolled_forward(config.horizon_weeks, "last_week", "recent", "n", "last4_mean")
        ahead = F.when(F.col("whole_intercept").isNotNull(), rolled).otherwise(flat)
        ahead_spread = F.coalesce("whole_spread", spread)
    series = series_last_state.join(ridge_coefficients, [*SERIES]).select(
        "last_week", *SERIES, "last4_mean", spread.alias("spread_"), ahead_spread.alias("ahead_spread"), F.posexplode(ahead).alias("i", "ahead")
    )
    return series.select(
        F.date_add("last_week", (F.col("i") + 1) * 7).alias("week"),
        *SERIES,
        both_models(F.col("last4_mean"), F.col("ahead"), F.col("spread_"), F.col("ahead_spread")),
        F.lit(0.0).alias("is_backtest"),
    )


@dataset
def demand_forecast_all(raw_backtest: DataFrame, raw_future: DataFrame) -> DataFrame:
    """Every model's backtest and future forecast with its interval."""
    return with_interval(raw_backtest.unionByName(raw_future))


FORECAST_COLUMNS = ("week", *SERIES, "forecast_units", "lower_ci", "upper_ci")


@dataset
def demand_forecast(demand_forecast_all: DataFrame) -> DataFrame:
    """The ridge backtest, which accuracy is measured on."""
    chosen = (F.col("model_name") == RIDGE) & (F.col("is_backtest") == 1.0)
    return demand_forecast_all.filter(chosen).select(*FORECAST_COLUMNS)


@dataset
def demand_forecast_future(demand_forecast_all: DataFrame) -> DataFrame:
    """Both models over the coming weeks."""
    return demand_forecast_all.filter(F.col("is_backtest") == 0.0).select(*FORECAST_COLUMNS, "model_name")
