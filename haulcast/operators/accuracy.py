"""Forecast accuracy: APE by row, MAPE by series, model, week and SKU."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions.expressions import absolute_pct_error
from haulcast.operators.series import SERIES, trailing_mean
from haulcast.workspace import dataset

KEYS = ["week", *SERIES]


def with_error(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecast rows that have an actual, with their absolute percentage error."""
    demand = actual.select(*KEYS, "actual_units")
    return demand.join(forecast, KEYS).withColumn("ape", absolute_pct_error("actual_units", "forecast_units"))


@dataset
def kpi_mape_weekly(weekly_demand_actual: DataFrame, demand_forecast: DataFrame) -> DataFrame:
    """Gold: error of the chosen forecast by week, family and region."""
    return with_error(weekly_demand_actual, demand_forecast).groupBy(*KEYS).agg(F.avg("ape").alias("mape"))


@dataset
def mape_by_series(weekly_demand_actual: DataFrame, demand_forecast_all: DataFrame) -> DataFrame:
    """Backtest error of every model on every series."""
    backtest = demand_forecast_all.filter(F.col("is_backtest") == 1.0)
    return with_error(weekly_demand_actual, backtest).groupBy(*SERIES, "model_name").agg(F.avg("ape").alias("mape"))


@dataset
def mape_global(mape_by_series: DataFrame) -> DataFrame:
    """Mean over series of each model's error."""
    return mape_by_series.groupBy("model_name").agg(F.avg("mape").alias("mape_mean_across_series"))


@dataset
def mape_naive_by_series(weekly_demand_actual: DataFrame, naive_ma4_backtest: DataFrame) -> DataFrame:
    """Backtest error of the four-week mean on every series."""
    return with_error(weekly_demand_actual, naive_ma4_backtest).groupBy(*SERIES).agg(F.avg("ape").alias("mape"))


@dataset
def kpi_mape_sku_weekly(weekly_sku_demand: DataFrame, sku_names: DataFrame) -> DataFrame:
    """Gold: error of the four-week mean by week, SKU and region, from the fifth week on.

    The window runs over weekly sums, so a hot SKU costs it at most one row a week.
    """
    sku_series = ("sku_id", "sku_family", "region")
    naive = weekly_sku_demand.withColumn("forecast_units", trailing_mean("actual_units", 4, *sku_series))
    return (
        naive.filter(F.col("forecast_units").isNotNull())
        .join(sku_names, "sku_id", "left")
        .select(
            "week",
            "sku_id",
            "sku_name",
            "sku_family",
            "region",
            absolute_pct_error("actual_units", "forecast_units").alias("mape"),
        )
    )


def with_backtest(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Every actual with the backtest forecast of its week, where there is one."""
    return actual.select(*KEYS, "actual_units").join(forecast.select(*KEYS, "forecast_units"), KEYS, "left")


@dataset
def demand_vs_forecast_weekly(
    weekly_demand_actual: DataFrame, demand_forecast: DataFrame, demand_forecast_future: DataFrame
) -> DataFrame:
    """Actuals with their backtest forecast, and a future forecast where one overlaps.

    Coming weeks have no actual and so no row; ``demand_outlook`` includes them.
    """
    future = demand_forecast_future.select(*KEYS, F.col("forecast_units").alias("forecast_units_future"))
    return with_backtest(weekly_demand_actual, demand_forecast).join(future, KEYS, "left")
