"""Demand planner: one series at a time, demand against forecast, weekly planner KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.calendar import month_of
from haulcast.functions.expressions import UNITS_FLOOR, count_text, ratio_floored, signed_pct_error, steady
from haulcast.operators.accuracy import KEYS, with_backtest
from haulcast.operators.ridge import RIDGE
from haulcast.operators.series import SERIES
from haulcast.plans.ranking import top
from haulcast.workspace import query


def one_series(frame: DataFrame, region: str | None, sku_family: str | None) -> DataFrame:
    """Slice by region and family; ``None`` leaves that side open."""
    if region is not None:
        frame = frame.filter(F.col("region") == region)
    if sku_family is not None:
        frame = frame.filter(F.col("sku_family") == sku_family)
    return frame


@query
def planner_actual_slice(weekly_demand_actual, *, region=None, sku_family=None) -> DataFrame:
    """Actual and shipped units of one series by week."""
    sliced = one_series(weekly_demand_actual, region, sku_family)
    return sliced.select("week", "actual_units", "shipped_units").orderBy("week")


@query
def planner_backtest_slice(demand_forecast_all, *, region=None, sku_family=None) -> DataFrame:
    """Backtest forecasts of one series by week and model."""
    sliced = one_series(demand_forecast_all, region, sku_family).filter(F.col("is_backtest") == 1.0)
    return sliced.select("week", "forecast_units", "model_name").orderBy("week", "model_name")


@query
def planner_future_slice(demand_forecast_future, *, region=None, sku_family=None) -> DataFrame:
    """Future forecasts of one series by week and model, with whatever bounds the source carries."""
    bounds = [c for c in ("lower_ci", "upper_ci") if c in demand_forecast_future.columns]
    sliced = one_series(demand_forecast_future, region, sku_family)
    return sliced.select("week", "forecast_units", *bounds, "model_name").orderBy("week", "model_name")


def backorders(demand: DataFrame) -> DataFrame:
    """Weekly units ordered but not shipped, and their share of the units ordered."""
    ordered, shipped = F.sum("actual_units").cast("double"), F.sum("shipped_units").cast("double")
    return (
        demand.groupBy("week")
        .agg((ordered - shipped).alias("backorder_units_proxy"), ordered.alias("ordered_units"))
        .withColumn("backorder_rate_proxy", ratio_floored("backorder_units_proxy", "ordered_units", UNITS_FLOOR))
    )


@query
def backorders_weekly(weekly_demand_actual, *, region=None, sku_family=None) -> DataFrame:
    """Backorder proxy by week, of one series or all."""
    return backorders(one_series(weekly_demand_actual, region, sku_family))


@query
def planner_kpis(
    kpi_mape_weekly,
    weekly_demand_actual,
    demand_forecast_all,
    *,
    region=None,
    sku_family=None,
    model=RIDGE,
) -> DataFrame:
    """Error, bias and backorders of one series, week by week over the backtest."""
    error = one_series(kpi_mape_weekly, region, sku_family).select("week", "mape")
    backtest = demand_forecast_all.filter((F.col("is_backtest") == 1.0) & (F.col("model_name") == model))
    bias = (
        one_series(weekly_demand_actual, region, sku_family)
        .join(one_series(backtest, region, sku_family).select("week", "forecast_units"), "week")
        .select("week", signed_pct_error("actual_units", "forecast_units").alias("bias"))
    )
    owed = backorders(one_series(weekly_demand_actual, region, sku_family)).drop("ordered_units")
    return error.join(bias, "week", "full").join(owed, "week", "left").orderBy("week")


@query
def top_mape_problems(kpi_mape_weekly, *, count=10) -> DataFrame:
    """Series with the worst mean error."""
    mean = kpi_mape_weekly.groupBy(*SERIES).agg(F.avg("mape").alias("avg_mape"))
    return top(mean, count, steady("avg_mape").desc(), *SERIES)


@query
def demand_vs_forecast_recent(weekly_demand_actual, demand_forecast, *, count=None) -> DataFrame:
    """Actuals with their backtest forecast, newest first."""
    return top(with_backtest(weekly_demand_actual, demand_forecast), count, F.col("week").desc(), *SERIES)


@query
def demand_outlook(weekly_demand_actual, demand_forecast, demand_forecast_future, *, model=RIDGE) -> DataFrame:
    """Demand against forecast with the coming weeks included, one model's future only."""
    future = demand_forecast_future.filter(F.col("model_name") == model)
    ahead = future.select(*KEYS, F.col("forecast_units").alias("forecast_units_future"))
    return with_backtest(weekly_demand_actual, demand_forecast).join(ahead, KEYS, "full")


@query
def demand_vs_forecast_series(demand_vs_forecast_weekly, *, region=None, sku_family=None, count=None) -> DataFrame:
    """One series formatted for display, newest weeks first."""
    rows = one_series(demand_vs_forecast_weekly, region, sku_family)
    newest = top(rows, count, F.col("week").desc(), "actual_units", "forecast_units", "forecast_units_future")
    return newest.select(
        *KEYS,
        count_text("actual_units").alias("Actual Units"),
        count_text("forecast_units").alias("Forecast Units"),
        count_text("forecast_units_future").alias("Future Forecast Units"),
    )


@query
def demand_long(weekly_demand_actual, demand_forecast, *, region=None, sku_family=None) -> DataFrame:
    """Actual and forecast units as one row per week and measure, for charting."""
    wide = one_series(with_backtest(weekly_demand_actual, demand_forecast), region, sku_family)
    wide = wide.withColumn("actual_units", F.col("actual_units").cast("double"))
    return wide.unpivot(KEYS, ["actual_units", "forecast_units"], "series", "units")


@query
def series_plot_data(weekly_demand_actual, demand_forecast_all, *, region=None, sku_family=None) -> DataFrame:
    """One series: actuals with every model's forecast of the week."""
    actual = one_series(weekly_demand_actual, region, sku_family).select("week", F.col("actual_units").alias("actual"))
    predicted = one_series(demand_forecast_all, region, sku_family).select(
        "week", "model_name", F.col("forecast_units").alias("forecast"), "is_backtest"
    )
    return actual.join(predicted, "week", "left").orderBy("week", "model_name")


@query
def actual_vs_forecast_month(weekly_demand_actual, demand_forecast, as_of: Column) -> DataFrame:
    """Units ordered and forecast by region, over the weeks that start in today's month."""
    month = month_of("week") == month_of(as_of)
    totals = with_backtest(weekly_demand_actual, demand_forecast).filter(month).groupBy("region")
    return totals.agg(*(F.sum(c).alias(c) for c in ("actual_units", "forecast_units"))).orderBy("region")


@query
def ridge_future(demand_forecast_future) -> DataFrame:
    """Future forecast of the ridge model alone."""
    return demand_forecast_future.filter(F.col("model_name") == RIDGE)


@query
def forecast_next_month(demand_forecast_future, as_of: Column, *, days=28, model=None) -> DataFrame:
    """Units forecast for the coming days by series. Adds up all models unless one is chosen."""
    week = F.col("week")
    coming = demand_forecast_future.filter((week >= as_of) & (week < F.date_add(as_of, days)))
    if model is not None:
        coming = coming.filter(F.col("model_name") == model)
    totals = coming.groupBy("region", "sku_family").agg(F.sum("forecast_units").alias("forecast"))
    return totals.orderBy(F.col("forecast").desc())
