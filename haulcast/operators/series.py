"""Ordered weekly series: lags, rolling means, hold-out split, calendar grid.

Every window is partitioned by series and sees weekly aggregates, so a partition never
holds more rows than there are weeks, however many order lines the series has. Lags count
rows, not calendar weeks; ``dense_week_grid`` is the gap-free input for callers who want that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.config import EngineConfig
from haulcast.functions.expressions import season_angle
from haulcast.operators.ridge import MEMORY
from haulcast.operators.silver import SIGNALS
from haulcast.workspace import dataset

SERIES = ("sku_family", "region")

# Hold-out rule for short series.
SHORT_SERIES_WEEKS = 60
SHORT_SERIES_MARGIN = 10
MIN_HOLDOUT = 8
MAX_SHORT_HOLDOUT = 26


@dataset
def forecast_training_set(weekly_demand_actual: DataFrame, silver_external_signals: DataFrame) -> DataFrame:
    """Weekly demand of every series with the region's external signals of the week."""
    signals = silver_external_signals.groupBy("week", "region").agg(*(F.avg(s).alias(s) for s in SIGNALS))
    demand = weekly_demand_actual.select("week", *SERIES, F.col("actual_units").cast("double").alias("y"))
    return demand.join(signals, ["week", "region"], "left")


def by_week(*keys: str):
    return Window.partitionBy(*keys).orderBy("week")


def trailing_mean(value: str, rows: int, *keys: str) -> Column:
    """Mean of the previous ``rows`` rows, null until that many values exist."""
    frame = by_week(*keys).rowsBetween(-rows, -1)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


@dataset
def series_features(forecast_training_set: DataFrame) -> DataFrame:
    """Model inputs per series and week: time index, season, lags, four-week mean, signals."""
    order = by_week(*SERIES)
    angle = season_angle("week")
    return forecast_training_set.select(
        "week",
        *SERIES,
        "y",
        (F.row_number().over(order) - 1).cast("double").alias("t"),
        F.sin(angle).alias("sin_woy"),
        F.cos(angle).alias("cos_woy"),
        *(F.lag("y", k).over(order).alias(f"lag_{k}") for k in (1, 4, 52)),
        trailing_mean("y", 4, *SERIES).alias("roll4"),
        *SIGNALS,
    )


def holdout_weeks(n: Column, config: EngineConfig) -> Column:
    """How many of a series' last ``n`` weeks are held out."""
    quarter = F.greatest(F.lit(MIN_HOLDOUT), F.floor(n / 4).cast("int"))
    if config.recipe == "simple":
        return F.least(F.lit(config.backtest_weeks), quarter)
    short = n <= max(SHORT_SERIES_WEEKS, config.backtest_weeks + SHORT_SERIES_MARGIN)
    return F.when(short, F.least(F.lit(MAX_SHORT_HOLDOUT), quarter)).otherwise(config.backtest_weeks)


@dataset
def backtest_split(series_features: DataFrame, config: EngineConfig) -> DataFrame:
    """Series features with series length, hold-out length and hold-out flag."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*SERIES)).cast("int")
    counted = series_features.withColumn("n", n)
    sized = counted.withColumn("holdout_weeks", holdout_weeks(F.col("n"), config).cast("int"))
    return sized.withColumn("is_holdout", F.col("t") >= F.col("n") - F.col("holdout_weeks"))


@dataset
def series_last_state(backtest_split: DataFrame) -> DataFrame:
    """One row per series: last week, mean of its last four weeks, its last year in order, last known signals."""
    known = {s: F.max_by(s, F.when(F.col(s).isNotNull(), F.col("week"))) for s in SIGNALS}
    year = F.sort_array(F.collect_list(F.when(F.col("t") >= F.col("n") - MEMORY, F.struct("t", "y"))))
    return backtest_split.groupBy(*SERIES).agg(
        F.max("week").alias("last_week"),
        F.max("n").alias("n"),
        year.getField("y").alias("recent"),
        F.avg(F.when(F.col("t") >= F.col("n") - 4, F.col("y"))).alias("last4_mean"),
        *(F.coalesce(v, F.lit(0.0)).alias(s) for s, v in known.items()),
    )


@dataset
def future_weeks(series_last_state: DataFrame, config: EngineConfig) -> DataFrame:
    """The forecast horizon of every series, one row per coming week."""
    last = F.col("last_week")
    first, end = F.date_add(last, 7), F.date_add(last, 7 * config.horizon_weeks)
    return series_last_state.select(
        *SERIES, F.explode(F.sequence(first, end, F.expr("interval 7 days"))).alias("week"), "last4_mean"
    )


@dataset
def dense_week_grid(weekly_demand_actual: DataFrame) -> DataFrame:
    """Demand for every series and every week of the history; missing weeks count zero.

    Each series expands the same list of weeks, one scalar, so there is no cross join and the
    rows per series stay within the number of weeks.
    """
    weeks = F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))
    history = weekly_demand_actual.agg(weeks).scalar()
    grid = weekly_demand_actual.select(*SERIES).distinct().select(*SERIES, F.explode(history).alias("week"))
    return grid.join(weekly_demand_actual, ["week", *SERIES], "left").na.fill(
        0, ["actual_units", "shipped_units", "order_lines"]
    )
