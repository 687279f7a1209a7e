"""Questions answered through the metric views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.calendar import since
from haulcast.functions.expressions import dollar_text, percent_text, shown, steady
from haulcast.operators.metric_view import CONTROL_TOWER, FORECAST_ACCURACY, LATE_RISK
from haulcast.workspace import query

WEEKS = 13
LANE = ["plant_id", "dc_id"]


def _since_weeks(as_of: Column, weeks: int = WEEKS) -> Column:
    return since("week", as_of, 7 * weeks)


def _worst(name: str) -> Column:
    return steady(f"`{name}`").desc()


def _rounded(name: str, digits: int) -> Column:
    return shown(F.col(f"`{name}`"), digits).alias(name)


@query
def mv_exec_13w(control_tower_weekly, as_of: Column) -> DataFrame:
    """All control-tower measures by week over the trailing quarter, for display."""
    by_week = CONTROL_TOWER.query(
        control_tower_weekly, list(CONTROL_TOWER.measures), ["week"], _since_weeks(as_of), [F.col("week")]
    )
    return by_week.select(
        "week",
        percent_text("OTIF").alias("OTIF"),
        dollar_text("Freight $/ton").alias("Freight $/ton"),
        percent_text("Premium freight %").alias("Premium Freight"),
        _rounded("CO2 kg/ton", 3),
        _rounded("Energy kWh/unit", 3),
    )


@query
def mv_otif_region_13w(control_tower_weekly, as_of: Column) -> DataFrame:
    """OTIF by week and region over the trailing quarter, for display."""
    keys = ["week", "region"]
    rates = CONTROL_TOWER.query(control_tower_weekly, ["OTIF"], keys, _since_weeks(as_of), keys)
    return rates.select(*keys, percent_text("OTIF").alias("OTIF"))


@query
def mv_worst_dcs(control_tower_weekly, as_of: Column, *, count=10) -> DataFrame:
    """DCs with the lowest OTIF over the trailing quarter, for display."""
    order = [steady("OTIF").asc(), F.col("dc_id")]
    rates = CONTROL_TOWER.query(control_tower_weekly, ["OTIF"], ["dc_id"], _since_weeks(as_of), order, count)
    return rates.select(F.col("dc_id").alias("DC"), percent_text("OTIF").alias("OTIF (13w)"))


@query
def mv_premium_lanes(control_tower_weekly, as_of: Column, *, count=10) -> DataFrame:
    """Lanes with the highest premium-freight share over the trailing quarter, for display."""
    name = "Premium freight %"
    lanes = CONTROL_TOWER.query(control_tower_weekly, [name], LANE, _since_weeks(as_of), [_worst(name), *LANE], count)
    return lanes.select(
        F.col("plant_id").alias("Plant"), F.col("dc_id").alias("DC"), percent_text(name).alias("Premium Freight (13w)")
    )


@query
def mv_freight_lanes(control_tower_weekly, as_of: Column, *, count=10) -> DataFrame:
    """Lanes with the highest cost per ton over the trailing quarter, for display."""
    cost, premium, co2 = "Freight $/ton", "Premium freight %", "CO2 kg/ton"
    lanes = CONTROL_TOWER.query(
        control_tower_weekly, [cost, premium, co2], LANE, _since_weeks(as_of), [_worst(cost), *LANE], count
    )
    return lanes.select(
        F.col("plant_id").alias("Plant"),
        F.col("dc_id").alias("DC"),
        dollar_text(cost).alias(cost),
        percent_text(premium).alias("Premium Freight %"),
        _rounded(co2, 3),
    )


@query
def mv_otif_now(control_tower_weekly, as_of: Column, *, days=30) -> DataFrame:
    """OTIF over the trailing days, one number."""
    now = CONTROL_TOWER.query(control_tower_weekly, ["OTIF"], where=since("week", as_of, days))
    return now.select(F.col("OTIF").alias("otif_rate"))


@query
def mv_mape_worst(kpi_mape_weekly, as_of: Column, *, count=10) -> DataFrame:
    """Series with the worst forecast error over the trailing quarter, for display."""
    keys = ["sku_family", "region"]
    rates = FORECAST_ACCURACY.query(kpi_mape_weekly, ["MAPE"], keys, _since_weeks(as_of), [_worst("MAPE"), *keys], count)
    return rates.select(
        F.col("sku_family").alias("Family"), F.col("region").alias("Region"), percent_text("MAPE").alias("MAPE (13w)")
    )


@query
def mv_mape_region(kpi_mape_weekly, as_of: Column) -> DataFrame:
    """Forecast error by region over the trailing quarter."""
    rates = FORECAST_ACCURACY.query(kpi_mape_weekly, ["MAPE"], ["region"], _since_weeks(as_of), [F.col("MAPE").desc()])
    return rates.select("region", F.col("MAPE").alias("mape"))


@query
def mv_late_risk_by_region(order_late_risk_scored_ml) -> DataFrame:
    """Predicted and observed lateness and orders scored by region and week of order."""
    return LATE_RISK.query(order_late_risk_scored_ml, list(LATE_RISK.measures), ["order_week", "customer_region"])


@query
def otif_trend_slope_13w(control_tower_weekly, as_of: Column) -> DataFrame:
    """Weekly change of OTIF by region over the trailing quarter, steepest fall first."""
    keys = ["week", "region"]
    rates = CONTROL_TOWER.query(control_tower_weekly, ["OTIF"], keys, _since_weeks(as_of))
    week_no = F.datediff("week", F.lit("1970-01-05").cast("date")) / 7.0
    slope = F.regr_slope("OTIF", week_no).alias("otif_slope")
    return rates.groupBy("region").agg(slope, F.count(F.lit(1)).alias("weeks")).orderBy("otif_slope")
