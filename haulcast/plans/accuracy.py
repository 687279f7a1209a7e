"""Forecast accuracy roll-ups by family, region and SKU."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions.expressions import absolute_pct_error, percent_text, severity_tier, steady
from haulcast.operators.accuracy import KEYS
from haulcast.operators.series import SERIES
from haulcast.plans.ranking import top
from haulcast.workspace import query


def series_means(kpi_mape_weekly: DataFrame) -> DataFrame:
    return kpi_mape_weekly.groupBy(*SERIES).agg(F.avg("mape").alias("avg_mape"))


@query
def ape_rows(weekly_demand_actual, demand_forecast) -> DataFrame:
    """Absolute percentage error of every forecast week."""
    joined = weekly_demand_actual.select(*KEYS, "actual_units").join(demand_forecast.select(*KEYS, "forecast_units"), KEYS)
    return joined.withColumn("ape", absolute_pct_error("actual_units", "forecast_units"))


@query
def mape_by_family_region(kpi_mape_weekly, *, count=None) -> DataFrame:
    """Mean error of every series, worst first."""
    return top(series_means(kpi_mape_weekly), count, steady("avg_mape").desc(), *SERIES)


def sku_means(kpi_mape_sku_weekly: DataFrame, sku_family: str | None) -> DataFrame:
    rows = kpi_mape_sku_weekly
    if sku_family is not None:
        rows = rows.filter(F.col("sku_family") == sku_family)
    return rows.groupBy("sku_id", "sku_name", "sku_family", "region").agg(
        F.avg("mape").alias("avg_mape"), F.count(F.lit(1)).alias("weeks_measured")
    )


@query
def mape_by_sku(kpi_mape_sku_weekly, *, sku_family=None, count=None) -> DataFrame:
    """Mean error of every SKU of one family or all, worst first."""
    return top(sku_means(kpi_mape_sku_weekly, sku_family), count, steady("avg_mape").desc(), "sku_id", "region")


@query
def mape_sku_summary(kpi_mape_sku_weekly, *, sku_family=None) -> DataFrame:
    """Number of SKUs measured with mean, worst and best error over their regions."""
    means = sku_means(kpi_mape_sku_weekly, sku_family)
    return means.agg(
        F.count_distinct("sku_id").alias("skus_analyzed"),
        F.avg("avg_mape").alias("avg_mape"),
        F.max("avg_mape").alias("worst_mape"),
        F.min("avg_mape").alias("best_mape"),
    )


@query
def mape_family_summary(kpi_mape_weekly) -> DataFrame:
    """Mean over regions of each family's error, also as text."""
    families = series_means(kpi_mape_weekly).groupBy("sku_family").agg(F.avg("avg_mape").alias("avg_mape"))
    return families.withColumn("avg_mape_pct", percent_text("avg_mape")).orderBy(F.col("avg_mape").desc())


@query
def mape_severity(kpi_mape_weekly) -> DataFrame:
    """Each family's mean error with its severity tier."""
    families = series_means(kpi_mape_weekly).groupBy("sku_family").agg(F.avg("avg_mape").alias("avg_mape"))
    return families.withColumn("severity", severity_tier("avg_mape"))


@query
def mape_pivot(kpi_mape_weekly, *, regions=None) -> DataFrame:
    """Families down, regions across. The regions come from the caller or from the errors themselves."""
    return kpi_mape_weekly.groupBy(*SERIES).agg(F.avg("mape").alias("avg_mape")).groupBy("sku_family").pivot(
        "region", regions
    ).agg(F.avg("avg_mape"))


@query
def mape_baseline(kpi_mape_weekly, *, sku_family=None, count=3) -> DataFrame:
    """Mean error over series, overall or for one family, and the families of the worst series."""
    means = series_means(kpi_mape_weekly)
    worst = top(means, count, steady("avg_mape").desc(), *SERIES)
    ranked = F.sort_array(F.collect_list(F.struct((-steady("avg_mape")).alias("rank"), *SERIES)))
    worst_list = worst.agg(F.array_join(F.transform(ranked, lambda s: s["sku_family"]), ",")).scalar()
    wanted = means if sku_family is None else means.filter(F.col("sku_family") == sku_family)
    return wanted.agg(F.avg("avg_mape").alias("baseline_mape")).withColumn("top_families", worst_list)
