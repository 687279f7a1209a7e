"""Order volume, service level and product mix over the trailing quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.config import EngineConfig
from haulcast.functions.calendar import since
from haulcast.functions.expressions import share_true, shown
from haulcast.workspace import dataset, query


@dataset
def recent_orders(silver_erp_orders, as_of: Column, config: EngineConfig) -> DataFrame:
    """Order lines of the trailing quarter, cancelled ones included."""
    return silver_erp_orders.filter(since("order_date", as_of, config.lookback_days))


@query
def order_volume_kpis(recent_orders) -> DataFrame:
    """Order lines, distinct customers, distinct channels and units.

    Lines collapse to one row per customer and channel first; each distinct count then groups those by its own column,
    so no line is multiplied.
    """
    pairs = recent_orders.groupBy("customer_id", "channel").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("units_ordered").alias("units")
    )

    def distinct(column: str) -> Column:
        return pairs.groupBy(column).agg(F.sum("lines")).agg(F.count(column)).scalar()

    totals = pairs.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_orders"), F.sum("units").alias("total_units_ordered")
    )
    return totals.select(
        "total_orders",
        distinct("customer_id").alias("unique_customers"),
        distinct("channel").alias("sales_channels"),
        "total_units_ordered",
    )


@query
def service_performance_kpis(recent_orders) -> DataFrame:
    """Perfect-order, cancellation and backorder rates by line, over all lines."""
    perfect = ~F.col("is_cancelled") & ~F.col("is_backorder") & F.col("is_otif")
    rates = {"perfect_order_rate": perfect, "cancellation_rate": F.col("is_cancelled"), "backorder_rate": F.col("is_backorder")}
    return recent_orders.agg(*(shown(share_true(flag), 4).alias(name) for name, flag in rates.items()))


@query
def product_family_mix(recent_orders) -> DataFrame:
    """Units by family and their share of all units.

    The window without a partition runs over the family sums, one row per product family.
    """
    families = recent_orders.groupBy("sku_family").agg(F.sum("units_ordered").alias("total_units"))
    everything = F.sum("total_units").over(Window.partitionBy())
    percent = shown(F.try_divide(F.col("total_units") * 100.0, everything), 1)
    return families.withColumn("pct_of_total", percent).orderBy(F.col("total_units").desc())


@query
def orders_by_channel(recent_orders) -> DataFrame:
    """Order lines, units and OTIF by sales channel."""
    return (
        recent_orders.groupBy(F.col("channel").alias("sales_channel"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("units_ordered").alias("units_ordered"),
            shown(share_true(F.col("is_otif")), 4).alias("otif_rate"),
        )
        .orderBy(F.col("order_count").desc())
    )
