"""Silver: cleaned operational tables. Every function is row-wise except the weekly signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions.calendar import week_of
from haulcast.sources.quality import keep_valid
from haulcast.workspace import dataset

# Expectation of the cleaned orders: rule name and the condition a kept row meets.
ORDER_RULES = {"nonnegative_shipped": "units_shipped >= 0"}


def add_order_flags(orders: DataFrame) -> DataFrame:
    """Service flags of order lines; also valid on a streaming DataFrame.

    A missing delivery date is not on time. A missing request date or unit count leaves
    the flag null, and the weekly KPIs skip it.
    """
    delivered, requested = F.col("actual_delivery_date"), F.col("requested_delivery_date")
    flagged = orders.withColumns(
        {
            "order_week": week_of("order_date"),
            "is_cancelled": F.col("order_status") == "cancelled",
            "is_backorder": F.col("order_status") == "backorder",
            "is_in_full": F.col("units_shipped") == F.col("units_ordered"),
            "is_on_time": F.when(delivered.isNull(), False).otherwise(delivered <= requested),
        }
    )
    return flagged.withColumn("is_otif", F.expr("is_in_full AND is_on_time AND NOT is_cancelled"))


@dataset
def silver_erp_orders(bronze_erp_orders_raw: DataFrame) -> DataFrame:
    """Silver: order lines with non-negative shipped units, order week and service flags."""
    return add_order_flags(keep_valid(bronze_erp_orders_raw, ORDER_RULES))


@dataset
def silver_tms_shipments(bronze_tms_shipments_raw: DataFrame) -> DataFrame:
    """Silver: shipments with ship week and plant-to-DC lane."""
    return bronze_tms_shipments_raw.withColumns(
        {"ship_week": week_of("ship_date"), "lane_id": F.concat_ws("→", "plant_id", "dc_id")}
    )


@dataset
def silver_inventory_positions(bronze_inventory_positions_raw: DataFrame) -> DataFrame:
    """Silver: stock snapshots with one location id and its type."""
    at_plant = F.col("plant_id").isNotNull()
    return bronze_inventory_positions_raw.withColumns(
        {
            "location_id": F.coalesce("plant_id", "dc_id"),
            "location_type": F.when(at_plant, "plant").otherwise("dc"),
        }
    )


@dataset
def silver_production_output(bronze_production_output_raw: DataFrame) -> DataFrame:
    """Silver: production output with week."""
    return bronze_production_output_raw.withColumn("week", week_of("date"))


SIGNALS = ("construction_index", "precipitation_mm", "avg_temp_c")


@dataset
def silver_external_signals(bronze_external_signals_raw: DataFrame) -> DataFrame:
    """Silver: weekly mean of every external signal by region."""
    return bronze_external_signals_raw.groupBy(week_of("date").alias("week"), "region").agg(
        *(F.avg(s).alias(s) for s in SIGNALS)
    )


@dataset
def silver_plant_locations(bronze_plant_locations: DataFrame) -> DataFrame:
    """Silver: plant locations."""
    return bronze_plant_locations


@dataset
def silver_dc_locations(bronze_dc_locations: DataFrame) -> DataFrame:
    """Silver: distribution centre locations."""
    return bronze_dc_locations
