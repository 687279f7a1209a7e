"""Reference data, order enrichment, costing, inventory, calendar and housekeeping reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions.calendar import calendar_columns, daily_spine
from haulcast.functions.expressions import DC_NAME_WORDS, PLANT_NAME_WORDS, without_words
from haulcast.operators import rules
from haulcast.operators.silver import ORDER_RULES, SIGNALS
from haulcast.sources.quality import rule_report, to_numeric
from haulcast.sources.sinks import broadcast_if_small, row_counts
from haulcast.workspace import dataset, query


@query
def plant_locations(silver_plant_locations) -> DataFrame:
    """Plants with coordinates."""
    columns = ("plant_id", "plant_name", "plant_city", "plant_state", "plant_region", "plant_lat", "plant_lon")
    return silver_plant_locations.select(*columns)


@query
def dc_locations(silver_dc_locations) -> DataFrame:
    """Distribution centres with coordinates."""
    return silver_dc_locations.select("dc_id", "dc_name", "dc_city", "dc_state", "dc_region", "dc_lat", "dc_lon")


@query
def facility_labels(silver_plant_locations, silver_dc_locations, *, prefixes=()) -> DataFrame:
    """Short upper-case map labels of every plant and DC; ``prefixes`` are further words to strip."""
    plants = silver_plant_locations.select(
        F.col("plant_id").alias("location_id"), without_words("plant_name", (*prefixes, *PLANT_NAME_WORDS)).alias("label")
    )
    dcs = silver_dc_locations.select(
        F.col("dc_id").alias("location_id"), without_words("dc_name", (*prefixes, *DC_NAME_WORDS)).alias("label")
    )
    return plants.unionByName(dcs)


@query
def conformed_locations(bronze_plant_locations, bronze_dc_locations) -> DataFrame:
    """Plants and DCs as one list of locations with their type."""
    plants = bronze_plant_locations.select(F.col("plant_id").alias("location_id"), F.lit("plant").alias("location_type"))
    dcs = bronze_dc_locations.select(F.col("dc_id").alias("location_id"), F.lit("dc").alias("location_type"))
    return plants.unionByName(dcs)


@query
def plants_by_region(plants_by_region) -> DataFrame:
    """Plants of every region as one comma-separated text."""
    return plants_by_region.select("region", F.array_join("plants_in_region", ",").alias("plants_in_region"))


@query
def family_counts(sku_dim) -> DataFrame:
    """SKUs by family."""
    return sku_dim.groupBy("sku_family").agg(F.count(F.lit(1)).alias("row_count"))


@query
def channel_counts(customer_dim) -> DataFrame:
    """Customers by sales channel."""
    return customer_dim.groupBy("channel").agg(F.count(F.lit(1)).alias("row_count"))


@dataset
def calendar_spine(bronze_erp_orders_raw) -> DataFrame:
    """Every day from the first to the last order date."""
    bounds = bronze_erp_orders_raw.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    return daily_spine(bounds, "first", "last")


@dataset
def calendar_features(calendar_spine) -> DataFrame:
    """Days with calendar and seasonal columns."""
    return calendar_columns(calendar_spine)


@query
def assign_plant(bronze_erp_orders_raw, plants_by_region) -> DataFrame:
    """A plant of the customer's region for every order line, picked by order number."""
    number = F.substring("order_id", 2, 20).cast("bigint")
    plants = F.col("plants_in_region")
    pick = (F.pmod(number, F.size(plants)) + 1).cast("int")
    lists = plants_by_region.withColumnRenamed("region", "customer_region")
    return bronze_erp_orders_raw.join(lists, "customer_region", "left").select(
        "order_id", "sku_id", "customer_region", F.try_element_at(plants, pick).alias("plant_id")
    )


@query
def promise_dates(bronze_erp_orders_raw) -> DataFrame:
    """Earliest date promised for every order line by its channel's lead time."""
    promised = F.date_add("order_date", rules.lead_days("channel"))
    return bronze_erp_orders_raw.select("order_id", "sku_id", "channel", "order_date", promised.alias("promised_date"))


@query
def shipment_costing(bronze_tms_shipments_raw) -> DataFrame:
    """Cost and CO2 by rule for every shipment, next to the same trip by the other mode."""
    trip = ("route_distance_km", "total_weight_tons")
    other = F.when(F.col("mode") == "carrier", "own_fleet").otherwise("carrier").alias("other_mode")
    return bronze_tms_shipments_raw.select("shipment_id", "truck_id", *trip, "mode", other).select(
        "*",
        rules.freight_cost(*trip, "mode").alias("freight_cost_usd"),
        rules.co2_kg(*trip, "mode").alias("co2_kg"),
        rules.freight_cost(*trip, "other_mode").alias("other_freight_cost_usd"),
        rules.co2_kg(*trip, "other_mode").alias("other_co2_kg"),
    )


@query
def order_enrichment(
    bronze_erp_orders_raw, customer_dim, sku_dim, primary_dc_by_region, plants_by_region, calendar_features,
    bronze_external_signals_raw,
) -> DataFrame:
    """Order lines with the attributes of their customer, SKU, region and day, and the day's signals, none dropped.

    The daily signals are broadcast if what is written of them is small; beyond that Spark joins them by day and region.
    """
    lines = bronze_erp_orders_raw.select("order_id", "order_date", "customer_id", "sku_id", "units_ordered")
    people = customer_dim.withColumnsRenamed({"customer_region": "home_region", "channel": "home_channel"})
    skus = sku_dim.withColumnsRenamed({"sku_family": "rule_family", "unit_price": "list_price"})
    sites = primary_dc_by_region.join(plants_by_region, "region", "full").select(
        F.col("region").alias("home_region"), "primary_dc_id", F.size("plants_in_region").alias("plants_nearby")
    )
    days = calendar_features.select(F.col("date").alias("order_date"), "season_annual", "weekday_factor")
    signals = bronze_external_signals_raw.withColumnsRenamed({"date": "order_date", "region": "home_region"})
    return (
        lines.join(people, "customer_id", "left")
        .join(skus, "sku_id", "left")
        .join(sites, "home_region", "left")
        .join(days, "order_date", "left")
        .join(broadcast_if_small(signals), ["order_date", "home_region"], "left")
    )


@query
def inventory_days_of_supply(silver_inventory_positions) -> DataFrame:
    """Days of supply recomputed by rule from stock and safety stock."""
    days = rules.days_of_supply("on_hand_units", "safety_stock_units")
    return silver_inventory_positions.select(
        "snapshot_date", "location_id", "sku_id", "on_hand_units", "safety_stock_units", days.alias("days_of_supply")
    )


@query
def inventory_position_summary(silver_inventory_positions) -> DataFrame:
    """Stock, safety stock and positions below it by location."""
    below = F.col("on_hand_units") < F.col("safety_stock_units")
    return silver_inventory_positions.groupBy("location_type", "location_id").agg(
        F.count(F.lit(1)).alias("positions"),
        F.sum("on_hand_units").alias("on_hand_units"),
        F.sum("on_order_units").alias("on_order_units"),
        F.sum("safety_stock_units").alias("safety_stock_units"),
        F.count_if(below).alias("below_safety"),
        F.avg("days_of_supply").alias("avg_days_of_supply"),
    )


@query
def expect_or_drop_orders(bronze_erp_orders_raw) -> DataFrame:
    """Order lines kept and dropped by the cleaning expectation."""
    return rule_report(bronze_erp_orders_raw, ORDER_RULES)


@query
def ensure_numeric(bronze_erp_orders_raw) -> DataFrame:
    """Prices and states of order lines read as text and coerced to numbers; unreadable text is null."""
    text = bronze_erp_orders_raw.select(
        "order_id", "sku_id", F.col("unit_price").cast("string").alias("unit_price"), F.col("order_status").alias("status")
    )
    return to_numeric(text, ["unit_price", "status", "not_there"])


@query
def table_row_counts(
    bronze_erp_orders_raw, bronze_tms_shipments_raw, bronze_inventory_positions_raw, bronze_production_output_raw,
    bronze_external_signals_raw, bronze_plant_locations, bronze_dc_locations,
) -> DataFrame:
    """Row count of every Bronze table."""
    frames = (
        bronze_erp_orders_raw, bronze_tms_shipments_raw, bronze_inventory_positions_raw, bronze_production_output_raw,
        bronze_external_signals_raw, bronze_plant_locations, bronze_dc_locations,
    )
    names = (
        "bronze_erp_orders_raw", "bronze_tms_shipments_raw", "bronze_inventory_positions_raw",
        "bronze_production_output_raw", "bronze_external_signals_raw", "bronze_plant_locations", "bronze_dc_locations",
    )
    return row_counts(zip(names, frames, strict=True))


@query
def last_signal(series_last_state) -> DataFrame:
    """Last known signals of every series."""
    return series_last_state.select("sku_family", "region", "last_week", *SIGNALS)
