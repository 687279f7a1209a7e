"""Bronze inputs derived from the test schema (FIXTURES.md holds the same mapping as SQL).

On real data these datasets are simply tables: pass them to ``Workspace(tables=...)`` or
``Workspace.from_schema`` and nothing in this module runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.calendar import month_of
from haulcast.functions.expressions import padded
from haulcast.operators import rules
from haulcast.workspace import dataset

# Fixed values of the mapping: plants and DCs that order lines are spread over.
PLANTS = 25
DCS = 11
SITE_PREFIX = "Site "


def _tagged(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), padded(number, width))


@dataset
def newest_order_date(orders: DataFrame) -> DataFrame:
    """One row: the newest order date, which stands for today unless the caller sets as_of."""
    return orders.agg(F.max("o_orderdate").cast("date").alias("as_of"))


@dataset
def nation_region(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Nations with their region name."""
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region")
    )


def _facilities(places: DataFrame, kind: str, prefix: str, label: str, lat: Column, lon: Column) -> DataFrame:
    return places.select(
        _tagged(prefix, F.col("n_nationkey") + 1, 2).alias(f"{kind}_id"),
        F.concat(F.lit(SITE_PREFIX), "n_name", F.lit(f" {label}")).alias(f"{kind}_name"),
        F.col("n_name").alias(f"{kind}_city"),
        F.lit("ST").alias(f"{kind}_state"),
        lat.alias(f"{kind}_lat"),
        lon.alias(f"{kind}_lon"),
        F.col("region").alias(f"{kind}_region"),
    )


@dataset
def bronze_plant_locations(nation_region: DataFrame) -> DataFrame:
    """Bronze: plant reference rows."""
    n = F.col("n_nationkey")
    return _facilities(nation_region, "plant", "PL", "Plant", 30.0 + n * 0.75, -120.0 + n * 2.5)


@dataset
def bronze_dc_locations(nation_region: DataFrame) -> DataFrame:
    """Bronze: distribution centre reference rows."""
    n = F.col("n_nationkey")
    return _facilities(nation_region, "dc", "DC", "Distribution", 31.0 + n * 0.9, -118.0 + n * 3.5)


@dataset
def customer_profile(customer: DataFrame, nation_region: DataFrame) -> DataFrame:
    """Customers with region, sales channel and serving DC."""
    segment = F.col("c_mktsegment")
    channel = (
        F.when(segment.isin("MACHINERY", "FURNITURE"), "distributor")
        .when(segment == "BUILDING", "contractor")
        .when(segment == "AUTOMOBILE", "DOT")
        .otherwise("ag")
    )
    return customer.join(nation_region, customer.c_nationkey == nation_region.n_nationkey).select(
        "c_custkey",
        _tagged("C", F.col("c_custkey"), 6).alias("customer_id"),
        "region_key",
        F.col("region").alias("customer_region"),
        channel.alias("channel"),
        _tagged("DC", F.col("c_nationkey") % DCS + 1, 2).alias("dc_id"),
    )


def part_family() -> Column:
    kind = F.col("p_type")
    return (
        F.when(kind.isin("ECONOMY", "STANDARD", "SMALL"), "pipe")
        .when(kind.isin("MEDIUM", "PROMO"), "chambers")
        .otherwise("structures")
    )


@dataset
def sku_names(part: DataFrame) -> DataFrame:
    """SKU ids with their display names."""
    return part.select(_tagged("SKU", F.col("p_partkey"), 5).alias("sku_id"), F.col("p_name").alias("sku_name"))


@dataset
def bronze_erp_orders_raw(lineitem: DataFrame, orders: DataFrame, customer_profile: DataFrame, part: DataFrame) -> DataFrame:
    """Bronze: one row per order line.

    Customers join the order headers before the lines do, so the widest input is shuffled
    once by part and once by order, never by customer.
    """
    headers = orders.join(customer_profile, orders.o_custkey == customer_profile.c_custkey).select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("order_date"),
        "customer_id",
        "customer_region",
        "channel",
        "dc_id",
    )
    skus = part.select("p_partkey", part_family().alias("sku_family"), F.col("p_retailprice").alias("unit_price"))

    order_key, line, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    pick_days = F.col("l_partkey") % 3
    status = (
        F.when(order_key % 50 == 7, "cancelled").when((order_key + line) % 12 == 5, "backorder").otherwise("closed")
    )
    lines = (
        lineitem.join(skus, lineitem.l_partkey == skus.p_partkey)
        .join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumns({"order_status": status, "units_ordered": F.col("l_quantity").cast("int")})
    )

    live = F.col("order_status") != "cancelled"
    units = F.col("units_ordered")
    ship = F.date_add("order_date", (1 + pick_days).cast("int"))
    delivery = F.date_add("order_date", (2 + pick_days + (order_key + line * 3 + supplier) % 9).cast("int"))
    return lines.select(
        _tagged("O", order_key, 10).alias("order_id"),
        "order_date",
        F.date_add("order_date", (5 + order_key % 13).cast("int")).alias("requested_delivery_date"),
        F.when(live, ship).alias("actual_ship_date"),
        F.when(live, delivery).alias("actual_delivery_date"),
        "customer_id",
        "customer_region",
        "channel",
        _tagged("PL", supplier % PLANTS + 1, 2).alias("plant_id"),
        "dc_id",
        _tagged("SKU", F.col("l_partkey"), 5).alias("sku_id"),
        "sku_family",
        "units_ordered",
        F.when(~live, 0)
        .when(F.col("order_status") == "backorder", (units / 2).cast("int"))
        .otherwise(units)
        .alias("units_shipped"),
        "unit_price",
        "order_status",
    )


@dataset
def bronze_tms_shipments_raw(bronze_erp_orders_raw: DataFrame) -> DataFrame:
    """Bronze: one shipment per shipped order line, costed by the freight rules."""
    order_no = F.substring("order_id", 2, 20).cast("bigint")
    sku_no = F.substring("sku_id", 4, 20).cast("bigint")
    shipped = rules.shippable(bronze_erp_orders_raw).select(
        F.concat(F.lit("S"), F.substring("order_id", 2, 20)).alias("shipment_id"),
        "order_id",
        "plant_id",
        "dc_id",
        _tagged("T", order_no % 1200 + 1, 5).alias("truck_id"),
        (300 + (order_no * 7 + sku_no * 13) % 900).cast("double").alias("route_distance_km"),
        F.when((order_no + sku_no) % 10 < 7, "own_fleet").otherwise("carrier").alias("mode"),
        F.col("actual_ship_date").alias("ship_date"),
        F.col("actual_delivery_date").alias("delivery_date"),
        rules.shipment_tons("units_shipped", "sku_family").alias("total_weight_tons"),
    )
    return shipped.withColumns(
        {
            "freight_cost_usd": rules.freight_cost("route_distance_km", "total_weight_tons", "mode"),
            "co2_kg": rules.co2_kg("route_distance_km", "total_weight_tons", "mode"),
        }
    )


@dataset
def bronze_production_output_raw(bronze_erp_orders_raw: DataFrame) -> DataFrame:
    """Bronze: units made and energy used per day, plant and family."""
    made = F.sum("units_ordered")
    family = F.col("sku_family")
    kwh_per_unit = F.when(family == "pipe", 1.9).when(family == "chambers", 3.4).otherwise(5.2)
    return (
        bronze_erp_orders_raw.filter(F.col("actual_ship_date").isNotNull())
        .groupBy(F.col("actual_ship_date").alias("date"), "plant_id", "sku_family")
        .agg(made.alias("units_produced"), (made.cast("double") * kwh_per_unit).alias("energy_kwh"))
    )


@dataset
def bronze_external_signals_raw(orders: DataFrame, customer_profile: DataFrame) -> DataFrame:
    """Bronze: daily construction and weather signals for every region with orders that day."""
    region_no = F.col("region_key")
    doy = F.dayofyear("date")
    return (
        orders.join(customer_profile, orders.o_custkey == customer_profile.c_custkey)
        .select(F.col("o_orderdate").cast("date").alias("date"), "region_key", F.col("customer_region").alias("region"))
        .distinct()
        .select(
            "date",
            "region",
            (85.0 + ((doy * 37 + region_no * 11) % 50) * 0.5).alias("construction_index"),
            (((doy * 13 + region_no * 7) % 80) / 10.0).alias("precipitation_mm"),
            (((doy * 17 + region_no * 5) % 350) / 10.0 - 5.0).alias("avg_temp_c"),
        )
    )


@dataset
def bronze_inventory_positions_raw(bronze_erp_orders_raw: DataFrame) -> DataFrame:
    """Bronze: month-start stock of every SKU at every plant and DC that moved it.

    Each shipped line feeds its plant and its DC; partial sums shrink the rows before the shuffle. Plants and DCs are
    summed up by different tasks, so that a task holds the sums of one side only.
    """
    nowhere = F.lit(None).cast("string")
    month = F.month("snapshot_date")
    sku_no = F.substring("sku_id", 4, 20).cast("bigint")
    safety = rules.safety_stock("sku_family")
    month_start = month_of("actual_ship_date").alias("snapshot_date")
    shipped = rules.shippable(bronze_erp_orders_raw)
    rest = ("sku_id", "sku_family", "units_ordered", "units_shipped")
    at_plants = shipped.select(month_start, "plant_id", nowhere.alias("dc_id"), *rest)
    at_dcs = shipped.select(month_start, nowhere.alias("plant_id"), "dc_id", *rest)
    moved = (
        at_plants.unionByName(at_dcs)
        .groupBy("snapshot_date", "plant_id", "dc_id", "sku_id", "sku_family")
        .agg(
            F.sum("units_shipped").alias("shipped"),
            F.sum(F.col("units_ordered") - F.col("units_shipped")).alias("owed"),
        )
    )
    return (
        moved.withColumns(
            {
                "on_hand_units": F.col("shipped") * 2 + (sku_no * 31 + month * 5) % 300,
                "on_order_units": F.col("owed") + (sku_no + month) % 120,
                "safety_stock_units": safety,
            }
        )
        .withColumn("days_of_supply", rules.days_of_supply("on_hand_units", "safety_stock_units"))
        .drop("shipped", "owed", "sku_family")
    )
