"""Business rules of the order-to-delivery chain, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.expressions import padded
from haulcast.workspace import dataset

# Tons per unit and safety stock (units) by product family.
TONS_PER_UNIT = {"pipe": 0.06, "chambers": 0.18, "structures": 0.32}
SAFETY_STOCK = {"pipe": 200, "chambers": 80, "structures": 45}

# Freight cost = (base + per km + per ton) x carrier premium.
FREIGHT_BASE_USD = 180.0
FREIGHT_USD_PER_KM = 1.10
FREIGHT_USD_PER_TON = 42.0
CARRIER_PREMIUM = 1.18

# Kg CO2 per ton-km by transport mode.
CO2_OWN_FLEET = 0.095
CO2_CARRIER = 0.105

# Promised lead days by channel; every other channel gets the default.
LEAD_DAYS = {"DOT": 10, "contractor": 6, "ag": 7}
LEAD_DAYS_DEFAULT = 5

# List price = base + (number modulo span) x step, by product family.
PRICE_RULE = {"pipe": (75.0, 50, 1.2), "chambers": (240.0, 40, 2.5), "structures": (520.0, 30, 4.0)}


def _by_family(family: Column | str, values: dict) -> Column:
    """Value of the family, the last entry serving every other family."""
    family = F.col(family) if isinstance(family, str) else family
    *known, (_, fallback) = values.items()
    (first, value), *rest = known
    out = F.when(family == first, value)
    for name, value in rest:
        out = out.when(family == name, value)
    return out.otherwise(fallback)


def not_cancelled(orders: DataFrame) -> DataFrame:
    """Lines that still count; a null status is dropped as well."""
    return orders.filter(F.col("order_status") != "cancelled")


def shippable(orders: DataFrame) -> DataFrame:
    return not_cancelled(orders).filter(F.col("actual_ship_date").isNotNull())


def shipment_tons(units: str, family: str) -> Column:
    return F.col(units) * _by_family(family, TONS_PER_UNIT)


def freight_cost(km: str, tons: str, mode: str) -> Column:
    direct = FREIGHT_BASE_USD + F.col(km) * FREIGHT_USD_PER_KM + F.col(tons) * FREIGHT_USD_PER_TON
    return direct * F.when(F.col(mode) == "carrier", CARRIER_PREMIUM).otherwise(1.0)


def co2_kg(km: str, tons: str, mode: str) -> Column:
    return F.col(km) * F.col(tons) * F.when(F.col(mode) == "own_fleet", CO2_OWN_FLEET).otherwise(CO2_CARRIER)


def safety_stock(family: str) -> Column:
    return _by_family(family, SAFETY_STOCK)


def days_of_supply(on_hand: str, safety: str) -> Column:
    return F.round(F.col(on_hand) / F.greatest(F.lit(1.0), F.col(safety) / 20.0)).cast("bigint")


def lead_days(channel: str) -> Column:
    out = F
    for name, days in LEAD_DAYS.items():
        out = out.when(F.col(channel) == name, days)
    return out.otherwise(LEAD_DAYS_DEFAULT)


@dataset
def sku_dim(bronze_erp_orders_raw: DataFrame) -> DataFrame:
    """SKU dimension of the SKUs ordered: family and list price by rule from the SKU number."""
    number = F.col("number")
    last_digit = number % 10
    price = {family: base + number % span * step for family, (base, span, step) in PRICE_RULE.items()}
    family = F.when(last_digit < 6, "pipe").when(last_digit < 8, "chambers").otherwise("structures")
    skus = bronze_erp_orders_raw.select("sku_id").distinct()
    skus = skus.withColumn("number", F.substring("sku_id", 4, 20).cast("bigint"))
    return skus.withColumn("sku_family", family).select(
        "sku_id",
        "sku_family",
        _by_family("sku_family", price).alias("unit_price"),
    )


@dataset
def regions_in_order(bronze_plant_locations: DataFrame) -> DataFrame:
    """One row: the regions that have a plant, by name."""
    return bronze_plant_locations.agg(F.array_sort(F.collect_set("plant_region")).alias("region_names"))


@dataset
def customer_dim(bronze_erp_orders_raw: DataFrame, regions_in_order: DataFrame) -> DataFrame:
    """Customer dimension of the customers that ordered: region in turn and channel by rule from the customer number."""
    number = F.col("number")
    names = regions_in_order.scalar()
    last_digit = number % 10
    channel = (
        F.when(last_digit < 5, "distributor").when(last_digit < 8, "contractor").when(last_digit < 9, "DOT").otherwise("ag")
    )
    people = bronze_erp_orders_raw.select("customer_id").distinct()
    people = people.withColumn("number", F.substring("customer_id", 2, 20).cast("bigint"))
    return people.withColumn("names", names).select(
        "customer_id",
        F.element_at("names", (number % F.size("names")).cast("int") + 1).alias("customer_region"),
        channel.alias("channel"),
    )


@dataset
def primary_dc_by_region(bronze_dc_locations: DataFrame) -> DataFrame:
    """First DC of every region."""
    return bronze_dc_locations.groupBy(F.col("dc_region").alias("region")).agg(F.min("dc_id").alias("primary_dc_id"))


@dataset
def plants_by_region(bronze_plant_locations: DataFrame) -> DataFrame:
    """Sorted plant list of every region (a reference table of a few rows per region)."""
    plants = F.array_sort(F.collect_list("plant_id"))
    return bronze_plant_locations.groupBy(F.col("plant_region").alias("region")).agg(plants.alias("plants_in_region"))
