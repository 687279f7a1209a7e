"""Declared column types (DDL) of the Bronze inputs and the fixed-schema outputs, and what may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRONZE = {
    "bronze_erp_orders_raw": (
        "order_id string, order_date date, requested_delivery_date date, actual_ship_date date, "
        "actual_delivery_date date, customer_id string, customer_region string, channel string, "
        "plant_id string, dc_id string, sku_id string, sku_family string, units_ordered int, "
        "units_shipped int, unit_price double, order_status string"
    ),
    "bronze_tms_shipments_raw": (
        "shipment_id string, order_id string, plant_id string, dc_id string, truck_id string, "
        "route_distance_km double, mode string, ship_date date, delivery_date date, "
        "total_weight_tons double, freight_cost_usd double, co2_kg double"
    ),
    "bronze_production_output_raw": "date date, plant_id string, sku_family string, units_produced bigint, energy_kwh double",
    "bronze_inventory_positions_raw": (
        "snapshot_date date, plant_id string, dc_id string, sku_id string, on_hand_units bigint, "
        "on_order_units bigint, safety_stock_units int, days_of_supply bigint"
    ),
    "bronze_external_signals_raw": "date date, region string, construction_index double, precipitation_mm double, avg_temp_c double",
    "bronze_plant_locations": (
        "plant_id string, plant_name string, plant_city string, plant_state string, "
        "plant_lat double, plant_lon double, plant_region string"
    ),
    "bronze_dc_locations": (
        "dc_id string, dc_name string, dc_city string, dc_state string, "
        "dc_lat double, dc_lon double, dc_region string"
    ),
}

FORECAST_ALL = (
    "week date not null, sku_family string not null, region string not null, forecast_units double not null, "
    "lower_ci double not null, upper_ci double not null, model_name string not null, is_backtest double not null"
)

# The forecast table as a typed placeholder before the first forecast run.
FORECAST = (
    "week date, sku_family string, region string, forecast_units double, lower_ci double, upper_ci double"
)

SCORED_ORDERS = (
    "order_id string, order_date date, customer_region string, channel string, dc_id string, plant_id string, "
    "sku_family string, units_ordered int, days_to_request double, late_risk_prob double, "
    "late_risk_flag int, actual_late int"
)

_SIGNALS = {"construction_index": ("double", 0.0), "precipitation_mm": ("double", 0.0), "avg_temp_c": ("double", 0.0)}

# Columns that a given table may lack, with their types and what stands for them.
OPTIONAL_COLUMNS = {
    "bronze_erp_orders_raw": {
        "requested_delivery_date": ("date", None),
        "actual_ship_date": ("date", None),
        "customer_id": ("string", None),
        "customer_region": ("string", "unknown"),
        "channel": ("string", "unknown"),
        "plant_id": ("string", "unknown"),
        "dc_id": ("string", "unknown"),
        "sku_id": ("string", "unknown"),
        "sku_family": ("string", "unknown"),
        "unit_price": ("double", 0.0),
        "order_status": ("string", "closed"),
    },
    "bronze_external_signals_raw": {"region": ("string", "unknown"), **_SIGNALS},
    "forecast_training_set": {"sku_family": ("string", "unknown"), "region": ("string", "unknown"), **_SIGNALS},
    "weekly_demand_actual": {"sku_family": ("string", "unknown"), "region": ("string", "unknown")},
}

# Tables that may be absent altogether: an empty table of these columns stands for one.
OPTIONAL_TABLES = {
    "bronze_external_signals_raw": BRONZE["bronze_external_signals_raw"],
    "sku_names": "sku_id string, sku_name string",
}


def completed(name: str, frame: DataFrame) -> DataFrame:
    """The table with the optional columns it lacks."""
    lacking = {c: v for c, v in OPTIONAL_COLUMNS.get(name, {}).items() if c not in frame.columns}
    return frame.withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in lacking.items()}) if lacking else frame
