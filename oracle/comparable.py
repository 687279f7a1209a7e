"""Results as two engines can compare them: doubles rounded where they come from sums or from solvers."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulcast import catalog
from haulcast.functions.expressions import shown
from haulcast.operators.silver import SIGNALS
from oracle import DIGITS, UNIT_DIGITS, UNITS

# Row-wise results: no sums in them, so their doubles are the same on every engine and stay as they are.
ROW_WISE = frozenset(
    """
    bronze_erp_orders_raw bronze_tms_shipments_raw bronze_production_output_raw bronze_inventory_positions_raw
    bronze_external_signals_raw bronze_plant_locations bronze_dc_locations silver_erp_orders silver_tms_shipments
    silver_inventory_positions silver_production_output silver_plant_locations silver_dc_locations
    plant_locations dc_locations shipment_costing sku_dim ensure_numeric late_risk_heuristic
    """.split()
)

# Row-wise but for a few columns: means of signals, and a sine that engines compute in their own way.
ROUNDED_COLUMNS = {"order_enrichment": ("season_annual",), "late_risk_features": SIGNALS}

# Read the ridge model's forecast.
RIDGE_FED = frozenset(
    (
        *catalog.FORECAST_FED, *catalog.FORECAST_TABLES, "demand_forecast_all", "demand_forecast_all_simple", "demand_forecast",
        "ridge_backtest", "demand_forecast_future", "ridge_future",
    )
)


# Columns that compare to fewer digits: forecast units of a fitted model, and slopes that a solver leaves near zero.
COARSE = {**dict.fromkeys(RIDGE_FED, UNITS), "late_risk_gradient": ("gradient",)}


def rounded(frame: DataFrame, columns: Collection[str] | None = None, coarse: Collection[str] = ()) -> DataFrame:
    """Doubles (all, or the named ones) rounded, those of ``coarse`` to fewer digits."""
    doubles = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.DoubleType)]
    chosen = set(doubles if columns is None else columns)
    digits = {c: UNIT_DIGITS if c in coarse else DIGITS for c in chosen}
    return frame.select(
        *(shown(F.col(f"`{c}`"), digits[c]).alias(c) if c in chosen else F.col(f"`{c}`") for c in frame.columns)
    )


def comparable(name: str, frame: DataFrame) -> DataFrame:
    """The result of a registered query as its SQL gives it."""
    return frame if name in ROW_WISE else rounded(frame, ROUNDED_COLUMNS.get(name), COARSE.get(name, ()))
