"""Every dataset and query by public name, ready to run against a source directory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.operators.ridge import NAIVE
from haulcast.workspace import Workspace

TABLES = """
bronze_erp_orders_raw bronze_tms_shipments_raw bronze_production_output_raw bronze_inventory_positions_raw
bronze_external_signals_raw bronze_plant_locations bronze_dc_locations
silver_erp_orders silver_tms_shipments silver_inventory_positions silver_production_output
silver_external_signals silver_plant_locations silver_dc_locations
weekly_demand_actual kpi_otif_weekly kpi_freight_weekly kpi_premium_freight_weekly kpi_energy_intensity_weekly
control_tower_weekly lane_weekly weekly_sku_demand
sku_dim customer_dim primary_dc_by_region calendar_spine calendar_features
forecast_training_set series_features backtest_split future_weeks dense_week_grid
naive_ma4_backtest naive_ma4_future demand_forecast_all demand_forecast demand_forecast_future
kpi_mape_weekly mape_by_series mape_global mape_naive_by_series kpi_mape_sku_weekly demand_vs_forecast_weekly
late_risk_features late_risk_heuristic late_risk_heuristic_metrics order_late_risk_scored_ml late_risk_metrics
late_risk_gradient freight_lanes
""".split()

QUERY_NAMES = """
plant_locations dc_locations facility_labels conformed_locations plants_by_region family_counts channel_counts
assign_plant promise_dates shipment_costing order_enrichment inventory_days_of_supply inventory_position_summary
expect_or_drop_orders ensure_numeric table_row_counts last_signal
control_tower_snapshot control_tower_recent control_tower_freight otif_trend_region kpi_snapshot_latest
otif_region_weeks worst_dcs_13w lane_recent worst_lanes_13w costliest_lanes lane_cost_scaled network_summary
top_lanes_by_cost co2_by_month co2_by_mode_13w transport_mode_comparison co2_weekly_region_mode
energy_recent energy_13w
order_volume_kpis service_performance_kpis product_family_mix orders_by_channel
planner_actual_slice backorders_weekly
mape_by_sku mape_sku_summary
late_label late_class_balance train_test_split_counts
mv_exec_13w mv_otif_region_13w mv_worst_dcs mv_premium_lanes mv_freight_lanes mv_otif_now otif_trend_slope_13w
ridge_future
""".split()

# Fed by the forecast tables: run once on the ridge model, once on the four-week mean.
FORECAST_FED = """
planner_backtest_slice planner_future_slice planner_kpis top_mape_problems demand_vs_forecast_recent
demand_vs_forecast_series demand_outlook demand_long series_plot_data forecast_next_month
actual_vs_forecast_month ape_rows mape_by_family_region mape_family_summary mape_severity mape_pivot mape_baseline
mv_mape_worst mv_mape_region
""".split()
FORECAST_TABLES = ("kpi_mape_weekly", "mape_by_series", "mape_global", "demand_vs_forecast_weekly")

# Fed by scored orders: run once on the logistic model, once on the rule-based score.
RISK_FED = """
recent_scored_orders late_risk_top_orders late_risk_this_week high_risk_orders late_risk_hotspots_weekly risk_hotspots risk_summary
risk_histogram mv_late_risk_by_region
""".split()

# Registered runs that show one region or one series; without options these queries return all of them.
REGION = {"region": "ASIA"}
ONE_SERIES = {**REGION, "sku_family": "pipe"}
SLICES = {
    **dict.fromkeys(("otif_region_weeks", "worst_dcs_13w"), REGION),
    **dict.fromkeys(("planner_actual_slice", "backorders_weekly", "planner_backtest_slice", "planner_future_slice"), ONE_SERIES),
    **dict.fromkeys(("planner_kpis", "demand_vs_forecast_series", "series_plot_data"), ONE_SERIES),
}

# The same query or dataset under other options.
OPTIONS = {
    "mape_by_sku_family": ("mape_by_sku", {"sku_family": "pipe"}),
    "top_5_freight_lanes": ("mv_freight_lanes", {"count": 5}),
    "top_3_lanes": ("costliest_lanes", {"count": 3, "label_width": 40}),
    "ridge_backtest": ("demand_forecast", {}),
    "order_late_risk_scored": ("order_late_risk_scored_ml", {}),
}
NAIVE_OPTIONS = {"planner_kpis": {"model": NAIVE}, "demand_outlook": {"model": NAIVE}}
# The rule-based score rarely reaches one half, so its lists use a lower threshold.
HEURISTIC_OPTIONS = {
    "high_risk_orders": {"threshold": 0.25},
    "risk_summary": {"threshold": 0.25},
    "late_risk_top_orders": {"above": 0.25},
}


def on_naive(ws: Workspace) -> Workspace:
    """The workspace with the four-week mean in place of every forecast table."""
    past = ws["naive_ma4_backtest"]
    future = ws["naive_ma4_future"].withColumn("model_name", F.lit(NAIVE))
    both = past.select("*", F.lit(NAIVE).alias("model_name"), F.lit(1.0).alias("is_backtest")).unionByName(
        future.select("*", F.lit(0.0).alias("is_backtest"))
    )
    return ws.with_tables(demand_forecast=past, demand_forecast_future=future, demand_forecast_all=both)


def on_heuristic(ws: Workspace) -> Workspace:
    """The workspace with the rule-based score in place of the model's."""
    return ws.with_tables(order_late_risk_scored_ml=ws["late_risk_heuristic"])


@dataclass(frozen=True)
class Run:
    name: str
    options: tuple = ()
    variant: Callable[[Workspace], Workspace] | None = None
    config: tuple = ()

    def __call__(self, ws: Workspace) -> DataFrame:
        if self.config:
            ws = ws.with_config(**dict(self.config))
        if self.variant is not None:
            ws = self.variant(ws)
        return ws.run(self.name, **dict(self.options))


def runs() -> dict[str, Run]:
    names = (*TABLES, *QUERY_NAMES, *FORECAST_FED, *RISK_FED)
    out = {name: Run(name, tuple(SLICES.get(name, {}).items())) for name in names}
    for alias, (name, options) in OPTIONS.items():
        out[alias] = Run(name, tuple(options.items()))
    for name in (*FORECAST_FED, *FORECAST_TABLES):
        out[f"{name}_naive"] = Run(name, tuple((SLICES.get(name, {}) | NAIVE_OPTIONS.get(name, {})).items()), on_naive)
    for name in RISK_FED:
        out[f"{name}_heuristic"] = Run(name, tuple(HEURISTIC_OPTIONS.get(name, {}).items()), on_heuristic)
    simple = (("recipe", "simple"), ("backtest_weeks", 26))
    out["naive_ma4_backtest_simple"] = Run("naive_ma4_backtest", config=simple)
    out["demand_forecast_all_simple"] = Run("demand_forecast_all", config=simple)
    return out


# Written to the shared folder when first read, and read from there by every query of the application.
# Bronze order lines are the one wide join everything starts from: written once, all later work on them
# is a scan of the columns it needs. The rest are weekly Gold tables, forecasts and scores, small next to
# the orders they sum up and each read by many queries.
# Order lines are laid out by order date, so a trailing window reads the row groups of its days only.
PUBLISHED = {
    "bronze_erp_orders_raw": ("order_date",),
    **dict.fromkeys(
        (
            "bronze_external_signals_raw",
            "silver_external_signals",
            "weekly_sku_demand",
            "weekly_demand_actual",
            "kpi_otif_weekly",
            "kpi_freight_weekly",
            "kpi_energy_intensity_weekly",
            "control_tower_weekly",
            "ridge_coefficients",
            "demand_forecast_all",
            "kpi_mape_sku_weekly",
            "order_late_risk_scored_ml",
        ),
        (),
    ),
}

_workspaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, source_dir: str) -> Workspace:
    """One workspace per application and source, so a model is fitted once for all its queries."""
    key = (spark.sparkContext.applicationId, source_dir)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, source_dir, published=PUBLISHED)
    return _workspaces[key]


def run(name: str, spark: SparkSession, source_dir: str) -> DataFrame:
    return runs()[name](workspace(spark, source_dir))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in runs()}
