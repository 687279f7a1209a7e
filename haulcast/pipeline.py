"""The medallion tables as a Spark Declarative Pipeline.

A pipeline definition file calls ``declare()``; each dataset becomes a materialized view that
reads its inputs by table name, which is how Spark finds the order to refresh them in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from haulcast import workspace
from haulcast.workspace import DATASETS, Node

MEDALLION = (
    "silver_erp_orders",
    "silver_tms_shipments",
    "silver_inventory_positions",
    "silver_production_output",
    "silver_external_signals",
    "silver_plant_locations",
    "silver_dc_locations",
    "weekly_demand_actual",
    "kpi_otif_weekly",
    "kpi_freight_weekly",
    "kpi_premium_freight_weekly",
    "kpi_energy_intensity_weekly",
    "control_tower_weekly",
)


def _reader(node: Node) -> Callable[[], DataFrame]:
    def build() -> DataFrame:
        spark = SparkSession.active()
        return node.build(*(spark.table(name) for name in node.inputs))

    build.__name__ = node.name
    return build


def declare(names: Iterable[str] = MEDALLION) -> None:
    """Register the tables with the pipeline being defined."""
    from pyspark import pipelines

    workspace._load_definitions()
    for name in names:
        node = DATASETS[name]
        pipelines.materialized_view(_reader(node), name=name, comment=node.comment.split("\n")[0])
