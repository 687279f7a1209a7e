"""Views of the catalog over the written tables: error and outlook of the demand forecast, as SQL text with dependencies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from haulcast.schemas import FORECAST
from haulcast.sources.sinks import create_view
from haulcast.workspace import Status

# |a - f| / a; with zero demand 0 if the forecast is zero too, else 1.
_ERROR = """CASE WHEN a.actual_units = 0 THEN CASE WHEN f.forecast_units = 0 THEN 0.0 WHEN f.forecast_units <> 0 THEN 1.0 END
            ELSE try_divide(CAST(abs(a.actual_units - f.forecast_units) AS DOUBLE), CAST(a.actual_units AS DOUBLE)) END"""


@dataclass(frozen=True)
class View:
    """SQL over ``{schema}``; ``needs`` must exist, and an absent table of ``optional`` is made empty with its columns."""

    name: str
    sql: str
    comment: str
    needs: Sequence[str]
    optional: dict[str, str] = field(default_factory=dict)


VIEWS = (
    View(
        name="kpi_mape_weekly",
        comment="Error of the chosen forecast by week, family and region",
        needs=("weekly_demand_actual",),
        optional={"demand_forecast": FORECAST},
        sql=f"""
        SELECT week, sku_family, region, avg({_ERROR}) AS mape
        FROM {{schema}}.weekly_demand_actual a JOIN {{schema}}.demand_forecast f USING (week, sku_family, region)
        GROUP BY week, sku_family, region""",
    ),
    View(
        name="demand_vs_forecast_weekly",
        comment="Actuals with their backtest forecast, and a future forecast where one overlaps",
        needs=("weekly_demand_actual", "demand_forecast_future"),
        optional={"demand_forecast": FORECAST},
        sql="""
        SELECT week, sku_family, region, a.actual_units, f.forecast_units, u.forecast_units AS forecast_units_future
        FROM {schema}.weekly_demand_actual a
        LEFT JOIN {schema}.demand_forecast f USING (week, sku_family, region)
        LEFT JOIN {schema}.demand_forecast_future u USING (week, sku_family, region)""",
    ),
)


def refresh_views(spark: SparkSession, schema: str, views: Sequence[View] = VIEWS) -> list[Status]:
    """Make every view whose tables exist anew; one whose tables are absent is skipped and reported with them."""
    statuses = []
    for view in views:
        lacking = tuple(n for n in view.needs if not spark.catalog.tableExists(f"{schema}.{n}"))
        if lacking:
            statuses.append(Status(view.name, "skipped", lacking))
            continue
        for name, columns in view.optional.items():
            if not spark.catalog.tableExists(f"{schema}.{name}"):
                spark.sql(f"CREATE TABLE {schema}.{name} ({columns}) USING parquet")
        create_view(spark, f"{schema}.{view.name}", view.sql.format(schema=schema), view.comment)
        statuses.append(Status(view.name, "written"))
    return statuses
