"""Semantic layer: named dimensions and measures over a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetricView:
    """Measures are aggregates over source columns, evaluated at the grain a query asks for."""

    name: str
    source: str
    dimensions: Mapping[str, str]
    measures: Mapping[str, str]
    comment: str = ""

    def query(
        self,
        source: DataFrame,
        measures: Sequence[str],
        by: Sequence[str] = (),
        where: Column | str | None = None,
        order_by: Sequence[Column] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """Chosen measures at the grain of ``by``; with no dimension, one row.

        ``where`` and ``by`` name dimensions. There is no "all columns" form: a measure has no
        value until a grain is chosen.
        """
        self._check(by, self.dimensions, "dimension")
        self._check(measures, self.measures, "measure")
        if not measures:
            raise ValueError(f"{self.name}: name at least one measure")
        derived = {d: F.expr(e) for d, e in self.dimensions.items() if e != d}
        rows = source.withColumns(derived) if derived else source
        if where is not None:
            self._check_filter(rows, where)
            rows = rows.filter(where)
        result = rows.groupBy(*by).agg(*(F.expr(self.measures[m]).alias(m) for m in measures))
        if order_by:
            result = result.orderBy(*order_by)
        return result if limit is None else result.limit(limit)

    def _check_filter(self, rows: DataFrame, where: Column | str) -> None:
        """The condition must resolve on the dimensions alone."""
        alone = rows.sparkSession.createDataFrame([], rows.select(*self.dimensions).schema)
        try:
            alone.filter(where).schema  # noqa: B018  resolution is the check
        except AnalysisException as error:
            raise ValueError(f"{self.name}: the filter must name dimensions, of {sorted(self.dimensions)}: {error}") from error

    def _check(self, asked: Sequence[str], known: Mapping[str, str], kind: str) -> None:
        unknown = [a for a in asked if a not in known]
        if unknown:
            raise ValueError(f"{self.name} has no {kind} {', '.join(map(repr, unknown))}; it has {sorted(known)}")


def _plain(*names: str) -> dict[str, str]:
    return {n: n for n in names}


CONTROL_TOWER = MetricView(
    name="mv_control_tower_kpis",
    source="control_tower_weekly",
    comment="Service, cost and sustainability KPIs; plain means of control-tower rows.",
    dimensions=_plain("week", "region", "plant_id", "dc_id", "sku_family"),
    measures={
        "OTIF": "avg(otif_rate)",
        "Freight $/ton": "avg(freight_cost_per_ton)",
        "Premium freight %": "avg(premium_freight_pct)",
        "CO2 kg/ton": "avg(co2_kg_per_ton)",
        "Energy kWh/unit": "avg(energy_kwh_per_unit)",
    },
)

FORECAST_ACCURACY = MetricView(
    name="mv_forecast_accuracy",
    source="kpi_mape_weekly",
    comment="Error of the chosen forecast.",
    dimensions=_plain("week", "sku_family", "region"),
    measures={"MAPE": "avg(mape)"},
)

LATE_RISK = MetricView(
    name="mv_late_delivery_risk",
    source="order_late_risk_scored_ml",
    comment="Predicted and observed lateness of scored orders.",
    dimensions={
        **_plain("order_date", "customer_region", "channel", "plant_id", "dc_id", "sku_family"),
        "order_week": "cast(date_trunc('week', order_date) as date)",
    },
    measures={
        "Avg late-risk prob": "avg(late_risk_prob)",
        "Observed late rate": "avg(actual_late)",
        "Orders scored": "count(1)",
    },
)

VIEWS = {v.name: v for v in (CONTROL_TOWER, FORECAST_ACCURACY, LATE_RISK)}
