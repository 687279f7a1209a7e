"""Time the headline queries once each, cold, into a no-op sink; prints one JSON line.

With --warm each query runs three more times and the median is reported next to the cold time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from haulcast import catalog
from haulcast.session import local_session

HEADLINE = """
silver_erp_orders silver_tms_shipments silver_inventory_positions weekly_demand_actual kpi_otif_weekly
kpi_freight_weekly kpi_energy_intensity_weekly control_tower_weekly control_tower_snapshot freight_lanes
worst_lanes_13w order_volume_kpis service_performance_kpis transport_mode_comparison product_family_mix
order_enrichment inventory_position_summary series_features naive_ma4_backtest demand_forecast_all
kpi_mape_weekly planner_kpis kpi_mape_sku_weekly mape_by_sku mv_exec_13w late_risk_features
late_risk_heuristic order_late_risk_scored_ml risk_summary
""".split()


def timed(name: str, spark, source: str) -> float:
    start = time.perf_counter()
    catalog.run(name, spark, source).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main(warm: bool) -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {name: timed(name, spark, source) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    result = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": source.rsplit("sf", 1)[-1]}
    if warm:
        result["warm"] = {name: median(timed(name, spark, source) for _ in range(3)) for name in HEADLINE}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main("--warm" in sys.argv[1:])
