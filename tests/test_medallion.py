"""Hand-made order lines and shipments through Silver and Gold."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulcast import Workspace
from haulcast.pipeline import MEDALLION, declare
from haulcast.schemas import BRONZE
from haulcast.workspace import DATASETS

MON = date(2001, 7, 2)


def line(order="O1", requested=date(2001, 7, 10), shipped=date(2001, 7, 3), delivered=date(2001, 7, 5), ordered=10,
         sent=10, status="closed", region="ASIA", dc="DC01", plant="PL01", family="pipe", day=MON, sku="SKU00001"):
    return (order, day, requested, shipped, delivered, "C1", region, "ag", plant, dc, sku, family, ordered, sent, 5.0, status)


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), BRONZE["bronze_erp_orders_raw"])


def trip(tons=1.0, cost=100.0, co2=10.0, mode="own_fleet", dc="DC01", plant="PL01", day=date(2001, 7, 3), order="O1"):
    return ("S1", order, plant, dc, "T1", 100.0, mode, day, day, tons, cost, co2)


def trips(spark, *rows):
    return spark.createDataFrame(list(rows), BRONZE["bronze_tms_shipments_raw"])


def made(spark, *rows):
    return spark.createDataFrame(list(rows), BRONZE["bronze_production_output_raw"])


def test_flags(spark):
    raw = orders(spark, line(), line("O2", delivered=None, shipped=None), line("O3", requested=None),
                 line("O4", sent=4, status="backorder"), line("O5", status="cancelled", sent=0, delivered=None))
    rows = {r.order_id: r for r in Workspace(spark, tables={"bronze_erp_orders_raw": raw})["silver_erp_orders"].collect()}
    assert (rows["O1"].is_on_time, rows["O1"].is_in_full, rows["O1"].is_otif, rows["O1"].order_week) == (True, True, True, MON)
    assert rows["O2"].is_on_time is False
    assert rows["O3"].is_on_time is None
    assert (rows["O4"].is_backorder, rows["O4"].is_in_full, rows["O4"].is_otif) == (True, False, False)
    assert (rows["O5"].is_cancelled, rows["O5"].is_otif) == (True, False)


def test_expectation_drops_negative_and_null(spark):
    raw = orders(spark, line(), line("O2", sent=-1), line("O3", sent=None))
    ws = Workspace(spark, tables={"bronze_erp_orders_raw": raw})
    assert [r.order_id for r in ws["silver_erp_orders"].collect()] == ["O1"]
    assert ws.run("expect_or_drop_orders").first().asDict() == {"rule": "nonnegative_shipped", "kept": 1, "dropped": 2}


def test_otif_one_line_on_time_is_enough_but_all_must_be_full(spark):
    late = date(2001, 7, 20)
    raw = orders(spark, line("A"), line("A", delivered=late), line("B", delivered=late), line("C"), line("C", sent=9),
                 line("D", status="cancelled", sent=0), line("E", requested=None))
    otif = Workspace(spark, tables={"bronze_erp_orders_raw": raw})["kpi_otif_weekly"].collect()
    assert len(otif) == 1
    assert otif[0].orders == 4  # D is cancelled
    assert otif[0].otif_rate == otif[0].perfect_order_rate_proxy == 0.25  # only A


def test_all_lines_cancelled_leaves_no_rows(spark):
    raw = orders(spark, line(status="cancelled", sent=0))
    ws = Workspace(spark, tables={"bronze_erp_orders_raw": raw})
    assert ws["kpi_otif_weekly"].count() == ws["weekly_demand_actual"].count() == 0


def test_freight_zero_and_null_denominators(spark):
    raw = trips(spark, trip(tons=0.0), trip(dc="DC02", tons=None), trip(dc="DC03", cost=0.0), trip(dc="DC04", mode="carrier", cost=30.0), trip(dc="DC04", cost=70.0))
    ws = Workspace(spark, tables={"bronze_tms_shipments_raw": raw})
    cost = {(r.dc_id, r.mode): r.freight_cost_per_ton for r in ws["kpi_freight_weekly"].collect()}
    assert cost[("DC01", "own_fleet")] is None and cost[("DC02", "own_fleet")] is None
    share = {r.dc_id: r.premium_freight_pct for r in ws["kpi_premium_freight_weekly"].collect()}
    assert share["DC01"] == 0.0 and share["DC03"] is None and share["DC04"] == pytest.approx(0.3)
    floored = {r.dc_id: r.freight_cost_per_ton for r in ws["lane_weekly"].collect()}
    assert floored["DC01"] == pytest.approx(100.0 / 0.0001)


def test_control_tower_fans_out_over_regions_and_families(spark):
    raw = orders(spark, line("A"), line("B", region="EUROPE"))
    ws = Workspace(spark, tables={
        "bronze_erp_orders_raw": raw,
        "bronze_tms_shipments_raw": trips(spark, trip(), trip(plant="PL09")),
        "bronze_production_output_raw": made(spark, *((MON, "PL01", f, 10, 20.0) for f in ("pipe", "chambers", "structures"))),
    })
    rows = ws["control_tower_weekly"].collect()
    assert len(rows) == 2 * 3 + 2  # PL01: regions x families; PL09 made nothing: regions only
    assert {r.sku_family for r in rows if r.plant_id == "PL09"} == {None}
    assert {r.energy_kwh_per_unit for r in rows if r.plant_id == "PL01"} == {2.0}


def test_bronze_adapters_have_the_declared_types(small):
    for name, schema in BRONZE.items():
        assert {(f.name, f.dataType.simpleString()) for f in small[name].schema} == {
            (f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)
        }, name


def test_invariants(small):
    ship, freight = small["silver_tms_shipments"], small["kpi_freight_weekly"]
    total = lambda f: f.groupBy().sum("freight_cost_usd").first()[0]
    assert total(ship) == pytest.approx(total(freight), rel=1e-12)
    assert small["kpi_otif_weekly"].filter("otif_rate NOT BETWEEN 0 AND 1").count() == 0
    assert small["kpi_premium_freight_weekly"].filter("premium_freight_pct NOT BETWEEN 0 AND 1").count() == 0
    mix = small.run("product_family_mix").groupBy().sum("pct_of_total").first()[0]
    assert mix == pytest.approx(100.0, abs=0.15)


def test_one_hot_part_and_customer_do_not_change_results(spark, small):
    """A third of all lines on one part and a third of all orders from one customer, all joins shuffled."""
    lines = small["lineitem"].selectExpr("* except (l_partkey)", "if(l_orderkey % 3 = 0, 1, l_partkey) AS l_partkey")
    heads = small["orders"].selectExpr("* except (o_custkey)", "if(o_orderkey % 3 = 1, 1, o_custkey) AS o_custkey")
    skewed = small.with_tables(lineitem=lines, orders=heads)
    plain = sorted(skewed["weekly_demand_actual"].collect())
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = small.with_tables(lineitem=lines.repartition(6), orders=heads.repartition(6))["weekly_demand_actual"]
        assert sorted(frame.collect()) == plain
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_declared_pipeline_lists_every_medallion_table(spark, small):
    from pyspark.pipelines.graph_element_registry import GraphElementRegistry, graph_element_registration_context

    class Seen(GraphElementRegistry):
        def __init__(self):
            self.outputs, self.flows = [], []

        def register_output(self, output):
            self.outputs.append(output)

        def register_flow(self, flow):
            self.flows.append(flow)

        def register_sql(self, sql_text, file_path):
            raise AssertionError("no SQL files")

    seen = Seen()
    with graph_element_registration_context(seen):
        declare()
    assert [o.name for o in seen.outputs] == list(MEDALLION)
    assert all(o.comment.startswith(("Silver:", "Gold:")) for o in seen.outputs)
    for name in DATASETS["kpi_otif_weekly"].inputs:
        small[name].createOrReplaceTempView(name)
    flow = next(f for f in seen.flows if f.name == "kpi_otif_weekly")
    assert flow.func().schema == small["kpi_otif_weekly"].schema


def test_stock_of_plants_and_dcs_is_summed_up_apart(spark):
    lines = orders(spark, line("O1"), line("O2")).withColumn("plant_id", F.lit(None).cast("string"))
    lines = lines.withColumn("sku_id", F.lit("SKU00017"))
    stock = Workspace(spark, tables={"bronze_erp_orders_raw": lines})["bronze_inventory_positions_raw"]
    assert "Generate" not in stock._jdf.queryExecution().executedPlan().toString()
    assert [r.plant_id for r in stock.collect()] == [None, None] and stock.where("dc_id is null").count() == 1
