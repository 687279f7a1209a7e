"""Workspace resolution, sinks, quality report, metric views, streaming."""

import csv
import uuid
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_medallion import line, orders

from haulcast import EngineConfig, Workspace, session
from haulcast.operators.metric_view import CONTROL_TOWER, VIEWS, MetricView
from haulcast.schemas import BRONZE, FORECAST
from haulcast.sources import quality, sinks
from haulcast.streaming import start_silver
from haulcast.workspace import DATASETS, QUERIES, Node


@pytest.fixture
def schema(spark):
    name = f"w{uuid.uuid4().hex[:8]}"
    sinks.ensure_schema(spark, name)
    sinks.ensure_schema(spark, name)
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def test_unknown_names_and_options(small):
    with pytest.raises(KeyError):
        small["no_such_table"]
    with pytest.raises(TypeError, match="nonsense"):
        small.run("worst_dcs_13w", nonsense=1)
    with pytest.raises(TypeError):
        small.run("kpi_otif_weekly", region="ASIA")


def test_cycles_are_reported(spark, monkeypatch):
    for a, b in (("ping", "pong"), ("pong", "ping")):
        monkeypatch.setitem(DATASETS, a, Node(a, lambda x: x, (b,), frozenset(), ""))
    with pytest.raises(ValueError, match="ping -> pong -> ping"):
        Workspace(spark)["ping"]


def test_every_definition_is_documented_and_resolvable():
    Workspace(None)
    for node in (*DATASETS.values(), *QUERIES.values()):
        assert node.comment, node.name
        for name in node.inputs:
            assert name in DATASETS or name in ("as_of", "config", "lineitem", "orders", "customer", "part", "nation", "region"), (node.name, name)


def test_replacing_a_table_reaches_downstream_only(small):
    before = small["kpi_otif_weekly"]
    freight = small["kpi_freight_weekly"]
    other = small.with_tables(silver_erp_orders=small["silver_erp_orders"].limit(0))
    assert other["kpi_freight_weekly"] is freight
    assert other["kpi_otif_weekly"] is not before and other["kpi_otif_weekly"].count() == 0


def test_as_of_moves_the_window(small):
    early = small.with_config(as_of=date(1998, 1, 1))
    weeks = early.run("control_tower_snapshot").agg(F.min("week")).first()[0]
    assert weeks >= date(1997, 10, 2)
    assert early.run("order_volume_kpis").first().total_orders > small.run("order_volume_kpis").first().total_orders


def test_trailing_filter_and_columns_reach_the_scan_of_a_published_table(spark, small):
    ws = Workspace(spark, small.source_dir, published=("control_tower_weekly",))
    plan = ws.run("mv_worst_dcs")._jdf.queryExecution().executedPlan().toString()
    bound = ws._newest - timedelta(days=91)
    assert f"GreaterThanOrEqual(week,{bound})" in plan
    assert "ReadSchema: struct<week:date,dc_id:string,otif_rate:double>" in plan


def test_materialize_to_tables_and_read_them_back(spark, small, schema):
    ws = Workspace(spark, small.source_dir).materialize("weekly_demand_actual", "kpi_otif_weekly", schema=schema)
    assert "HashAggregate" not in ws["weekly_demand_actual"]._jdf.queryExecution().executedPlan().toString()
    comment = spark.catalog.getTable(f"{schema}.kpi_otif_weekly").description
    assert comment.startswith("Gold:")
    spark.range(1).createOrReplaceTempView("kpi_freight_weekly")  # not part of the schema
    again = Workspace.from_schema(
        spark, schema, EngineConfig(as_of=date(2001, 8, 1)), reuse=("kpi_otif_weekly", "weekly_demand_actual")
    )
    spark.catalog.dropTempView("kpi_freight_weekly")
    assert sorted(again._fixed) == ["kpi_otif_weekly", "weekly_demand_actual"]
    assert sorted(again.run("worst_dcs_13w").collect()) == sorted(small.run("worst_dcs_13w").collect())
    fresh = Workspace(spark, small.source_dir).materialize("weekly_demand_actual", schema=schema)
    assert fresh["weekly_demand_actual"].count() == small["weekly_demand_actual"].count()


def test_from_schema_takes_the_newest_order_as_today(spark, schema):
    sinks.overwrite_table(orders(spark, line(day=date(2001, 7, 2)), line(day=date(2001, 5, 2))), f"{schema}.bronze_erp_orders_raw")
    assert Workspace.from_schema(spark, schema).run("order_volume_kpis").first().total_orders == 2
    assert Workspace.from_schema(spark, schema)._newest == date(2001, 7, 2)


def test_materialize_to_the_shared_folder(spark, small):
    ws = Workspace(spark, small.source_dir).materialize("kpi_freight_weekly")
    total = F.round(F.sum("freight_cost_usd"), 4)
    assert ws["kpi_freight_weekly"].agg(total).first() == small["kpi_freight_weekly"].agg(total).first()
    assert ws["kpi_freight_weekly"].inputFiles() != small["kpi_freight_weekly"].inputFiles()


def test_materialize_twice_to_a_path(spark, small, tmp_path):
    ws = Workspace(spark, small.source_dir)
    for _ in range(2):
        ws.materialize("kpi_freight_weekly", path=str(tmp_path))
    assert ws["kpi_freight_weekly"].count() == small["kpi_freight_weekly"].count()
    assert [p.name for p in tmp_path.iterdir()] == ["kpi_freight_weekly"]


def test_materialize_twice_to_a_table(spark, small, schema):
    ws = Workspace(spark, small.source_dir)
    for _ in range(2):
        ws.materialize("kpi_freight_weekly", schema=schema)
    assert ws["kpi_freight_weekly"].count() == small["kpi_freight_weekly"].count()


def test_a_path_may_replace_what_it_was_read_from(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_path(spark.range(5), path)
    assert sinks.overwrite_path(spark.read.parquet(path).where("id > 1"), path).count() == 3


def test_a_schema_gives_bronze_only_so_derived_tables_follow_it(spark, small, schema):
    sinks.overwrite_table(orders(spark, line()), f"{schema}.bronze_erp_orders_raw")
    Workspace.from_schema(spark, schema).materialize("weekly_demand_actual", schema=schema)
    sinks.overwrite_table(orders(spark, line(), line("O2")), f"{schema}.bronze_erp_orders_raw")
    units = lambda ws: ws["weekly_demand_actual"].agg(F.sum("actual_units")).first()[0]
    new, old = (units(Workspace.from_schema(spark, schema, reuse=r)) for r in ((), ("weekly_demand_actual",)))
    assert new == 2 * old
    with pytest.raises(KeyError):
        Workspace.from_schema(spark, schema, reuse=("kpi_otif_weekly",))


def test_live_frames_outlast_a_materialize(spark, small):
    ws = Workspace(spark, small.source_dir, published=("kpi_otif_weekly", "weekly_demand_actual"))
    live = ws["kpi_otif_weekly"], ws["weekly_demand_actual"]
    ws.materialize("weekly_demand_actual").materialize("kpi_otif_weekly")
    assert all(frame.count() for frame in live)


def test_branches_share_published_tables_until_released(spark, small):
    ws = Workspace(spark, small.source_dir, published=("weekly_demand_actual",))
    files = [ws.with_config(horizon_weeks=n)["weekly_demand_actual"].inputFiles() for n in (4, 5)]
    assert files[0] and files[0] == files[1] == ws["weekly_demand_actual"].inputFiles()
    folder = Path(ws._folder.removeprefix("file:"))
    assert folder.exists()
    ws.release()
    assert not folder.exists()


def test_replaced_orders_move_today(spark, small):
    ws = Workspace(spark, small.source_dir)
    before = ws._newest
    later = ws["orders"].withColumn("o_orderdate", F.date_add("o_orderdate", 100))
    assert ws.with_tables(orders=later)._newest == before + timedelta(days=100)


def test_no_region_means_all(small):
    assert small.run("otif_region_weeks", region=None).count() == small["kpi_otif_weekly"].count()
    assert small.run("worst_dcs_13w", region=None).count() > 0


def test_pivot_takes_its_regions_from_the_errors(spark):
    rows = [(date(2001, 1, 1), "pipe", "Midwest", 0.5)]
    errors = spark.createDataFrame(rows, "week date, sku_family string, region string, mape double")
    pivot = Workspace(spark, tables={"kpi_mape_weekly": errors}).run("mape_pivot")
    assert pivot.columns == ["sku_family", "Midwest"] and pivot.first().Midwest == 0.5


def test_published_tables_are_written_once(spark, small):
    ws = Workspace(spark, small.source_dir, published=("kpi_otif_weekly",))
    files = ws["kpi_otif_weekly"].inputFiles()
    assert files and ws["kpi_otif_weekly"].inputFiles() == files
    assert ws.with_config(horizon_weeks=5)["kpi_otif_weekly"].inputFiles() == files


def test_views_drops_and_placeholders(spark, schema):
    frame = spark.range(3)
    sinks.overwrite_table(frame, f"{schema}.t")
    spark.sql(f"CREATE OR REPLACE VIEW {schema}.v AS SELECT * FROM {schema}.t")
    assert "v" in sinks.list_views(spark, schema) and "t" not in sinks.list_views(spark, schema)
    for name in ("v", "t", "never_there"):
        sinks.drop_relation(spark, f"{schema}.{name}")
    assert not spark.catalog.tableExists(f"{schema}.t")
    empty = sinks.table_or_placeholder(spark, f"{schema}.demand_forecast", FORECAST)
    assert empty.count() == 0 and empty.columns[3:] == ["forecast_units", "lower_ci", "upper_ci"]
    assert sinks.replace_view(frame, "temp_v").count() == 3
    sinks.drop_relation(spark, "temp_v")
    assert not spark.catalog.tableExists("temp_v")


def test_overwriting_may_change_the_schema(spark, schema):
    sinks.overwrite_table(spark.range(2), f"{schema}.t", "It's one")
    assert sinks.overwrite_table(spark.range(2).selectExpr("id AS a", "'x' AS b"), f"{schema}.t").columns == ["a", "b"]


def test_csv_export(spark, small, tmp_path):
    top = small.run("mape_by_sku", sku_family="pipe", count=7)
    sinks.export_csv(top, str(tmp_path / "out"))
    rows = [r for f in Path(tmp_path / "out").glob("*.csv") for r in csv.DictReader(f.open())]
    assert len(rows) == top.count() and {r["sku_family"] for r in rows} == {"pipe"}


def test_to_numeric(spark):
    frame = spark.createDataFrame([("1.5", "x"), ("abc", None)], "a string, b string")
    assert [r.a for r in quality.to_numeric(frame, ["a", "gone"]).collect()] == [1.5, None]
    assert quality.to_numeric(frame, ["gone"]).columns == ["a", "b"]


def test_observed_expectation_counts(spark):
    seen = Observation("orders")
    kept = quality.keep_valid(orders(spark, line(), line(sent=-1), line(sent=None)), {"nonneg": "units_shipped >= 0"}, seen)
    assert kept.count() == 1
    assert seen.get == {"rows_seen": 3, "nonneg": 2}


def test_metric_view_grain_and_errors(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    view = MetricView("v", "t", {"k": "k", "upper_k": "upper(k)"}, {"Mean x": "avg(x)", "Rows": "count(1)"})
    assert view.query(frame, ["Mean x"]).first()[0] == 3.0
    by_key = view.query(frame, ["Mean x", "Rows"], ["upper_k"], "upper_k = 'A'").collect()
    assert [tuple(r) for r in by_key] == [("A", 2.0, 2)]
    with pytest.raises(ValueError, match="no measure '\\*'"):
        view.query(frame, ["*"])
    with pytest.raises(ValueError, match="no dimension 'x'"):
        view.query(frame, ["Rows"], ["x"])
    with pytest.raises(ValueError, match="at least one"):
        view.query(frame, [])


def test_views_name_existing_sources(small):
    for view in VIEWS.values():
        assert view.source in DATASETS
    worst = CONTROL_TOWER.query(small["control_tower_weekly"], ["OTIF"], ["dc_id"], order_by=[F.col("OTIF").asc()], limit=3)
    assert worst.count() == 3


def test_ties_at_the_limit_break_by_key(spark):
    rows = [(date(2001, 7, 2), f"f{i}", "ASIA", 0.5) for i in range(15)]
    frame = spark.createDataFrame(rows, "week date, sku_family string, region string, mape double").repartition(5)
    ws = Workspace(spark, tables={"kpi_mape_weekly": frame})
    assert [r.sku_family for r in ws.run("top_mape_problems").collect()] == sorted(f"f{i}" for i in range(15))[:10]


def test_streamed_silver_equals_batch(spark, tmp_path):
    source = orders(spark, line(), line("O2", sent=-1), line("O3", delivered=None))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BRONZE["bronze_erp_orders_raw"]).parquet(str(tmp_path / "in"))
    query = start_silver(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    batch = Workspace(spark, tables={"bronze_erp_orders_raw": source})["silver_erp_orders"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str) == sorted(batch.collect(), key=str)


def test_shuffles_start_with_enough_partitions(spark, small, monkeypatch):
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.size_shuffles(spark, small["lineitem"]) == base
    assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 1000)
    try:
        sized = session.size_shuffles(spark, small["lineitem"])
        assert sized > base and spark.conf.get(session.INITIAL_PARTITIONS) == str(sized)
        spark.conf.set(session.INITIAL_PARTITIONS, 7)
        assert session.size_shuffles(spark, small["lineitem"]) == 7
    finally:
        spark.conf.unset(session.INITIAL_PARTITIONS)


def test_without_a_shared_folder_nothing_is_written(spark, small, monkeypatch):
    monkeypatch.setattr(sinks, "shared_folder", lambda _: None)
    ws = Workspace(spark, small.source_dir, published=("bronze_plant_locations",))
    assert ws["bronze_plant_locations"].count() == 25
    assert {Path(f).name for f in ws["bronze_plant_locations"].inputFiles()} == {"nation.parquet", "region.parquet"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ws.materialize("bronze_plant_locations")


def test_shuffles_grow_with_the_source_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 1000)
    started = []
    try:
        for name, rows in (("small", 10_000), ("large", 100_000)):
            spark.range(rows).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
            assert Workspace(spark, f"{tmp_path}/{name}")["lineitem"].count() == rows
            started.append(int(spark.conf.get(session.INITIAL_PARTITIONS)))
        assert started[1] > started[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(session.INITIAL_PARTITIONS)
