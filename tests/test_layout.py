"""Data layout, versions, catalog views, availability, metric views by name, plan shapes."""

import uuid
from datetime import date, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_medallion import line, orders

from haulcast import EngineConfig, Workspace, catalog
from haulcast.schemas import BRONZE
from haulcast.sources import sinks
from haulcast.sources.views import refresh_views

SOURCE = "/root/testdata/sf0.01"


@pytest.fixture
def schema(spark):
    name = f"v{uuid.uuid4().hex[:8]}"
    sinks.ensure_schema(spark, name)
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


@pytest.fixture(scope="module")
def laid_out(spark):
    kept, sinks.ROW_GROUP_BYTES = sinks.ROW_GROUP_BYTES, 64 << 10
    try:
        ws = Workspace(spark, SOURCE, published={"bronze_erp_orders_raw": ("order_date",)})
        assert ws["bronze_erp_orders_raw"].count() == 60_000
        yield ws
    finally:
        sinks.ROW_GROUP_BYTES = kept


def test_a_trailing_window_reads_few_row_groups(laid_out):
    bound = laid_out._newest - timedelta(days=91)
    newest = []
    for file in laid_out["bronze_erp_orders_raw"].inputFiles():
        footer = pq.ParquetFile(file.removeprefix("file://")).metadata
        at = footer.schema.names.index("order_date")
        newest += [footer.row_group(i).column(at).statistics.max for i in range(footer.num_row_groups)]
    assert len(newest) > 20
    assert 0 < sum(day >= bound for day in newest) < len(newest) / 10
    laid_out.spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = laid_out.run("orders_by_channel")._jdf.queryExecution().executedPlan().toString()
    laid_out.spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual(order_date,{bound})" in plan


def test_one_day_with_most_rows_is_spread(spark, tmp_path):
    frame = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, date(2001, 1, 1)).otherwise(F.date_add(F.lit(date(2000, 1, 1)), (F.col("id") % 300).cast("int"))).alias("day"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    written = sinks.write_new(frame.repartition(8), str(tmp_path), "t", ["day"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = written.groupBy(F.input_file_name()).count().collect()
    assert written.count() == 40_000 and len(parts) > 1
    assert max(r["count"] for r in parts) < 30_000


def test_distinct_counts_multiply_no_line(laid_out):
    frame = laid_out.run("order_volume_kpis")
    assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()
    got = frame.first()
    recent = laid_out["recent_orders"]
    assert got.unique_customers == recent.select("customer_id").distinct().count()
    assert got.total_orders == recent.count()


def test_distinct_counts_of_nothing_and_of_nulls(spark):
    rows = [line(), line("O2")]
    frame = orders(spark, *rows).withColumn("customer_id", F.lit(None).cast("string"))
    some = Workspace(spark, tables={"recent_orders": Workspace(spark, tables={"bronze_erp_orders_raw": frame})["silver_erp_orders"]})
    assert tuple(some.run("order_volume_kpis").select("total_orders", "unique_customers", "sales_channels").first()) == (2, 0, 1)
    none = some.with_tables(recent_orders=some["recent_orders"].limit(0)).run("order_volume_kpis").first()
    assert tuple(none) == (0, 0, 0, None)


def test_broadcast_by_written_size(spark, tmp_path):
    small = sinks.write_new(spark.range(100), str(tmp_path), "small")
    joined = lambda most: spark.range(10).join(sinks.broadcast_if_small(small, most), "id")
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(joined(1 << 20)) and "strategy=broadcast" not in plan(joined(10))


def test_signals_are_broadcast_to_order_lines(spark):
    ws = Workspace(spark, SOURCE, published={"bronze_erp_orders_raw": (), "bronze_external_signals_raw": ()})
    plan = ws.run("order_enrichment")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [order_date" not in plan and plan.count("BroadcastHashJoin [order_date") == 2


def test_a_reader_sees_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    first = sinks.write_version(spark.range(5), path)
    broken = spark.range(5).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_version(broken, path)
    assert sinks.read_version(spark, path).count() == 5
    # a writer that has claimed its number and written part of its files
    (tmp_path / "t" / "_claimed" / "3").touch()
    spark.range(1).write.parquet(f"{path}/v3")
    assert sinks.read_version(spark, path).count() == 5
    second = sinks.write_version(sinks.read_version(spark, path).where("id > 1"), path)
    assert (first.count(), second.count()) == (5, 3)
    third = sinks.write_version(spark.range(7), path)
    assert (second.count(), third.count(), sinks.read_version(spark, path).count()) == (3, 7, 7)
    assert sorted(p.name for p in (tmp_path / "t" / "_published").iterdir() if p.suffix != ".crc") == ["4", "5"]


def test_catalog_views_outlive_the_session_and_are_skipped_without_tables(spark, schema):
    state = lambda: [(s.name, s.state, s.missing) for s in refresh_views(spark, schema)]
    assert state() == [
        ("kpi_mape_weekly", "skipped", ("weekly_demand_actual",)),
        ("demand_vs_forecast_weekly", "skipped", ("weekly_demand_actual", "demand_forecast_future")),
    ]
    ws = Workspace(spark, "/root/testdata/sf0.001").materialize("weekly_demand_actual", schema=schema)
    assert state()[0] == ("kpi_mape_weekly", "written", ()) and state()[1][1] == "skipped"
    assert spark.table(f"{schema}.kpi_mape_weekly").count() == 0  # over the empty stand-in for the forecast
    naive = catalog.on_naive(ws)
    for name in ("demand_forecast", "demand_forecast_future"):
        sinks.overwrite_table(naive[name], f"{schema}.{name}")
    assert [s[1] for s in state()] == ["written", "written"]
    other = spark.newSession()
    for name in ("kpi_mape_weekly", "demand_vs_forecast_weekly"):
        rounded = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in naive[name].dtypes]
        view = other.table(f"{schema}.{name}").select(*rounded).collect()
        assert sorted(map(str, view)) == sorted(map(str, naive[name].select(*rounded).collect()))
    assert spark.catalog.getTable(f"{schema}.kpi_mape_weekly").tableType == "VIEW"
    sinks.overwrite_table(spark.range(1), f"{schema}.was_a_table")
    sinks.create_view(spark, f"{schema}.was_a_table", "SELECT 2 AS two", "It's a view")
    assert other.table(f"{schema}.was_a_table").first().two == 2


@pytest.fixture(scope="module")
def bronze(spark):
    source = Workspace(spark, "/root/testdata/sf0.001")
    return {name: source[name] for name in BRONZE}


def test_every_entry_resolves_from_the_bronze_tables(spark, bronze):
    ws = Workspace(spark, tables=bronze)
    named = catalog.runs()
    states = {s.name: s for s in ws.report(*{r.name for r in named.values()})}
    assert {s.state for s in states.values()} <= {"ready", "placeholder"}
    for name, run in named.items():
        assert run(ws).columns, name


def test_a_missing_table_skips_what_reads_it(spark, bronze, tmp_path):
    given = {n: f for n, f in bronze.items() if n not in ("bronze_tms_shipments_raw", "bronze_external_signals_raw")}
    ws = Workspace(spark, tables=given)
    report = {s.name: s for s in ws.report()}
    assert report["kpi_freight_weekly"].state == report["control_tower_weekly"].state == "skipped"
    assert report["mv_worst_dcs"].missing == ("bronze_tms_shipments_raw",)
    assert report["bronze_external_signals_raw"].state == "placeholder" and report["kpi_otif_weekly"].state == "ready"
    done = ws.refresh("control_tower_weekly", "kpi_otif_weekly", "late_risk_features", path=str(tmp_path))
    assert [(s.name, s.state) for s in done] == [
        ("control_tower_weekly", "skipped"), ("kpi_otif_weekly", "written"), ("late_risk_features", "written"),
    ]
    assert sinks.read_version(spark, str(tmp_path / "late_risk_features")).where("avg_temp_c is not null").count() == 0
    assert ws["forecast_training_set"].count() > 0


def test_refresh_builds_inputs_first(spark, bronze, tmp_path):
    ws = Workspace(spark, tables=bronze)
    done = ws.refresh("control_tower_weekly", "kpi_freight_weekly", path=str(tmp_path))
    assert [s.state for s in done] == ["written", "written"]
    assert {f.split("/")[-3] for f in ws["kpi_freight_weekly"].inputFiles()} == {"kpi_freight_weekly"}
    assert ws["control_tower_weekly"].count() == Workspace(spark, tables=bronze)["control_tower_weekly"].count()


def test_absent_optional_columns_are_filled(spark):
    frame = orders(spark, line(), line("O2")).drop("channel", "unit_price", "sku_family", "customer_region")
    ws = Workspace(spark, tables={"bronze_erp_orders_raw": frame}, config=EngineConfig(as_of=date(2001, 8, 1)))
    got = ws["weekly_demand_actual"].first()
    assert (got.sku_family, got.region) == ("unknown", "unknown")
    series = spark.createDataFrame([(date(2001, 1, 1) + timedelta(weeks=i), 10.0 + i % 3) for i in range(40)], "week date, y double")
    simple = Workspace(spark, config=EngineConfig(as_of=date(2001, 8, 1), recipe="simple"), tables={"forecast_training_set": series})
    rows = simple["demand_forecast_all"].collect()
    assert {(r.sku_family, r.region) for r in rows} == {("unknown", "unknown")} and len(rows) == 2 * (10 + 13)


def test_metric_views_by_name(small):
    by_dc = small.metric("mv_control_tower_kpis", ["OTIF"], ["dc_id"], "region = 'ASIA'", ["dc_id"])
    assert by_dc.columns == ["dc_id", "OTIF"] and by_dc.count() > 0
    risk = small.metric("mv_forecast_accuracy", ["MAPE"], ["region"], F.col("week") >= date(2000, 1, 1))
    assert risk.count() > 0
    with pytest.raises(KeyError, match="mv_control_tower_kpis"):
        small.metric("mv_other", ["OTIF"])
    with pytest.raises(ValueError, match="dimensions"):
        small.metric("mv_control_tower_kpis", ["OTIF"], ["dc_id"], "otif_rate > 0.5")
    with pytest.raises(ValueError, match="dimensions"):
        small.metric("mv_control_tower_kpis", ["OTIF"], ["dc_id"], F.col("premium_freight_pct") > 0)


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"  # noqa: N815

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_folder(Session())


def test_facility_labels_drop_the_company_name(spark):
    plants = spark.createDataFrame([("P1", "ADS Findlay North Plant")], "plant_id string, plant_name string")
    dcs = spark.createDataFrame([("D1", "ADS Cabot Yard"), ("D2", None)], "dc_id string, dc_name string")
    ws = Workspace(spark, tables={"silver_plant_locations": plants, "silver_dc_locations": dcs})
    assert sorted(ws.run("facility_labels").collect()) == [("D1", "CABOT"), ("D2", None), ("P1", "FINDLAY NORTH")]


def test_enrichment_joins_customers_and_skus(spark):
    plants = spark.createDataFrame([("P1", "EAST"), ("P2", "WEST")], "plant_id string, plant_region string")
    dcs = spark.createDataFrame([("D1", "EAST"), ("D2", "WEST")], "dc_id string, dc_region string")
    rows = orders(spark, line("O1"), line("O2")).drop("customer_id", "sku_id")
    ids = F.when(F.col("order_id") == "O1", F.lit("C000003")), F.when(F.col("order_id") == "O1", F.lit("SKU00017"))
    lines = rows.withColumns({"customer_id": ids[0], "sku_id": ids[1]})
    ws = Workspace(spark, tables={"bronze_erp_orders_raw": lines, "bronze_plant_locations": plants, "bronze_dc_locations": dcs})
    found = ws.run("order_enrichment").select("order_id", "home_region", "home_channel", "rule_family", "list_price", "primary_dc_id")
    assert sorted(found.collect()) == [("O1", "WEST", "distributor", "chambers", 282.5, "D2"), ("O2", None, None, None, None, None)]
