from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_medallion import line, orders

from haulcast import EngineConfig, Workspace
from haulcast.operators import late_risk

DAY = date(2001, 7, 31)
NO_SIGNALS = "week date, region string, construction_index double, precipitation_mm double, avg_temp_c double"


def workspace(spark, *rows, **config):
    tables = {
        "bronze_erp_orders_raw": orders(spark, *rows),
        "silver_external_signals": spark.createDataFrame([], NO_SIGNALS),
    }
    return Workspace(spark, config=EngineConfig(as_of=DAY, **config), tables=tables)


def history(n=240):
    """Orders on DOT-like short notice are the late ones; every fifth does not follow the rule."""
    rows = []
    for i in range(n):
        day = DAY - timedelta(days=1 + i)
        late = (i % 4 == 0) != (i % 20 == 1)
        rows.append(line(f"O{i:010d}", day=day, requested=day + timedelta(days=3 if i % 4 == 0 else 12),
                         delivered=day + timedelta(days=20 if late else 2), plant="PL01" if i % 2 else "PL02"))
    return rows


def test_label(spark):
    ws = workspace(spark, line("late", delivered=date(2001, 7, 11)), line("missing", delivered=None),
                   line("open", requested=None), line("gone", status="cancelled", sent=0))
    assert {r.order_id: r.is_late for r in ws["labelled_orders"].collect()} == {"late": 1, "missing": 0, "open": None}


def test_windows(spark):
    days = {"old": 541, "first": 540, "before": 91, "cut": 90, "today": 0}
    ws = workspace(spark, *(line(k, day=DAY - timedelta(days=n)) for k, n in days.items()))
    assert {r.order_id for r in ws["late_risk_features"].collect()} == {"first", "before", "cut", "today"}
    counts = {r.split: r.row_count for r in ws.run("train_test_split_counts").collect()}
    assert counts == {"train": 2, "test": 2}
    assert {r.order_id for r in ws["late_risk_heuristic"].collect()} == {"before", "cut", "today"}


def test_rule_based_score(spark):
    day = DAY - timedelta(days=5)

    def order(name, days, units, channel):
        row = list(line(name, day=day, requested=day + timedelta(days=days), ordered=units, sent=units))
        row[7] = channel
        return tuple(row)

    ws = workspace(spark, order("plain", 6, 49, "ag"), order("all", 5, 50, "DOT"), order("big", 6, 50, "ag"), order("fast", 5, 1, "contractor"))
    scores = {r.order_id: r.late_risk_prob for r in ws["late_risk_heuristic"].collect()}
    assert scores == pytest.approx({"plain": 0.10, "all": 0.46, "big": 0.20, "fast": 0.36})


def test_model_ranks_late_orders_first_and_repeats(spark):
    rows = history()
    first = workspace(spark, *rows)
    metrics = first["late_risk_metrics"].first()
    assert metrics.auc > 0.8 and metrics.train_rows + metrics.test_rows == 240
    again = workspace(spark, *rows)
    a = first["order_late_risk_scored_ml"].orderBy("order_id").collect()
    b = again["order_late_risk_scored_ml"].orderBy("order_id").collect()
    assert [r.late_risk_prob for r in a] == pytest.approx([r.late_risk_prob for r in b], abs=1e-9)
    assert all(r.late_risk_flag == int(r.late_risk_prob >= 0.5) for r in a)
    assert min(r.order_date for r in a) == DAY - timedelta(days=91)


def test_unseen_category_and_missing_numbers_are_scored(spark):
    odd = list(line("odd", day=DAY, plant="PL99", requested=DAY + timedelta(days=12)))
    odd[14] = None  # unit price
    ws = workspace(spark, *history(), tuple(odd))
    row = ws["order_late_risk_scored_ml"].filter("order_id = 'odd'").first()
    assert 0 < row.late_risk_prob < 1 and row.units_ordered == 10
    vector = ws["late_risk_model"].transform(late_risk.model_inputs(ws["late_risk_features"].filter("order_id = 'odd'")))
    assert vector.first().plant_id_hot.numNonzeros() == 0


def test_single_class_trains(spark):
    rows = [line(f"O{i}", day=DAY - timedelta(days=i + 1), requested=DAY + timedelta(days=30)) for i in range(200)]
    scored = workspace(spark, *rows)["order_late_risk_scored_ml"]
    assert scored.filter("late_risk_flag = 1").count() == 0


def test_no_training_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="no labelled orders"):
        workspace(spark, line(day=DAY))["late_risk_model"]


def test_histogram_bins_cover_the_range(spark):
    rows = [("O", DAY, p) for p in (0.0, 0.049, 0.05, 0.999, 1.0)]
    frame = spark.createDataFrame(rows, "order_id string, order_date date, late_risk_prob double")
    ws = Workspace(spark, tables={"order_late_risk_scored_ml": frame})
    assert {r.bin: r.orders for r in ws.run("risk_histogram").collect()} == {0: 2, 1: 1, 19: 2}


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    class Counted:
        def fit(self, rows):
            return rows.groupBy(F.spark_partition_id()).count().collect()

    monkeypatch.setattr(late_risk, "_pipeline", lambda rows: Counted())
    monkeypatch.setattr(late_risk, "ROWS_A_TASK", 50)
    texts = [F.lit("x").alias(c) for c in late_risk.CATEGORIES]
    numbers = [F.col("id").cast("double").alias(c) for c in late_risk.NUMBERS]
    one_task = spark.range(0, 2000, 1, 1).select(*texts, *numbers, F.lit(0).alias("is_late"))
    parts = [r["count"] for r in late_risk.train(one_task)]
    assert sum(parts) == 2000 and len(parts) == 40 and max(parts) < 100
