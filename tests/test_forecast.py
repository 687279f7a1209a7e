"""Series of every length through the split, the naive forecast and the ridge step."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from haulcast import EngineConfig, Workspace
from haulcast.operators import ridge

START = date(1996, 1, 1)


def demand(spark, series):
    """series: name -> list of weekly units; None leaves the week out."""
    rows = [
        (START + timedelta(weeks=i), name, "ASIA", units, units, 1)
        for name, values in series.items()
        for i, units in enumerate(values)
        if units is not None
    ]
    return spark.createDataFrame(
        rows, "week date, sku_family string, region string, actual_units bigint, shipped_units bigint, order_lines bigint"
    )


def signals(spark, weeks=0):
    rows = [(START + timedelta(weeks=i), "ASIA", 90.0 + i % 7, float(i % 3), 10.0 + i % 5) for i in range(weeks)]
    return spark.createDataFrame(
        rows, "week date, region string, construction_index double, precipitation_mm double, avg_temp_c double"
    )


def make(spark, series, weeks=0, **config):
    tables = {"weekly_demand_actual": demand(spark, series), "silver_external_signals": signals(spark, weeks)}
    return Workspace(spark, config=EngineConfig(as_of=date(2001, 8, 1), **config), tables=tables)


def wave(n):
    return [int(100 + 30 * np.sin(i / 4.0) + (i * 7919) % 23) for i in range(n)]


LENGTHS = {"s3": 3, "s8": 8, "s24": 24, "s62": 62, "s63": 63, "s70": 70, "s300": 300}


@pytest.fixture(scope="module")
def mixed(spark):
    return make(spark, {k: wave(n) for k, n in LENGTHS.items()}, weeks=300)


@pytest.fixture(scope="module")
def everything(mixed):
    return mixed["demand_forecast_all"].toPandas()


def test_holdout_lengths(mixed):
    sizes = {r.sku_family: r.holdout_weeks for r in mixed["backtest_split"].select("sku_family", "holdout_weeks").distinct().collect()}
    assert sizes == {"s3": 8, "s8": 8, "s24": 8, "s62": 15, "s63": 52, "s70": 52, "s300": 52}


def test_rows_per_series_and_model(everything):
    counts = everything.groupby(["sku_family", "model_name", "is_backtest"]).size()
    for name, n in LENGTHS.items():
        for model in (ridge.NAIVE, ridge.RIDGE):
            held = {"s62": 15, "s63": 52, "s70": 52, "s300": 52}.get(name, min(8, n))
            assert counts[name, model, 1.0] == held
            assert counts[name, model, 0.0] == 13


def test_bounds_enclose_the_forecast(everything):
    assert (everything.lower_ci <= everything.forecast_units).all()
    assert (everything.forecast_units <= everything.upper_ci).all()
    assert (everything.lower_ci >= 0).all()


def reference_ridge(x, y, new):
    """Ridge by least squares on rows extended with the penalty, written without the library."""
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = (x - mean) / std
    extended = np.vstack([z, np.eye(z.shape[1])])
    target = np.concatenate([y - y.mean(), np.zeros(z.shape[1])])
    weights = np.linalg.lstsq(extended, target, rcond=None)[0]
    return y.mean() + (new - mean) / std @ weights, np.std(y - y.mean() - z @ weights)


def features(values, weeks):
    week = pd.date_range(START, periods=len(values), freq="7D")
    frame = pd.DataFrame({"y": np.array(values, float), "t": np.arange(len(values), dtype=float)})
    woy = week.isocalendar().week.to_numpy(float)
    frame["sin"], frame["cos"] = np.sin(2 * np.pi * woy / 52), np.cos(2 * np.pi * woy / 52)
    for k in (1, 4, 52):
        frame[f"l{k}"] = frame.y.shift(k)
    frame["r4"] = frame.y.rolling(4).mean().shift(1)
    i = np.arange(len(values))
    frame["a"], frame["b"], frame["c"] = 90.0 + i % 7, (i % 3).astype(float), 10.0 + i % 5
    return frame


def test_ridge_backtest_matches_least_squares(everything):
    frame = features(wave(300), 300)
    columns = [c for c in frame if c != "y"]
    train, test = frame[:-52].dropna(subset=["l1", "l4", "r4"]), frame[-52:]
    expected, spread = reference_ridge(train[columns].fillna(0).to_numpy(), train.y.to_numpy(), test[columns].fillna(0).to_numpy())
    got = everything.query("sku_family == 's300' and model_name == @ridge.RIDGE and is_backtest == 1").sort_values("week")
    np.testing.assert_allclose(got.forecast_units, np.maximum(expected, 0), rtol=1e-8)
    np.testing.assert_allclose(got.upper_ci, np.maximum(expected + 1.64 * spread, 0), rtol=1e-8)


def test_ridge_future_feeds_its_own_predictions(everything):
    values = wave(300)
    frame = features(values, 300)
    columns = [c for c in frame if c != "y"]
    fit = frame.dropna(subset=["l1", "l4", "r4"])
    history, last = [float(v) for v in values], frame.iloc[-1]
    for i in range(13):
        woy = (START + timedelta(weeks=300 + i)).isocalendar().week
        row = [len(history), np.sin(2 * np.pi * woy / 52), np.cos(2 * np.pi * woy / 52), history[-1], history[-4],
               history[-52], np.mean(history[-4:]), last.a, last.b, last.c]
        value, _ = reference_ridge(fit[columns].fillna(0).to_numpy(), fit.y.to_numpy(), np.array([row]))
        history.append(max(0.0, float(value[0])))
    got = everything.query("sku_family == 's300' and model_name == @ridge.RIDGE and is_backtest == 0").sort_values("week")
    np.testing.assert_allclose(got.forecast_units, history[300:], rtol=1e-7)
    assert list(got.week) == [START + timedelta(weeks=300 + i) for i in range(13)]


def test_short_series_fall_back_to_the_naive_forecast(everything):
    for name in ("s3", "s8", "s24"):
        rows = everything[everything.sku_family == name]
        if name == "s24":  # its 20 usable rows are enough once nothing is held out
            rows = rows[rows.is_backtest == 1]
        by_model = {m: g.sort_values(["is_backtest", "week"]).forecast_units.to_numpy() for m, g in rows.groupby("model_name")}
        np.testing.assert_array_equal(by_model[ridge.NAIVE], by_model[ridge.RIDGE])
    three = everything.query("sku_family == 's3' and is_backtest == 1 and model_name == @ridge.NAIVE")
    assert three.forecast_units.tolist() == pytest.approx([np.mean(wave(3))] * 3)
    spread = three.upper_ci.iloc[0] - three.forecast_units.iloc[0]
    assert spread == pytest.approx(1.64 * 10.0)  # too few rows to measure steps


def test_naive_spread_is_that_of_weekly_steps_when_nothing_is_fitted(everything):
    values = wave(24)
    rows = everything.query("sku_family == 's24' and is_backtest == 0 and model_name == @ridge.NAIVE")
    assert rows.forecast_units.iloc[0] == pytest.approx(np.mean(values[-4:]))
    assert (rows.upper_ci - rows.forecast_units).iloc[0] == pytest.approx(1.64 * np.std(np.diff(values[:-8])))


def test_constant_series_and_missing_signals(spark):
    ws = make(spark, {"flat": [50] * 120})
    rows = ws["demand_forecast_all"].toPandas()
    assert rows.forecast_units.to_numpy() == pytest.approx(np.full(len(rows), 50.0))
    assert ws["series_last_state"].first().construction_index == 0.0


def test_missing_weeks_are_skipped_by_lags_and_filled_by_the_grid(spark):
    values = wave(20)
    values[10] = None
    ws = make(spark, {"gap": values, "full": wave(20)})
    lag = {r.week: r.lag_1 for r in ws["series_features"].filter("sku_family = 'gap'").collect()}
    assert lag[START + timedelta(weeks=11)] == values[9]
    grid = {(r.sku_family, r.week): r.actual_units for r in ws["dense_week_grid"].collect()}
    assert len(grid) == 40 and grid["gap", START + timedelta(weeks=10)] == 0


def test_simple_recipe(spark):
    ws = make(spark, {"s": wave(100), "tiny": wave(3)}, recipe="simple")
    rows = ws["demand_forecast_all"].toPandas()
    future = rows[rows.is_backtest == 0].pivot(index=["sku_family", "week"], columns="model_name", values="forecast_units")
    np.testing.assert_array_equal(future[ridge.NAIVE], future[ridge.RIDGE])
    assert len(rows.query("sku_family == 's' and is_backtest == 1")) == 2 * 25  # a quarter of the series
    assert len(rows.query("sku_family == 'tiny' and is_backtest == 1")) == 2 * 3


def test_mape_and_planner_kpis_agree(spark, mixed):
    weekly = mixed["kpi_mape_weekly"].filter("sku_family = 's300'")
    by_series = {(r.sku_family, r.model_name): r.mape for r in mixed["mape_by_series"].collect()}
    assert weekly.groupBy().avg("mape").first()[0] == pytest.approx(by_series["s300", ridge.RIDGE])


def test_outlook_adds_one_row_per_coming_week(mixed):
    plain, ahead = mixed["demand_vs_forecast_weekly"].count(), mixed.run("demand_outlook").count()
    assert ahead == plain + 13 * len(LENGTHS)


def test_unknown_recipe_is_refused():
    with pytest.raises(ValueError, match="recipe"):
        EngineConfig(recipe="other")
