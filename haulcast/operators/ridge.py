"""Ridge regression of weekly series: two solves a series in pandas, everything else as column expressions.

A grouped call returns one row of coefficients for each series. Backtest and horizon are then computed in the JVM: the
horizon is a fold over the coming weeks whose state is the last year of history, each prediction joining it.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

NAIVE = "naive_ma4"
RIDGE = "ridge_time_lags"
SIGNALS = ["construction_index", "precipitation_mm", "avg_temp_c"]
NEEDED = ["lag_1", "lag_4", "roll4"]
FEATURES = ["t", "sin_woy", "cos_woy", "lag_1", "lag_4", "lag_52", "roll4", *SIGNALS]
MEMORY = 52  # weeks of history that the longest lag reaches back

# Ridge penalty, least rows to fit, least rows to measure steps, default spread.
PENALTY = 1.0
MIN_FIT_ROWS = 20
MIN_STEP_ROWS = 5
DEFAULT_SPREAD = 10.0

# Coefficients of the fit on the weeks before the hold-out, and of the fit on all weeks; null where rows are too few.
FITS = ("train", "whole")
COEFFICIENTS = "sku_family string, region string, " + ", ".join(
    f"{fit}_intercept double, {fit}_slopes array<double>, {fit}_spread double" for fit in FITS
)

# Executors need not have this package installed to run the solves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def solve(rows: pd.DataFrame) -> tuple[float | None, np.ndarray | None, float | None]:
    """Intercept, slopes and residual spread, on the features as they come.

    Inside, features are standardised (population spread, constants left unscaled) and the mean is not penalised.
    """
    usable = rows.dropna(subset=NEEDED)
    if len(usable) < MIN_FIT_ROWS:
        return None, None, None
    x, y = usable[FEATURES].fillna(0.0).to_numpy(float), usable["y"].to_numpy(float)
    centre, width = x.mean(axis=0), x.std(axis=0)
    scale = np.where(width > 0, width, 1.0)
    z = (x - centre) / scale
    weights = np.linalg.solve(z.T @ z + PENALTY * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    slopes = weights / scale
    return float(y.mean() - centre @ slopes), slopes, float(np.std(y - y.mean() - z @ weights))


def coefficients(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Both fits of one series as one row."""
    rows = rows.sort_values("week", ignore_index=True)
    fits = zip(FITS, (rows[~rows["is_holdout"]], rows))
    named = [(f"{fit}_{part}", [value]) for fit, chosen in fits for part, value in zip(("intercept", "slopes", "spread"), solve(chosen))]
    return pd.DataFrame({"sku_family": [key[0]], "region": [key[1]], **dict(named)})


def predicted(fit: str, features: list[Column]) -> Column:
    """The fit's prediction; null where the series has no such fit. Missing features count zero."""
    products = F.zip_with(f"{fit}_slopes", F.array(*(F.coalesce(f, F.lit(0.0)) for f in features)), lambda w, x: w * x)
    return F.aggregate(products, F.col(f"{fit}_intercept"), lambda total, p: total + p)


def rolled_forward(horizon: int, week: str, recent: str, rows: str, flat: str) -> Column:
    """Predictions for the coming weeks, each of them the history of the next: an array of ``horizon`` values.

    ``recent`` holds up to the last ``MEMORY`` values in order, ``rows`` is the length of the series, ``week`` its last
    week and ``flat`` what stands in for history that is too short.
    """

    def back(history: Column, k: int) -> Column:
        return F.coalesce(F.try_element_at(history, F.lit(-k)), F.col(flat))

    def step(state: Column, i: Column) -> Column:
        history = state["history"]
        angle = F.lit(2.0 * np.pi) * F.weekofyear(F.date_add(week, i * 7)) / F.lit(52.0)
        mean = F.aggregate(F.slice(history, F.greatest(F.size(history) - 3, F.lit(1)), F.lit(4)), F.lit(0.0), lambda a, v: a + v) / 4
        roll4 = F.when(F.size(history) >= 4, mean).otherwise(F.col(flat))
        lags = [back(history, k) for k in (1, 4, 52)]
        t = (F.col(rows) + i - 1).cast("double")
        value = F.greatest(F.lit(0.0), predicted("whole", [t, F.sin(angle), F.cos(angle), *lags, roll4, *map(F.col, SIGNALS)]))
        grown = F.concat(history, F.array(value))
        kept = F.slice(grown, F.greatest(F.size(grown) - (MEMORY - 1), F.lit(1)), F.lit(MEMORY))
        return F.struct(kept.alias("history"), F.concat(state["ahead"], F.array(value)).alias("ahead"))

    start = F.struct(F.col(recent).alias("history"), F.array().cast("array<double>").alias("ahead"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda state: state["ahead"])
