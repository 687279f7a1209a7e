"""Silver, Gold, series, forecast, risk and metric-layer datasets."""

from haulcast.operators import accuracy, forecast, gold, late_risk, rules, series, silver  # noqa: F401
