"""Parameterised queries over the Silver, Gold, forecast and risk datasets."""

from haulcast.plans import accuracy, derived, logistics, metrics, planner, risk, service  # noqa: F401
