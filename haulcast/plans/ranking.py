"""Ordered and limited results that come out the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top(frame: DataFrame, count: int | None, *order: Column | str) -> DataFrame:
    """First rows in a total order: pass enough tie-breakers to tell every output row apart.

    Spark keeps ``count`` rows per task and merges them, so no full sort happens. ``None`` keeps all rows.
    """
    ordered = frame.orderBy(*order)
    return ordered if count is None else ordered.limit(count)
