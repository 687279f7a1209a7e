"""Week buckets, trailing windows and calendar columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length of the seasonal year in days, weekend demand factor.
SEASON_DAYS = 365.25
WEEKEND_FACTOR = 0.85


def week_of(day: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", day).cast("date")


def month_of(day: Column | str) -> Column:
    return F.trunc(day, "month")


def since(day: Column | str, as_of: Column, days: int) -> Column:
    """Rows of the trailing ``days`` days before ``as_of`` (bound included)."""
    return (F.col(day) if isinstance(day, str) else day) >= F.date_sub(as_of, days)


def last_weeks(frame: DataFrame, count: int) -> DataFrame:
    """Rows of the ``count`` newest distinct weeks.

    The list of weeks holds at most ``count`` rows, so broadcasting it is safe at any scale.
    """
    newest = frame.select("week").distinct().orderBy(F.col("week").desc()).limit(count)
    return frame.join(F.broadcast(newest), "week", "left_semi")


def daily_spine(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day between two date columns of a one-row frame."""
    return bounds.select(F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))).alias("date"))


def calendar_columns(days: DataFrame) -> DataFrame:
    """Adds day of year, day of week (Sunday = 1), week, and the two seasonal factors."""
    doy = F.dayofyear("date")
    dow = F.dayofweek("date")
    return days.select(
        "*",
        doy.alias("doy"),
        dow.alias("dow"),
        week_of("date").alias("week"),
        ((F.sin(F.lit(2.0 * pi) * doy / F.lit(SEASON_DAYS)) + 1.0) / 2.0).alias("season_annual"),
        F.when(dow.isin(1, 7), WEEKEND_FACTOR).otherwise(1.0).alias("weekday_factor"),
    )


def history_bounds(as_of: Column, years: int) -> tuple[Column, Column]:
    """First and last day of a history that ends the day before ``as_of``."""
    last = F.date_sub(as_of, 1)
    return F.add_months(last, -12 * years), last
