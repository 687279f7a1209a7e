from datetime import date

import pytest
from pyspark.sql import functions as F

from haulcast.functions import calendar as C
from haulcast.functions import expressions as E


def one(spark, expr, **values):
    types = {int: "int", float: "double", str: "string", date: "date"}
    row = {k: v for k, v in values.items()}
    ddl = ", ".join(f"{k} {types.get(type(v), 'double')}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], ddl).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "actual, forecast, ape, bias",
    [(0.0, 0.0, 0, 0), (0.0, 5.0, 1, 1), (10.0, 10.0, 0, 0), (10.0, 0.0, 1, -1), (10.0, 15.0, 0.5, 0.5), (None, 5.0, None, None), (0.0, None, None, None)],
)
def test_errors(spark, actual, forecast, ape, bias):
    assert one(spark, E.absolute_pct_error("a", "f"), a=actual, f=forecast) == ape
    assert one(spark, E.signed_pct_error("a", "f"), a=actual, f=forecast) == bias


def test_ratios(spark):
    assert one(spark, E.ratio_or_null("n", "d"), n=3.0, d=0.0) is None
    assert one(spark, E.ratio_or_null("n", "d"), n=3, d=2) == 1.5
    assert one(spark, E.ratio_floored("n", "d", 0.5), n=3.0, d=0.0) == 6.0
    assert one(spark, E.ratio_floored("n", "d", 0.5), n=3.0, d=None) == 6.0


def test_padding_keeps_long_numbers(spark):
    assert one(spark, E.padded("n", 5), n=42) == "00042"
    assert one(spark, E.padded("n", 5), n=1234567) == "1234567"


def test_severity_borders(spark):
    tiers = [one(spark, E.severity_tier("m"), m=m) for m in (0.25, 0.2499, 0.15, 0.1499)]
    assert tiers == ["danger", "warning", "warning", "success"]


def test_labels_and_formats(spark):
    assert one(spark, E.without_words("n", ("Site ", *E.PLANT_NAME_WORDS)), n="Site Hamilton Plant") == "HAMILTON"
    assert one(spark, E.without_words("n", ("Site ", *E.DC_NAME_WORDS)), n="Site Cabot Yard") == "CABOT"
    assert one(spark, E.percent_text("r"), r=0.8534) == "85.3%"
    assert one(spark, E.dollar_text("r"), r=1234.5) == "$1,234.50"
    assert one(spark, E.count_text("r"), r=1234567) == "1,234,567"


def test_shown_ignores_the_last_bits(spark):
    assert one(spark, E.shown("x", 1), x=61.25) == one(spark, E.shown("x", 1), x=61.24999999999999) == 61.3


def test_week_starts_on_monday(spark):
    assert one(spark, C.week_of("d"), d=date(2001, 8, 5)) == date(2001, 7, 30)
    assert one(spark, C.week_of("d"), d=date(2001, 8, 6)) == date(2001, 8, 6)


def test_calendar_columns(spark):
    days = spark.createDataFrame([(date(2001, 8, 4),), (date(2001, 8, 6),)], "date date")
    saturday, monday = C.calendar_columns(days).orderBy("date").collect()
    assert (saturday.dow, saturday.weekday_factor) == (7, 0.85)
    assert (monday.dow, monday.weekday_factor, monday.week) == (2, 1.0, date(2001, 8, 6))
    assert 0 <= monday.season_annual <= 1


def test_history_bounds(spark):
    first, last = C.history_bounds(F.lit(date(2001, 8, 1)), 3)
    assert one(spark, first) == date(1998, 7, 31)
    assert one(spark, last) == date(2001, 7, 31)


def test_last_weeks_counts_distinct_weeks(spark):
    rows = [(date(2001, 7, 2), 1), (date(2001, 7, 2), 2), (date(2001, 7, 16), 3), (date(2001, 7, 23), 4)]
    kept = C.last_weeks(spark.createDataFrame(rows, "week date, v int"), 2)
    assert sorted(r.v for r in kept.collect()) == [3, 4]
