"""Named scalar helpers: KPI ratios, forecast error, labels and display formats."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company name and kinds of site, stripped from facility names for map labels.
PLANT_NAME_WORDS = ("ADS ", " Plant")
DC_NAME_WORDS = ("ADS ", " Distribution", " Facility", " Yard", " Logistics")

# MAPE at or above which a family counts as a danger / a warning.
MAPE_DANGER = 0.25
MAPE_WARNING = 0.15

# Smallest denominators of the floored ratios.
TONS_FLOOR = 0.0001
UNITS_FLOOR = 1.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded(number: Column | str, width: int) -> Column:
    """Zero-padded digits; longer numbers keep all their digits (plain lpad would cut them)."""
    digits = _col(number).cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def ratio_or_null(numerator: Column | str, denominator: Column | str) -> Column:
    """Zero or null denominator gives null."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def ratio_floored(numerator: Column | str, denominator: Column | str, floor: float) -> Column:
    """Denominators below ``floor`` (or null) count as ``floor``."""
    return _col(numerator) / F.greatest(F.lit(floor), _col(denominator))


def share_true(condition: Column) -> Column:
    """Share of rows where the condition holds; null counts as not holding."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def _error(actual: Column, forecast: Column, gap: Column) -> Column:
    zero_demand = F.when(forecast == 0, F.lit(0.0)).when(forecast != 0, F.lit(1.0))
    return F.when(actual == 0, zero_demand).otherwise(ratio_or_null(gap, actual))


def absolute_pct_error(actual: Column | str, forecast: Column | str) -> Column:
    """|a - f| / a; with zero demand 0 if the forecast is zero too, else 1."""
    a, f = _col(actual), _col(forecast)
    return _error(a, f, F.abs(a - f))


def signed_pct_error(actual: Column | str, forecast: Column | str) -> Column:
    """(f - a) / a under the same zero-demand rule."""
    a, f = _col(actual), _col(forecast)
    return _error(a, f, f - a)


def severity_tier(mape: Column | str) -> Column:
    m = _col(mape)
    return F.when(m >= MAPE_DANGER, "danger").when(m >= MAPE_WARNING, "warning").otherwise("success")


def season_angle(week: Column | str) -> Column:
    return F.lit(2.0 * pi) * F.weekofyear(_col(week)) / F.lit(52.0)


def without_words(name: Column | str, words: tuple[str, ...]) -> Column:
    """Upper-case label after deleting each word in turn."""
    out = _col(name)
    for word in words:
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.upper(out)


def shown(value: Column | str, digits: int) -> Column:
    """Rounded half up. The last bits go first, where sums differ with the order of addition."""
    return F.round(F.round(_col(value), 10), digits)


def percent_text(rate: Column | str) -> Column:
    return F.concat(shown(_col(rate) * 100, 1).cast("string"), F.lit("%"))


def dollar_text(amount: Column | str) -> Column:
    return F.call_function("format_number", shown(amount, 2), F.lit("$#,##0.00"))


def count_text(units: Column | str, pattern: str = "#,##0") -> Column:
    return F.call_function("format_number", _col(units).cast("double"), F.lit(pattern))


def steady(value: Column | str) -> Column:
    """Ranking key that hides the last bits, where sums differ with the order of addition."""
    return F.round(_col(value), 9)
