"""Row expectations and type repair on the way in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def keep_valid(frame: DataFrame, rules: Mapping[str, str], observation: Observation | None = None) -> DataFrame:
    """Rows meeting every rule; a rule that evaluates to null counts as failed.

    With an observation, the rows seen and the rows failing each rule are counted in the same
    pass. It is opt-in because a counting node stops filters from being pushed below it.
    """
    if observation is not None:
        failed = (F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items())
        frame = frame.observe(observation, F.count(F.lit(1)).alias("rows_seen"), *failed)
    for rule in rules.values():
        frame = frame.filter(rule)
    return frame


def rule_report(frame: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows kept and dropped per rule, all rules in one aggregation."""
    counts = []
    for name, rule in rules.items():
        ok = F.coalesce(F.expr(rule), F.lit(False))
        counts.append(
            F.struct(F.lit(name).alias("rule"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))
        )
    return frame.agg(F.array(*counts).alias("report")).select(F.inline("report"))


def to_numeric(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Named columns as double, text that is no number as null; absent columns are ignored."""
    present = [c for c in columns if c in frame.columns]
    return frame.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in present}) if present else frame
