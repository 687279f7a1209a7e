"""Late-risk queries over a scored-orders table and over the labelled features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.config import EngineConfig
from haulcast.functions.calendar import week_of
from haulcast.functions.expressions import shown, steady
from haulcast.operators.late_risk import HIGH_RISK, in_test_window
from haulcast.plans.ranking import top
from haulcast.workspace import query

SCORED = (
    "order_date",
    "customer_region",
    "channel",
    "dc_id",
    "plant_id",
    "sku_family",
    "units_ordered",
    "days_to_request",
    "late_risk_prob",
    "late_risk_flag",
    "actual_late",
)
SHOWN = ("order_id", "order_date", "customer_region", "plant_id", "dc_id", "sku_family")


@query
def late_label(labelled_orders) -> DataFrame:
    """Late label of every line that counts."""
    return labelled_orders.select("order_id", "order_date", "requested_delivery_date", "actual_delivery_date", "is_late")


@query
def late_class_balance(late_risk_features, as_of: Column, config: EngineConfig) -> DataFrame:
    """Training rows by label."""
    rows = late_risk_features.filter(~in_test_window(as_of, config))
    return rows.groupBy("is_late").agg(F.count(F.lit(1)).alias("row_count"))


@query
def train_test_split_counts(late_risk_features, as_of: Column, config: EngineConfig) -> DataFrame:
    """Rows and dates on either side of the time split."""
    side = F.when(in_test_window(as_of, config), "test").otherwise("train").alias("split")
    return late_risk_features.groupBy(side).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
    )


@query
def recent_scored_orders(order_late_risk_scored_ml, *, count=None) -> DataFrame:
    """Scored orders, newest first."""
    newest = F.col("order_date").desc()
    rest = [steady(c) if c == "late_risk_prob" else F.col(c) for c in SCORED[1:]]
    return top(order_late_risk_scored_ml.select(*SCORED, "order_id"), count, newest, "order_id", *rest).drop("order_id")


@query
def late_risk_top_orders(order_late_risk_scored_ml, *, count=25, above=None) -> DataFrame:
    """Orders most likely to be late, optionally only above a probability."""
    scored = order_late_risk_scored_ml
    if above is not None:
        scored = scored.filter(F.col("late_risk_prob") > above)
    ranked = top(scored, count, steady("late_risk_prob").desc(), *SHOWN)
    return ranked.select(
        *(F.col(c).alias("region") if c == "customer_region" else F.col(c) for c in SHOWN),
        shown("late_risk_prob", 3).alias("late_risk_prob"),
    )


@query
def late_risk_this_week(order_late_risk_scored_ml, as_of: Column, *, count=None) -> DataFrame:
    """Orders of today's week, likeliest to be late first."""
    week = order_late_risk_scored_ml.filter(week_of("order_date") == week_of(as_of))
    ranked = top(week, count, steady("late_risk_prob").desc(), *SHOWN)
    return ranked.select(*SHOWN, shown("late_risk_prob", 3).alias("late_risk_prob"))


@query
def high_risk_orders(order_late_risk_scored_ml, *, threshold=HIGH_RISK, count=None) -> DataFrame:
    """Orders at or above the threshold, newest first."""
    risky = order_late_risk_scored_ml.filter(F.col("late_risk_prob") >= threshold)
    order = [F.col("order_date").desc(), "order_id", steady("late_risk_prob").desc(), "customer_region", "sku_family"]
    ranked = top(risky, count, *order)
    return ranked.select("order_date", "customer_region", "sku_family", "late_risk_prob")


@query
def late_risk_hotspots_weekly(order_late_risk_scored_ml, *, count=None) -> DataFrame:
    """Mean risk by week, region and family, highest first."""
    means = order_late_risk_scored_ml.groupBy(
        week_of("order_date").alias("week"), "customer_region", "sku_family"
    ).agg(F.avg("late_risk_prob").alias("avg_late_risk"))
    return top(means, count, steady("avg_late_risk").desc(), "week", "customer_region", "sku_family")


@query
def risk_hotspots(order_late_risk_scored_ml, *, count=None) -> DataFrame:
    """Mean risk by region and family, highest first."""
    means = order_late_risk_scored_ml.groupBy("customer_region", "sku_family").agg(
        F.avg("late_risk_prob").alias("late_risk_prob")
    )
    return top(means, count, steady("late_risk_prob").desc(), "customer_region", "sku_family")


@query
def risk_summary(order_late_risk_scored_ml, *, threshold=HIGH_RISK) -> DataFrame:
    """Orders scored, orders at or above the threshold, mean and highest risk."""
    p = F.col("late_risk_prob")
    return order_late_risk_scored_ml.agg(
        F.count(F.lit(1)).alias("orders_scored"),
        F.count_if(p >= threshold).alias("high_risk_orders"),
        F.avg(p).alias("avg_risk"),
        F.max(p).alias("max_risk"),
    )


@query
def risk_histogram(order_late_risk_scored_ml, *, bins=20) -> DataFrame:
    """Orders per equal-width probability bin; the last bin includes 1."""
    bin_no = F.least(F.floor(F.col("late_risk_prob") * bins), F.lit(bins - 1)).cast("int")
    counted = order_late_risk_scored_ml.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("orders"))
    return counted.select("bin", (F.col("bin") / float(bins)).alias("bin_start"), "orders").orderBy("bin")
