"""Late-delivery risk: label, order-time features, logistic model, rule-based score."""

from __future__ import annotations

from math import ceil

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.config import EngineConfig
from haulcast.functions.calendar import since
from haulcast.operators.rules import not_cancelled
from haulcast.operators.silver import SIGNALS
from haulcast.workspace import dataset

CATEGORIES = ["customer_region", "channel", "plant_id", "dc_id", "sku_family"]
NUMBERS = ["units_ordered", "unit_price", "days_to_request", "dow", "woy", "month", *SIGNALS]

# Flag threshold; penalty strength and iteration limit of the model.
HIGH_RISK = 0.5
INVERSE_PENALTY = 1.0
MAX_ITERATIONS = 200

# Training rows that one task holds; they come laid out by date, which leaves the window to few tasks.
ROWS_A_TASK = 100_000

# Fixed values of the rule-based score: base, three surcharges, bounds.
RULE_BASE = 0.10
RULE_SHORT_NOTICE_DAYS, RULE_SHORT_NOTICE = 5, 0.18
RULE_LARGE_ORDER_UNITS, RULE_LARGE_ORDER = 50, 0.10
RULE_CHANNELS, RULE_CHANNEL = ("contractor", "DOT"), 0.08
RULE_LOWEST, RULE_HIGHEST = 0.01, 0.95


def late_label() -> Column:
    """1 if delivered after the requested date; a missing delivery counts as not late."""
    delivered = F.col("actual_delivery_date")
    return F.when(delivered.isNull(), 0).otherwise((delivered > F.col("requested_delivery_date")).cast("int"))


@dataset
def labelled_orders(silver_erp_orders: DataFrame) -> DataFrame:
    """Lines that count, with the late label."""
    return not_cancelled(silver_erp_orders).withColumn("is_late", late_label())


@dataset
def late_risk_features(
    labelled_orders: DataFrame, silver_external_signals: DataFrame, as_of: Column, config: EngineConfig
) -> DataFrame:
    """What is known when an order of the training window is placed, and its label."""
    signals = silver_external_signals.withColumnsRenamed({"week": "order_week", "region": "customer_region"})
    window = since("order_date", as_of, config.train_lookback_days) & (F.col("order_date") <= as_of)
    day = F.col("order_date")
    return (
        labelled_orders.filter(window)
        .join(signals, ["order_week", "customer_region"], "left")
        .select(
            "order_id",
            "order_date",
            "requested_delivery_date",
            *CATEGORIES,
            "units_ordered",
            "unit_price",
            *SIGNALS,
            "is_late",
            F.datediff("requested_delivery_date", day).cast("double").alias("days_to_request"),
            F.dayofweek(day).cast("double").alias("dow"),
            F.weekofyear(day).cast("double").alias("woy"),
            F.month(day).cast("double").alias("month"),
        )
    )


def in_test_window(as_of: Column, config: EngineConfig) -> Column:
    return since("order_date", as_of, config.test_days)


def model_inputs(features: DataFrame) -> DataFrame:
    """Numbers as double with 0 for anything missing or unreadable, categories with 'unknown'."""
    numbers = {c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0)) for c in NUMBERS}
    categories = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in CATEGORIES}
    shown = {"units": F.col("units_ordered"), "days": F.col("days_to_request")}
    return features.withColumns(shown).withColumns({**numbers, **categories})


def _pipeline(rows: int) -> Pipeline:
    indexed = [f"{c}_index" for c in CATEGORIES]
    hot = [f"{c}_hot" for c in CATEGORIES]
    return Pipeline(
        stages=[
            # "keep" gives unseen values an extra slot and dropLast removes it: they become all zeros.
            StringIndexer(inputCols=CATEGORIES, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
            VectorAssembler(inputCols=NUMBERS, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
            VectorAssembler(inputCols=[*hot, "scaled"], outputCol="features"),
            LogisticRegression(
                labelCol="is_late",
                standardization=False,
                regParam=1.0 / (INVERSE_PENALTY * rows),
                maxIter=MAX_ITERATIONS,
            ),
        ]
    )


def train(features: DataFrame) -> PipelineModel:
    """Fit on feature rows. Rows stay on the executors; only coefficients reach the driver.

    The inputs are dealt evenly and persisted while the stages pass over them; lost blocks are recomputed.
    """
    rows = model_inputs(features).filter(F.col("is_late").isNotNull())
    rows = rows.select(*CATEGORIES, *NUMBERS, "is_late")
    count = rows.count()
    if count == 0:
        raise ValueError("no labelled orders in the training window")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(count / ROWS_A_TASK))
    rows = rows.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _pipeline(count).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Late probability, flag and observed outcome of every feature row."""
    probability = vector_to_array("probability")[1]
    return as_scored(
        model.transform(model_inputs(features)).withColumns(
            {"late_risk_prob": probability, "units_ordered": F.col("units"), "days_to_request": F.col("days")}
        )
    )


def as_scored(frame: DataFrame) -> DataFrame:
    return frame.select(
        "order_id",
        "order_date",
        "customer_region",
        "channel",
        "dc_id",
        "plant_id",
        "sku_family",
        "units_ordered",
        "days_to_request",
        "late_risk_prob",
        (F.col("late_risk_prob") >= HIGH_RISK).cast("int").alias("late_risk_flag"),
        F.col("is_late").alias("actual_late"),
    )


@dataset
def late_risk_model(late_risk_features: DataFrame, as_of: Column, config: EngineConfig) -> PipelineModel:
    """The logistic model, fitted once per workspace on orders older than the test window."""
    return train(late_risk_features.filter(~in_test_window(as_of, config)))


@dataset
def order_late_risk_scored_ml(
    late_risk_model: PipelineModel, late_risk_features: DataFrame, as_of: Column, config: EngineConfig
) -> DataFrame:
    """Gold: recent orders scored by the logistic model."""
    return score(late_risk_model, late_risk_features.filter(since("order_date", as_of, config.lookback_days)))


@dataset
def late_risk_heuristic(late_risk_features: DataFrame, as_of: Column, config: EngineConfig) -> DataFrame:
    """Gold: recent orders scored by rule, for use where no model has been trained."""
    raw = (
        F.lit(RULE_BASE)
        + F.when(F.col("days_to_request") <= RULE_SHORT_NOTICE_DAYS, RULE_SHORT_NOTICE).otherwise(0.0)
        + F.when(F.col("units_ordered") >= RULE_LARGE_ORDER_UNITS, RULE_LARGE_ORDER).otherwise(0.0)
        + F.when(F.col("channel").isin(*RULE_CHANNELS), RULE_CHANNEL).otherwise(0.0)
    )
    bounded = F.least(F.lit(RULE_HIGHEST), F.greatest(F.lit(RULE_LOWEST), raw))
    recent = late_risk_features.filter(since("order_date", as_of, config.lookback_days))
    return as_scored(recent.withColumn("late_risk_prob", bounded))


@dataset
def late_risk_metrics(
    late_risk_model: PipelineModel, late_risk_features: DataFrame, as_of: Column, config: EngineConfig
) -> DataFrame:
    """Test AUC and accuracy of the logistic model, next to the late rate it was trained on."""
    held_out = in_test_window(as_of, config)
    labelled = late_risk_features.filter(F.col("is_late").isNotNull())
    scored = late_risk_model.transform(model_inputs(labelled.filter(held_out)))
    scored = scored.select(F.col("is_late").cast("double"), "rawPrediction", "prediction")
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        auc = BinaryClassificationEvaluator(labelCol="is_late", metricName="areaUnderROC", numBins=0).evaluate(scored)
        accuracy = MulticlassClassificationEvaluator(labelCol="is_late", metricName="accuracy").evaluate(scored)
    finally:
        scored.unpersist()
    return labelled.agg(
        F.lit(auc).alias("auc"),
        F.lit(accuracy).alias("accuracy"),
        F.avg(F.when(~held_out, F.col("is_late"))).alias("train_late_rate"),
        F.count_if(~held_out).alias("train_rows"),
        F.count_if(held_out).alias("test_rows"),
    )


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the model's coefficients in their order: one for each category value, then the numbers."""
    labels = model.stages[0].labelsArray
    return [*(f"{c}={v}" for c, values in zip(CATEGORIES, labels, strict=True) for v in values), *NUMBERS]


@dataset
def late_risk_gradient(
    late_risk_model: PipelineModel, late_risk_features: DataFrame, as_of: Column, config: EngineConfig
) -> DataFrame:
    """Slope of the model's penalised loss in every coefficient, as a magnitude: zero at the optimum.

    One aggregation over the training rows that knows nothing of how the model was fitted: the mean of residual times
    feature, plus the penalty's share. The intercept is not penalised.
    """
    fitted = late_risk_model.stages[-1]
    names, weights = feature_names(late_risk_model), fitted.coefficients.toArray().tolist()
    trained = late_risk_features.filter(~in_test_window(as_of, config) & F.col("is_late").isNotNull())
    rows = late_risk_model.transform(model_inputs(trained)).select(
        vector_to_array("features").alias("x"), (vector_to_array("probability")[1] - F.col("is_late")).alias("residual")
    )
    slopes = rows.agg(
        F.avg("residual").alias("intercept"),
        *(F.avg(F.col("residual") * F.col("x")[i]).alias(f"slope_{i}") for i in range(len(names))),
    )
    penalty = fitted.getRegParam()
    listed = [F.struct(F.lit("intercept").alias("feature"), F.abs("intercept").alias("gradient"))]
    listed += [
        F.struct(F.lit(n).alias("feature"), F.abs(F.col(f"slope_{i}") + penalty * w).alias("gradient"))
        for i, (n, w) in enumerate(zip(names, weights, strict=True))
    ]
    return slopes.select(F.inline(F.array(*listed)))


@dataset
def late_risk_heuristic_metrics(late_risk_heuristic: DataFrame) -> DataFrame:
    """Exact AUC of the rule-based score by rank sums, its accuracy and the late rate, over the scored orders.

    The running count goes over distinct scores; the rule has three surcharges, so there are eight at most.
    """
    scored = late_risk_heuristic.filter(F.col("actual_late").isNotNull())
    by_score = scored.groupBy("late_risk_prob").agg(
        F.sum(F.col("actual_late").cast("long")).alias("late"),
        F.sum((1 - F.col("actual_late")).cast("long")).alias("on_time"),
        F.count_if(F.col("late_risk_flag") == F.col("actual_late")).alias("right"),
    )
    lower = Window.orderBy("late_risk_prob").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_score.withColumn("below", F.coalesce(F.sum("on_time").over(lower), F.lit(0)))
    won = F.sum(F.col("late") * (F.col("below") + F.col("on_time") / 2.0))
    late, on_time = F.sum("late"), F.sum("on_time")
    return ranked.agg(
        F.try_divide(won, late * on_time).alias("auc"),
        F.try_divide(F.sum("right"), late + on_time).alias("accuracy"),
        F.try_divide(late, late + on_time).alias("late_rate"),
        (late + on_time).alias("orders_scored"),
    )
