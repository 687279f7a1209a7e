"""The corpus pipeline: quality rules, quality classifier, near duplicates, mixing, packing, one operator each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.llm import positive_unlabelled
from haulcast.llm.best_fit_packing import best_fit_packing
from haulcast.llm.ngram_jaccard_join import ngram_jaccard_join
from haulcast.llm.robust_outliers import robust_outliers
from haulcast.llm.storage import new_path, publish
from haulcast.llm.systematic_mix import repeated, systematic_mix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither fail the base rules nor lie far out of their language and source."""
    return robust_outliers(docs).where("kept").select("doc.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of 0.5 or more, by a model of the labels and of the rows that came this far.

    All columns stay, whatever their names; a null text scores as an empty one, repeated rows score alike.
    """
    model = positive_unlabelled.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score = "_".join(["score", *docs.columns])  # no column has this name
    return positive_unlabelled.score(docs, model, score).where(F.col(f"`{score}`") >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id, or one without an id if the class has no other.

    Rows are told apart by a key of their own, so repeated and null ids lose no class and keep no copy.
    """
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    given = publish(given.withColumn("key", F.monotonically_increasing_id()), "numbered")
    classes = ngram_jaccard_join(given.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text")))
    known = given.select("key", F.col("doc.doc_id").alias("id")).join(classes.withColumnRenamed("doc_id", "key"), "key")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first")
    kept = known.groupBy("class_id").agg(first).select("first.key")
    return given.join(kept, "key", "left_semi").select("doc.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return repeated(systematic_mix(docs)).select(*(f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its bin."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

ORACLE_SQL = None  # estimates and models are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
