"""The corpus pipeline end to end on a small table with nulls, repeated rows, and columns of clashing and dotted names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haulcast.llm.storage import new_path

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ran", "vel", "sto") for c in ("", "ne", "rit", "gos")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, score string, size long, row string, key string"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(w.capitalize() + "," if i % 9 == 0 else w for i, w in enumerate(rng.choice(WORDS, n)))


def as_row(doc_id, text, source="s0", extra="x"):
    return (doc_id, text, "en", source, None if text is None else len(text), extra, "s", 7, "r", "k")


@pytest.fixture(scope="module")
def table(spark):
    rows = [as_row(i, prose(i, 120 + i % 40), f"s{i % 3}") for i in range(150)]
    rows += [as_row(300 + i, "### $$ %% " * 40, "s0") for i in range(40)]  # junk, fails the base rules
    rows += [as_row(400 + i, prose(i, 120 + i % 40) + " end", f"s{i % 3}") for i in range(10)]  # near copies
    rows += [as_row(5, prose(5, 125), "s2"), as_row(5, prose(5, 125), "s2"), as_row(None, prose(700, 130), None), as_row(None, None, None), as_row(901, "", "s1")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, table):
    path = str(tmp_path_factory.mktemp("tables"))
    table.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 150, 2)] + [(300 + i, 0, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def run_stages(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_one_by_one(spark, table, folder):
    out = run_stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    for name in ("quality_rules", "quality_classifier", "near_duplicates", "source_mix"):
        assert out[name].columns == table.columns, name
    ids = {name: sorted(r.doc_id for r in frame.where("doc_id is not null").collect()) for name, frame in out.items()}
    clean = [*range(150), *range(400, 410), 5, 5]
    assert ids["quality_rules"] == sorted(clean) and out["quality_rules"].where("doc_id is null").count() == 1
    scored = set(ids["quality_classifier"])
    assert scored <= set(clean) and len(scored) > 0.9 * len(set(clean))  # 75 positives are a small sample
    # of each group of copies the one with the smallest id stays; a row without an id that is near nothing stays too
    assert ids["near_duplicates"] == sorted({i - 400 if i >= 400 and i - 400 in scored else i for i in scored})
    nameless = lambda name: out[name].where("doc_id is null").count()
    assert nameless("near_duplicates") == nameless("quality_classifier")
    mixed = out["source_mix"].groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r.source for r in mixed} <= {"s0", "s1", "s2", None}
    words = lambda frame: frame.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    packed = out["packing"]
    assert packed.agg(F.sum("n_words")).first()[0] == words(out["source_mix"])
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.n_words for r in held) <= 2048 for held in bins.values())


def test_stages_of_an_empty_table(spark, table, folder):
    out = run_stages(spark, table.where("false"), folder)
    assert all(frame.count() == 0 for frame in out.values())
