"""One query for each operator, over the whole of its table with production parameters, and the SQL that checks it."""

from __future__ import annotations

import string
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from haulcast.llm import dom_marginals, log_bilinear, merkle_manifest, positive_unlabelled
from haulcast.llm.best_fit_packing import best_fit_packing
from haulcast.llm.chat_format import chat_format, read_back
from haulcast.llm.embedding_near_dedup import embedding_near_dedup
from haulcast.llm.licence_scan import licence_scan
from haulcast.llm.ngram_jaccard_join import ngram_jaccard_join
from haulcast.llm.robust_outliers import robust_outliers
from haulcast.llm.sequence_files import read_documents, write_sequences
from haulcast.llm.storage import new_path, publish
from haulcast.llm.systematic_mix import systematic_mix
from haulcast.llm.tokenizer_alignment import tokenizer_alignment

SQL = Path(__file__).with_name("sql")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_only(modulus: int, remainder: int) -> Column:
    """Whether a row is held out of training, by crc32 of its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op1_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the sequence files it was written to."""
    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    files = write_sequences(table(spark, sf_dir, "documents"), new_path(spark, "sequences"), tokenizer, by_words=True)
    return read_documents(files)


def op2_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of a mix with source weights 5, 2, 1 in turn."""
    mixed = systematic_mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model trained on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = scored_only(7, 2)
    scored = log_bilinear.score(docs, log_bilinear.train(docs, ~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, and whether it is kept by the base rules and the robust distance."""
    return robust_outliers(table(spark, sf_dir, "documents"), carried=["doc_id"]).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op5_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages")
    return dom_marginals.extract(pages, dom_marginals.train(dom_marginals.labelled_pages(pages)))


def op6_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels whose crc32 remainder is 1 are never read."""
    docs = table(spark, sf_dir, "documents")
    model = positive_unlabelled.train(docs, table(spark, sf_dir, "labels"), ~scored_only(3, 1))
    scored = positive_unlabelled.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        scored_only(3, 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class and number of links: five-word n-grams, similarity 0.8."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.9, and its component."""
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence families and the paragraphs that name them."""
    return licence_scan(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a bin of 2048 words."""
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and the root that proof leads to; every fifth document is presented in lower case."""
    docs = table(spark, sf_dir, "documents")
    capitals = string.ascii_uppercase
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    presented = F.when(altered, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    fields = [F.col(c) for c in merkle_manifest.FIELDS]
    own = merkle_manifest.leaf_digest(fields).alias("leaf")
    other = F.when(altered, merkle_manifest.leaf_digest([*fields[:-1], presented])).alias("presented")
    manifest = merkle_manifest.build(docs.select("doc_id", "source", own, other))
    proved = merkle_manifest.prove(manifest)
    subroots = manifest.trees.select("tree", F.col("digest").alias("subroot"))
    root = F.lit(manifest.root).cast("string")
    found = proved.join(subroots, "tree").select(
        "doc_id",
        "leaf",
        "subroot",
        root.alias("root"),
        merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle_manifest.fold(F.coalesce("presented", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, as read back from the strings and masks it was written as."""
    tricky = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        (F.floor(F.col("id") / 2) - 1).alias("conv_id"),  # -1, not as a literal: joins keep it as a key
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    read = read_back(publish(chat_format(turns.unionByName(own)), "chats"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between its byte-level and its sentence-piece tokens."""
    byte_json = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    pieces = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return tokenizer_alignment(table(spark, sf_dir, "documents"), byte_json, public_tokenizers.PATTERN, pieces)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return operators | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {path.stem: path.read_text() for path in sorted(SQL.glob("*.sql"))}
