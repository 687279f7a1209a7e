"""Merkle manifest of a table: a content-addressed tree of digests, and inclusion proofs found by descent from its root.

Every row is a leaf. The leaves of a source ascend by doc_id and are folded 16 at a time into that source's subroot; the
subroots, by source, are folded likewise into the root. The tree is kept as records ``digest, children``, one for each
distinct digest. Proofs descend from the root: a request's rank, written in base 16, says which child it takes at each
level; the children it does not take are its siblings, and the path collected on the way down is reversed at the end.
Requests that share a way travel as one row until they part, so the levels above the leaves cost a sixteenth each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.storage import publish

BITS = 4
FANOUT = 1 << BITS
HEX = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields, each as its UTF-8 byte count, a colon and its value, or as ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(
        F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256
    )


def height(n: Column) -> Column:
    """Levels above n leaves, 0 for a lone leaf."""
    return reduce(Column.__add__, ((n > F.lit(FANOUT**k)).cast("int") for k in range(63 // BITS)))


def ranked(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` and each one's ``rank`` within its group, from 0: a range sort and a running sum over its partitions.

    A group may span many partitions, so no task holds one whole; the running sum sees one row for each partition and
    group. ``order`` should tell equal rows apart, else they can't be dealt to several partitions.
    """
    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = publish(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    placed = ranged.join(runs.select(group, "part", shift.alias("shift")), [group, "part"])
    return placed.withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: what was given, with ``tree`` (number of the source) and ``rank``; ``store``: ``digest, children``;
    ``trees``: ``tree, source, n, digest`` of every source; ``top``: the root's row, none for an empty table."""

    leaves: DataFrame
    store: DataFrame
    trees: DataFrame
    top: DataFrame
    root: str | None
    n_trees: int
    tallest: int


def _fold(nodes: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Records of every level above ``nodes(tree, at, n, digest)``, and the top node of every tree."""
    records, tops = [], [nodes.where("n = 1").select("tree", "digest")]
    for _ in range(levels):
        runs = nodes.where("n > 1").groupBy("tree", F.shiftright("at", BITS).alias("at"))
        nodes = runs.agg(
            F.ceil(F.first("n") / FANOUT).alias("n"),
            F.sort_array(F.collect_list(F.struct("at", "digest"))).getField("digest").alias("children"),
        ).withColumn("digest", F.sha2(F.array_join("children", ""), 256))
        nodes = publish(nodes, name)
        records.append(nodes.select("digest", "children"))
        tops.append(nodes.where("n = 1").select("tree", "digest"))
    return records, tops


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves(doc_id, source, leaf, ...)``; other columns are carried unless named ``tree, rank, row, size``.

    Sources ascend by their UTF-8 bytes, null first; leaves by doc_id, null first, then by digest, so repeated rows are
    leaves side by side. An empty table has no root.
    """
    given = publish(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    sources = given.groupBy("source").agg(F.count(F.lit(1)).alias("size")).withColumn("all", F.lit(0))
    sources = publish(
        ranked(sources, "all", [F.col("source").asc_nulls_first()], "sources").select(
            F.col("rank").alias("tree"), F.col("source").alias("named"), "size"
        ),
        "trees",
    )
    n_trees, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    of_source = F.col("source").eqNullSafe(F.col("named"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    placed = publish(ranked(given.join(sources, of_source).drop("named"), "tree", order, "ordered").drop("row"), "placed")
    tallest = sum(largest > FANOUT**k for k in range(63 // BITS))
    base = placed.select("tree", F.col("rank").alias("at"), F.col("size").alias("n"), F.col("leaf").alias("digest"))
    records, tops = _fold(base, tallest, "level")
    subroots = publish(reduce(DataFrame.unionByName, tops), "subroots")
    above = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).alias("n"), "digest")
    more, top = _fold(above, sum(n_trees > FANOUT**k for k in range(63 // BITS)), "source-level")
    top = publish(reduce(DataFrame.unionByName, top), "top")
    root = top.first()
    empty = given.select(F.col("leaf").alias("digest"), F.array("leaf").alias("children")).limit(0)
    store = reduce(DataFrame.unionByName, [*records, *more, empty]).groupBy("digest").agg(F.first("children").alias("children"))
    trees = sources.join(subroots, "tree").select("tree", F.col("named").alias("source"), F.col("size").alias("n"), "digest")
    return Manifest(placed, publish(store, "store"), publish(trees, "subroots"), top, root and root["digest"], n_trees, tallest)


def _step(nodes: DataFrame, store: DataFrame) -> DataFrame:
    """``nodes(tree, at, left, digest, path)`` one level further down: a row for each child, with its siblings on its path."""
    down = nodes.join(store, "digest").select("tree", "at", "left", "path", "children", F.posexplode("children").alias("digit", "child"))
    return down.select(
        "tree",
        (F.shiftleft("at", BITS) + F.col("digit")).alias("at"),
        (F.col("left") - 1).alias("left"),
        F.col("child").alias("digest"),
        F.concat("path", F.array(_siblings(F.col("children"), F.col("digit")))).alias("path"),
    )


def _siblings(children: Column, digit: Column) -> Column:
    """A segment of a path: the place of the taken child, and the digests of the others end to end."""
    others = F.array_join(F.filter(children, lambda _, i: i != digit), "")
    return F.struct(digit.cast("int").alias("digit"), others.alias("others"))


def _descend(nodes: DataFrame, store: DataFrame, levels: int, stop: int) -> DataFrame:
    """Every node with more than ``stop`` levels below it replaced by its descendants that have ``stop``."""
    for left in range(levels, stop, -1):
        nodes = publish(nodes.where(F.col("left") < left).unionByName(_step(nodes.where(F.col("left") == left), store)), "descent")
    return nodes


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``requests`` (rows of ``manifest.leaves``; all by default) with ``proof``, the segments from the leaf up to the root.

    A segment is ``digit, others``: the request's place among its siblings, and their digests from left to right.
    """
    rows = manifest.leaves if requests is None else requests
    levels = sum(manifest.n_trees > FANOUT**k for k in range(63 // BITS))
    nothing = F.array().cast("array<struct<digit:int,others:string>>")
    none = F.lit(0).cast("long")
    start = manifest.top.select(none.alias("tree"), none.alias("at"), F.lit(levels).alias("left"), "digest", nothing.alias("path"))
    wanted = None if requests is None else requests.select("tree").distinct()
    subroots = _descend(start, manifest.store, levels, 0).select(F.col("at").alias("tree"), "digest", "path")
    if wanted is not None:
        subroots = subroots.join(wanted, "tree", "left_semi")
    sizes = manifest.trees.select("tree", height(F.col("n")).alias("left"))
    nodes = subroots.join(sizes, "tree").select("tree", F.lit(0).cast("long").alias("at"), "left", "digest", "path")
    last = _descend(nodes, manifest.store, manifest.tallest, 1)
    kept = F.col("left") == 1
    runs = last.where(kept).join(manifest.store, "digest").unionByName(last.where(~kept).withColumn("children", F.array("digest")))
    runs = runs.select("tree", F.col("at").alias("run"), "left", "path", "children")
    asked = rows.withColumn("run", F.shiftright("rank", BITS))
    found = asked.join(runs, ["tree", "run"])
    down = F.when(
        F.col("left") == 1, F.concat("path", F.array(_siblings(F.col("children"), F.col("rank").bitwiseAND(FANOUT - 1))))
    ).otherwise(F.col("path"))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.reverse(down).alias("proof"))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["others"]), ""), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""

    def up(below: Column, segment: Column) -> Column:
        split = segment["digit"] * HEX
        left, right = F.substring(segment["others"], F.lit(1), split), F.substring(segment["others"], split + 1, F.lit(FANOUT * HEX))
        return F.sha2(F.concat(left, below, right), 256)

    return F.aggregate(proof, digest, up)
