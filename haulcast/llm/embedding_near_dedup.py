"""Embedding near-dedup: int8 tile products with rigorous error bounds; doubtful pairs again in double precision.

A unit vector u is kept as u = s q + e with integers q of one byte, a scale s and the exact norm of e. Then
u.v = s t (q.r) + rest with |rest| <= |e| |t r| + |s q| |f| + |e| |f|, so most pairs are decided by the integer
product alone; only pairs that may reach the threshold are computed again from the vectors themselves.

Vectors of equal components are first taken together. The rest is dealt by hash into blocks, every two blocks meet in
one task, and a task returns numbers of links and a spanning set of links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.components import components
from haulcast.llm.storage import publish

BLOCK = 8192  # vectors a side of a task's tile
TILE = 1024  # vectors a side of one product
SLACK = 1e-9  # above all rounding of doubles in the bound
EXACT_WIDTH = 1024  # widest integer product that a float holds exactly: 1024 * 127 * 127 < 2 ** 24


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integers, scales, norms of scaled integers and norms of the errors, for unit vectors in double precision."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1) + SLACK, np.linalg.norm(unit - back, axis=1) + SLACK


def integer_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of int8 vectors: float products of slices in which every sum is an exact integer."""
    out = np.zeros((len(a), len(b)), np.float64)
    for i in range(0, a.shape[1], EXACT_WIDTH):
        out += a[:, i : i + EXACT_WIDTH].astype(np.float32) @ b[:, i : i + EXACT_WIDTH].astype(np.float32).T
    return out


class Block:
    """The vectors of one side of a tile, with their quantised form."""

    def __init__(self, rows: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.rows, self.copies = rows, copies
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors, self.norms = vectors, np.linalg.norm(vectors, axis=1)
        self.q, self.scale, self.size, self.error = quantise(self.unit)
        self.links = np.zeros(len(rows), np.int64)


def pairs_of(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions in both blocks, a small tile at a time; each pair of one block once."""
    for i in range(0, len(a.rows), TILE):
        x = slice(i, i + TILE)
        for j in range(i if same else 0, len(b.rows), TILE):
            y = slice(j, j + TILE)
            product = integer_product(a.q[x], b.q[y])
            product *= a.scale[x, None]
            product *= b.scale[None, y]
            bound = a.error[x, None] * (b.size + b.error)[None, y] + a.size[x, None] * b.error[None, y]
            bound += product
            maybe = bound >= threshold - SLACK
            if same and i == j:
                maybe &= np.tri(*maybe.shape, -1, dtype=bool).T
            left, right = np.nonzero(maybe)
            if len(left):
                left, right = left + i, right + j
                dot = np.einsum("ij,ij->i", a.vectors[left], b.vectors[right])
                link = dot / (a.norms[left] * b.norms[right]) >= threshold
                yield left[link], right[link]


def united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linking x[i] with y[i]: everything that links reach has the smallest label among it.

    Pairs whose ends agree drop out; each pass links the labels of the rest and follows them to their ends.
    """
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def tile_links(threshold: float):
    """Grouped step over one tile: rows of two blocks (side 0 and 1), or of one block met with itself (side 0 only)."""

    def find(group: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for _, part in group.sort_values(["side", "row"]).groupby("side"):
            vectors = np.vstack([np.asarray(v, np.float64) for v in part["embedding"]])
            blocks.append(Block(part["row"].to_numpy(), part["copies"].to_numpy(), vectors))
        a, b = blocks[0], blocks[-1]
        same = len(blocks) == 1
        if same and group["other"].iloc[0]:  # the block it should meet is empty
            return pd.DataFrame({"row": a.rows, "links": a.links, "label": a.rows})
        rows = np.concatenate([z.rows for z in blocks])
        order = np.argsort(rows)
        rank = np.empty(len(rows), np.int64)  # labels are ranks of rows, so the smallest row names a class
        rank[order] = np.arange(len(rows))
        of_a, of_b = rank[: len(a.rows)], rank[-len(b.rows) :]
        label = np.arange(len(rows))
        for left, right in pairs_of(a, b, threshold, same):
            np.add.at(a.links, left, b.copies[right])
            np.add.at(b.links, right, a.copies[left])
            label = united(label, of_a[left], of_b[right])
        links = np.concatenate([z.links for z in blocks])
        return pd.DataFrame({"row": rows, "links": links, "label": rows[order[label[rank]]]})

    return find


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``.

    Two rows link if their cosine in double precision is at least ``threshold`` (above 0). A null, empty or zero
    vector, or one with a null or non-finite component, links with nothing, nor do vectors of different lengths with
    each other. Repeated rows are vectors of their own. ``component_id`` is the smallest vec_id reachable by links.
    Null ids take part and name a component only if it has no other id; such a row is kept if it is alone. Columns
    other than the two are not read; an empty table gives an empty result.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(
        F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0) & (F.size("embedding") > 0), F.lit(False)
    )
    given = given.withColumn("usable", usable)
    classes = (
        given.where("usable")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    classes = publish(classes.withColumn("width", F.size("embedding")), "distinct-vectors")
    width = classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length of vector
    parts = F.create_map([F.lit(x) for r in width for x in (r["width"], ceil(r["n"] / block))]) if width else F.lit(None)
    dealt = classes.withColumn("parts", parts[F.col("width")].cast("long") if width else F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("row"), F.col("parts"))
    dealt = dealt.withColumn("part", own).withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = dealt.select(
        "row",
        "copies",
        "embedding",
        F.concat_ws("-", "width", F.least("part", "meets"), F.greatest("part", "meets")).alias("tile"),
        F.when(F.col("part") <= F.col("meets"), 0).otherwise(1).alias("side"),
        (F.col("part") != F.col("meets")).alias("other"),
    )
    found = tiles.groupBy("tile").applyInPandas(tile_links(threshold), "row long, links long, label long")
    found = publish(found, "tile-links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    group = components(found.where("row <> label").select(F.col("row").alias("a"), F.col("label").alias("b")))
    known = classes.join(links, "row").join(group.withColumnRenamed("node", "row"), "row", "left")
    known = known.withColumn("component", F.coalesce("component", "row"))
    name = known.groupBy("component").agg(F.min("least_id").alias("least"))
    known = known.join(name, "component").select(
        "embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id")
    )
    joined = given.withColumn("key", F.when(F.col("usable"), F.col("embedding"))).join(
        known.withColumnRenamed("embedding", "key"), "key", "left"
    )
    named = joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return named.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
