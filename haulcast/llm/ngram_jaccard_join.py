"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. One pass over whole texts makes each document's n-gram set, a 128-bit fingerprint of it, and band hashes.
2. Documents with equal sets form a class; only one document of each goes on, so copies never meet each other.
3. Classes that share a band hash are connected to candidate clusters by integers alone.
4. Only documents of a cluster are read again. Their n-gram sets go once to the task that holds their cluster (a
   large cluster is cut into tiles by set size and hash) and a tile's intersections are counted by matrix products.
   No pair of documents is ever a row: a task returns each document's number of links and a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.components import components
from haulcast.llm.storage import publish
from haulcast.llm.words import blocks, hashes, word_codes

MOST_HASHES = 240  # MinHash values a document
TILE = 1024  # documents a side of a tile
COLUMNS = 4096  # n-grams a matrix product counts at once
STEP = 1024  # n-grams hashed at once
SALTS = 32  # parts in which the documents of one level of a large cluster meet its figures


def banding(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: as many rows as fit while a pair at ``similarity`` shares a band with chance ``recall``."""
    fits = []
    for rows in range(1, most + 1):
        bands = ceil(log(1 - recall) / log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows <= most:
            fits.append((bands, rows))
    if not fits:
        raise ValueError("no banding of that recall within the number of hashes")
    return fits[-1]


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's n-grams of words as sorted distinct 64-bit hashes; a shorter text is one n-gram, no word gives none."""
    codes, distinct, bounds = word_codes(texts)
    word = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    gram = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n if len(gram) else 0):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[i : i + len(gram)]
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    sets = []
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= n:
            sets.append(np.unique(gram[start : end - n + 1]))
        else:
            whole = word[start:end].tobytes()
            sets.append(np.array([xxhash.xxh3_64_intdigest(whole, seed=n)] if whole else [], np.uint64))
    return sets


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    digest = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
    return int(digest[0]), int(digest[1])


def minhash(grams: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    low = (grams ^ (grams >> np.uint64(31))).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), STEP):
        part = factor[:, None] * low[None, i : i + STEP]
        part += shift[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """A row for each document: its n-gram count, fingerprint and band hashes (null where it has no word)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        for whole in batches:
            for batch in blocks(whole):
                sizes, first, second, hashed = [], [], [], []
                for grams in ngram_sets(batch.column("text"), n):
                    sizes.append(len(grams))
                    one, two = fingerprint(grams) if len(grams) else (None, None)
                    first.append(one)
                    second.append(two)
                    if len(grams):
                        least = minhash(grams, factor, shift).reshape(bands, rows).astype(np.uint64)
                        key = ((least + np.uint64(1)) * mix).sum(axis=1, dtype=np.uint64) + salt
                        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                        hashed.append((key ^ (key >> np.uint64(27))).view(np.int64))
                    else:
                        hashed.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_key"),
                        pa.array(sizes, pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(second, pa.int64()),
                        pa.array(hashed, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_grams", "fp1", "fp2", "bands"],
                )

    return docs.mapInArrow(sign, "doc_id long, text_key long, n_grams long, fp1 long, fp2 long, bands array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, exactly, by products of 0/1 matrices over columns of shared members."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((k, k), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((k, COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - start] = 1
        common += part @ part.T
    return common


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets link; a set does not link with itself."""
    common = shared_counts(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets], np.float64)
    link = common / (sizes[:, None] + sizes[None, :] - common) >= similarity
    np.fill_diagonal(link, False)
    return link


def smallest_reachable(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row it reaches."""
    label = np.arange(len(link))
    while True:
        near = np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link))
        next_ = np.minimum(label, near)
        next_ = next_[next_]
        if (next_ == label).all():
            return label
        label = next_


def verify_tiles(n: int, similarity: float):
    """Grouped step: all clusters or the one tile of a group; in and out are rows of documents, never of pairs."""

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("row").sort_values(["cluster", "row"]).reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"]]
        row, copies, side = group["row"].to_numpy(), group["copies"].to_numpy(), group["side"].to_numpy()
        links, label = np.zeros(len(group), np.int64), row.copy()
        cluster = group["cluster"].to_numpy()
        starts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]]) if len(group) else np.zeros(0, int)
        for start, end in zip(starts, np.r_[starts[1:], len(group)]):
            here = slice(int(start), int(end))
            link = linked(sets[here], similarity)
            if side[start] >= 0:  # two blocks of a large cluster: only links between them count here
                link &= side[here][:, None] != side[here][None, :]
            links[here] = link @ copies[here]
            label[here] = row[here][smallest_reachable(link)]
        return pd.DataFrame({"row": row, "links": links, "label": label})

    return verify


def ngram_jaccard_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row of ``docs(doc_id, text)``.

    Two rows link if the Jaccard similarity of their sets of word n-grams is at least ``similarity``; a text of fewer
    than ``n`` words has one n-gram, all its words. ``n_links`` counts the other rows linked directly, ``class_id`` is
    the smallest doc_id reachable by links. A null or wordless text links with nothing and is its own class. Repeated
    rows are copies of each other; null doc_ids take part, and name a class only if it has no other id. Columns other
    than the two are not read. An empty table gives an empty result.
    """
    bands, rows = banding(similarity, recall)
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    signed = signatures(texts, n, bands, rows).withColumn("row", F.monotonically_increasing_id())
    signed = publish(signed, "signatures")

    classes = (
        signed.where("fp1 is not null")
        .groupBy("fp1", "fp2")
        .agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    )
    classes = publish(classes, "classes")
    chosen = signed.join(classes.select("row", "copies", "least_id"), "row")
    member = chosen.select("row", F.explode("bands").alias("band"))
    bucket = member.groupBy("band").agg(F.min("row").alias("b"), F.max("row").alias("last")).where("b < last")
    near = member.join(bucket.select("band", "b"), "band").where("row <> b").select(F.col("row").alias("a"), "b")
    cluster = components(near).select(F.col("node").alias("row"), F.col("component").alias("cluster"))

    candidate = publish(chosen.drop("bands").join(cluster, "row"), "candidates")
    tiles = _tiles(candidate, similarity)
    found = publish(_sets(texts, tiles, n).groupBy("tile").applyInPandas(
        verify_tiles(n, similarity), "row long, links long, label long"
    ), "verified")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    group = components(found.where("row <> label").select(F.col("row").alias("a"), F.col("label").alias("b")))

    known = classes.join(links, "row", "left").join(group.withColumnRenamed("node", "row"), "row", "left")
    known = known.withColumn("component", F.coalesce("component", "row"))
    name = known.groupBy("component").agg(F.min("least_id").alias("class_id"))
    known = known.join(name, "component").select(
        "fp1", "fp2", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed.join(known, ["fp1", "fp2"], "left").select(
        "doc_id",
        F.when(F.col("fp1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _tiles(candidate: DataFrame, similarity: float) -> DataFrame:
    """Which tiles each candidate goes to, as ``tile, side`` columns; side -1 means all links of the tile count.

    Clusters up to the tile size are dealt whole. A larger one is cut by set size into levels a factor of the
    similarity apart (sets two levels apart can't link) and each level by hash into blocks; blocks meet pairwise.
    """
    sized = candidate.withColumn("level", F.floor(F.log(F.col("n_grams")) / -F.log(F.lit(similarity) - 1e-9)).cast("long"))
    level = sized.groupBy("cluster", "level").agg(F.count(F.lit(1)).alias("members"))
    level = publish(level, "levels")
    total = level.groupBy("cluster").agg(F.sum("members").alias("total"))
    level = level.join(total, "cluster").select(
        "cluster", "level", "total", F.ceil(F.col("members") / (TILE // 2)).alias("blocks")
    )
    n_groups = max(1, candidate.count() // TILE)
    at = lambda tile, side: F.struct(tile.alias("tile"), side.cast("long").alias("side"))
    columns = ["doc_id", "text_key", "fp1", "fp2", "row", "copies", "cluster"]
    group = F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(n_groups)).cast("string"))
    small = sized.join(total, "cluster").where(F.col("total") <= TILE)
    small = small.select(*columns, F.array(at(group, F.lit(-1))).alias("at"))

    large = level.where(F.col("total") > TILE)
    above = large.select("cluster", (F.col("level") - 1).alias("level"), F.col("blocks").alias("above"))
    below = large.select("cluster", (F.col("level") + 1).alias("level"), F.col("blocks").alias("below"))
    large = large.join(above, ["cluster", "level"], "left").join(below, ["cluster", "level"], "left")
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    number = lambda level, block: F.concat_ws(".", level.cast("string"), block.cast("string"))
    mine = number(F.col("level"), F.col("block"))

    def meets(other_level, count, order):
        others = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))
        return F.transform(others, lambda o: order(number(other_level, o), o))

    def pair(a, b, side):
        return at(F.concat_ws("-", F.lit("t"), F.col("cluster").cast("string"), a, b), F.lit(side))

    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.lit("salt"), "row"), F.lit(SALTS)).cast("int")
    cut = sized.withColumn("salt", salt).join(large, ["cluster", "level", "salt"]).withColumn("block", own)
    same = meets(
        F.col("level"),
        F.col("blocks"),
        lambda name, o: F.when(o < F.col("block"), pair(name, mine, 1))
        .when(o > F.col("block"), pair(mine, name, 0))
        .otherwise(pair(mine, mine, -1)),
    )
    up = meets(F.col("level") + 1, F.coalesce("above", F.lit(0)), lambda name, o: pair(mine, name, 0))
    down = meets(F.col("level") - 1, F.coalesce("below", F.lit(0)), lambda name, o: pair(name, mine, 1))
    return small.unionByName(cut.select(*columns, F.concat(same, up, down).alias("at")))


def _sets(texts: DataFrame, tiles: DataFrame, n: int) -> DataFrame:
    """The candidates' n-gram sets, made again from their texts, at every tile they go to."""
    wanted = tiles.withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"})
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))
    kept_columns = ["row", "copies", "cluster", "at"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                sets = ngram_sets(batch.column("text"), n)
                made = [fingerprint(s) for s in sets]
                want = zip(batch.column("fp1").to_pylist(), batch.column("fp2").to_pylist())
                kept = pa.array([a == b for a, b in zip(made, want)], pa.bool_())
                out = [batch.column(c) for c in kept_columns] + [pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [*kept_columns, "grams"]).filter(kept)

    read = texts.join(wanted, same).select("text", "fp1", "fp2", *kept_columns)
    schema = "row long, copies long, cluster long, at array<struct<tile:string,side:long>>, grams binary"
    made = read.mapInArrow(again, schema).withColumn("at", F.explode("at"))
    return made.select("row", "copies", "cluster", "grams", "at.tile", "at.side")
