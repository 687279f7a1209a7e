"""Best-fit packing under conflicts: bins in order of residual, each with bitmaps of its sources and duplicate clusters.

Documents are dealt by hash to groups of about the same number of words; a group is one task's work, and its size does
not grow with the corpus. In a group, pieces come by falling size. The search starts at the smallest residual that
holds the piece and goes on to the successor until the tightest compatible bin is found; a full bin leaves the order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.storage import publish
from haulcast.llm.words import n_words

CAPACITY = 2048  # words a bin
PER_SOURCE = 4  # pieces of one source a bin may hold
GROUP_WORDS = 1 << 19  # words a group is meant to hold


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, per_source: int):
    """``bin, start`` of each piece, pieces in the order given. Sources and clusters are small integers of the group.

    A bin holds a bitmap of clusters and ``per_source`` bitmaps of sources: the k-th marks what it holds k times.
    """
    order: list[tuple[int, int]] = []  # (residual, bin)
    clusters: list[int] = []
    sources: list[list[int]] = []
    bins, starts = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    last, tightest = None, (0, -1)
    for i, (need, s, c) in enumerate(zip(size.tolist(), source.tolist(), cluster.tolist())):
        s_bit, c_bit = 1 << s, 1 << c if c >= 0 else 0
        # For a piece like the one before, bins passed over then still conflict, and none has come among them since.
        at = bisect_left(order, tightest if (need, s, c) == last else (need, -1))
        while at < len(order):
            b = order[at][1]
            if not clusters[b] & c_bit and not sources[b][-1] & s_bit:
                break
            at += 1
        if at < len(order):
            tightest = residual, b = order.pop(at)
        else:
            residual, b = tightest = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        last = (need, s, c)
        bins[i], starts[i] = b, capacity - residual
        clusters[b] |= c_bit
        for level, held in enumerate(sources[b]):
            if not held & s_bit:
                sources[b][level] = held | s_bit
                break
        if residual > need:
            insort(order, (residual - need, b))
    return bins, starts


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """``doc_id, row, piece, n_words, bin_id, start`` for every piece of every row of ``docs(doc_id, text, source)``.

    A document of more than ``capacity`` words is cut into full pieces and a rest, so every word is packed once.
    No bin holds two pieces of one duplicate cluster (texts equal up to white space and case) nor more than
    ``per_source`` of a source; pieces of one document conflict with each other too. Null and wordless texts are one
    piece of 0 words and belong to no cluster. A null source is a source of its own. ``row`` numbers the rows, so that the
    pieces of repeated ids can be told apart; a null id is carried. Other columns are not read; an empty table gives no rows.
    Pieces are packed in groups of about ``GROUP_WORDS`` words; the tightest bin is that of the group.
    """
    spaces = r"[\x20\x09-\x0D]+"
    words = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), spaces, " ")))
    slim = publish(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            n_words(F.col("text")).alias("size"),
            F.xxhash64("source", F.col("source").isNull()).alias("source"),
            F.xxhash64(words).alias("cluster"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "sizes",
    )
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)) + F.count(F.lit(1))).first()[0]
    groups = max(1, ceil(total / GROUP_WORDS))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity))
    pieces = slim.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces.cast("long") - 1)))
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        order = ["n_words", "cluster", "source", "doc_id", "row", "piece"]  # equal pieces follow each other
        rows = rows.sort_values(order, ascending=[False, *[True] * 5])
        source, cluster = pd.factorize(rows["source"])[0], pd.factorize(rows["cluster"])[0]
        cluster = np.where(rows["n_words"].to_numpy() > 0, cluster, -1)
        bins, starts = best_fit(rows["n_words"].to_numpy(), source, cluster, capacity, per_source)
        out = rows[["doc_id", "row", "piece", "n_words"]].copy()
        out["bin_id"], out["start"] = (rows["group"].to_numpy() << 32) + bins, starts
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    schema = "doc_id long, row long, piece long, n_words long, bin_id long, start long"
    return pieces.groupBy("group").applyInPandas(pack, schema)
