"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.storage import publish


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Each round every node points to its smallest neighbour, pointers are followed twice, and links are redrawn
    between what they end at. Links inside one component vanish, so rounds end when none are left; the driver sees
    only their count. A hub's links meet only in sums and in joins that Spark may split.
    Null ends and loops are ignored; no links give no rows.
    """
    links = publish(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        point = publish(point.select("node", F.least("node", "to").alias("to")), "pointers")
        for _ in range(2):
            next_ = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
            point = point.join(next_, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        point = publish(point, "pointers")
        if found is None:
            found = point
        else:
            next_ = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
            found = publish(
                found.join(next_, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "labels"
            )
        at_a = point.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        at_b = point.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        links = publish(
            links.join(at_a, "a")
            .select("to_a", "b")
            .distinct()
            .join(at_b, "b")
            .select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b"))
            .where("a <> b")
            .distinct(),
            "links",
        )
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("to").alias("component"))
