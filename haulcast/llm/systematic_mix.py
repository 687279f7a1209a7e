"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: its source's target over the source's size. The
documents stand in order of size, so equal steps take long and short ones alike; expected copies are summed up along
that order, one offset drawn for the source is added, and a document comes once for each integer its interval crosses.
Positions come from a range partitioning: places inside a partition are counted there, and only one row for each
partition and source meets in the running sum that turns them into places inside a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.storage import publish
from haulcast.llm.words import n_words

WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source, and so a document, may come


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target, step`` for the rows of ``sizes(source, source_size)``, a row for each source.

    The fixed point of sharing by weight and resharing what exceeds ``most`` sizes: sources in order of size over
    weight are full up to some place, the others share the rest by weight. The level of the rest, taken over every place,
    rises up to the right one and falls after it, so it is the largest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "place")
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(by_name))
    placed = placed.withColumn("weight", F.get(cycle, (F.col("place") - 1) % len(weights)))
    placed = placed.withColumn("room", F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum("source_size").over(upto), F.lit(0)),
            "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        }
    )
    level = (F.col("total") - most * F.col("full")) / F.col("left")
    placed = placed.withColumn("level", F.max(level).over(everything))
    share = F.col("level") * F.col("weight")
    cap = (most * F.col("source_size")).cast("double")
    target = F.when(F.col("level").isNull() | (share >= cap), cap).otherwise(share)
    step = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target / F.col("source_size"))
    return placed.withColumn("target", target).select("source", "source_size", "target", step.alias("step"))


def systematic_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """Every row of ``docs(doc_id, text, source, ...)`` as struct ``doc`` with ``size, source_size, target, copies``.

    ``size`` is the number of words, 0 for a null text. A null source is a source of its own and the last. Documents of
    one size follow each other by md5 of their id, repeated rows by their place in the input. A source without a word
    has target 0 and comes no time. Columns of any names are carried inside ``doc``; an empty table gives no rows.
    Reruns over the same table give the same copies.
    """
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    given = given.withColumns({"size": n_words(F.col("doc.text")), "input": F.monotonically_increasing_id()})
    given = publish(given, "numbered")  # numbered once: a second scan of the source may be split otherwise
    slim = given.select(
        F.col("doc.source").alias("source"), "size", F.md5(F.col("doc.doc_id").cast("string")).alias("key"),
        F.col("doc.doc_id").alias("doc_id"), "input",
    )
    order = ["source", "size", "key", "doc_id", "input"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = publish(ranged.withColumn("at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("at", 33)
    pieces = ranged.groupBy("source", part.alias("part")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")
    )
    pieces = publish(pieces, "pieces")  # a row for each partition and source
    sizes = pieces.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    wanted = targets(sizes, weights, most).withColumn("offset", offset.cast("double") / float(1 << 32))
    wanted = wanted.withColumnRenamed("source", "w_source")
    plan = pieces.join(wanted, F.col("source").eqNullSafe(F.col("w_source")))
    plan = publish(plan.select(
        F.col("source").alias("p_source"), F.col("part").alias("p_part"), "first", "before",
        "source_size", "target", "step", "offset",
    ), "plan")
    known = ranged.withColumn("part", part).join(
        plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))
    )
    place = F.col("at") - F.col("first") + F.col("before")
    crossed = lambda k: F.floor(F.col("offset") + k * F.col("step"))
    known = known.withColumn("copies", crossed(place + 1) - crossed(place))
    known = known.select(F.col("input").alias("k_input"), "source_size", "target", "copies")
    return given.join(known, F.col("input") == F.col("k_input")).drop("input", "k_input")


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of the mix themselves, each as often as it comes."""
    times = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return mixed.where("copies > 0").withColumn("copy", F.explode(times)).select("doc.*")
