"""Licence scan: a trained paragraph classifier finds the family, comparison with its templates confirms it.

All in DataFrame functions and Spark's own ML stages. Features are word n-grams (one to three words); a softmax
regression has a class for each family and one for no licence. Training paragraphs are the templates, word-wise cut
variants of them, short names, and all of the corpus's own distinct lines that share no three words with any template,
save a quarter held out. The classifier reads every line with a word, and neighbouring lines joined where a notice is
wrapped over them. A paragraph is of a family if its probability passes a threshold calibrated on held-out background paragraphs and it
shares enough three-word windows with a template of the family; other lines that the classifier calls a licence are unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.storage import discard, publish, shuffles_deleted

MOST_GRAMS = 1 << 14  # n-grams of the background that are features
SLICES = 4  # so many parts of the lines are made distinct one after the other, so that a shuffle of all never lies on disk
ORDINARY = 3000.0  # weight of all background paragraphs together, however many they are
LIKELY = 0.9  # least probability of a line that no template confirms to be listed as unknown
WORDLESS = 100.0  # weight of a paragraph without words
FALSE_ALARMS = 0.001  # share of held-out background paragraphs that may pass the classifier
SHARED = 0.6  # share of a template's windows that confirms; a notice shorter than its template needs a template of its own
NONE = "none"
#: Short public licence notices by family.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "licensed under the mit license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "proprietary": ["all rights reserved", "all rights reserved no part of this publication may be reproduced without permission"],
}
#: What short mentions call the families: the classifier learns them too, but they confirm nothing.
NAMES = {
    "apache-2.0": ["apache license", "apache 2.0"],
    "mit": ["mit license", "mit licensed"],
    "gpl-3.0": ["gnu license", "general public license", "gpl"],
    "cc-by-nc-4.0": ["cc by nc", "creative commons noncommercial"],
    "cc-by-4.0": ["cc by", "creative commons license"],
    "cc-by-sa-4.0": ["cc by sa", "creative commons sharealike"],
    "bsd": ["bsd license", "bsd licensed"],
    "mpl-2.0": ["mozilla license", "mpl"],
    "proprietary": ["proprietary license", "copyright"],
}
FAMILIES = [*TEMPLATES, NONE]


def tokens(text: Column) -> Column:
    """Lower-case words: letters and digits, and points inside numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{N}+(?:\.\p{N}+)+|[\p{L}\p{N}]+)"), F.lit(1))


def windows(words: Column, n: int = 3) -> Column:
    """Distinct windows of n words; fewer words are one window."""
    size = F.size(words)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.when(size > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def background(texts: DataFrame, may: DataFrame) -> DataFrame:
    """``key, words, part, meets`` of every distinct line with a word, of every text; ``may`` are the texts that may hold
    three words in a row of some template, and ``meets`` says whether the line does. A ``SLICES``-th is shuffled at a time."""
    line = F.explode(F.split("text", "\n")).alias("line")
    met = publish(may.select(line).where(_meets_template(tokens(F.col("line")))).distinct(), "met").withColumn("meets", F.lit(True))
    lines = texts.select(line).where(F.col("line").rlike(r"[\p{L}\p{N}]")).withColumn("key", F.xxhash64("line"))

    def some(k: int) -> DataFrame:
        own = lines.where(F.pmod("key", F.lit(SLICES)) == k).distinct().join(met, "line", "left")
        own = own.select("key", tokens(F.col("line")).alias("words"), F.coalesce("meets", F.lit(False)).alias("meets"))
        return publish(own.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(4))), "background")

    return reduce(DataFrame.unionByName, map(some, range(SLICES)))


def _windows(text: str) -> set[str]:
    w = text.split()
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def _grams(words: str) -> list[str]:
    w = words.split()
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _common(background: DataFrame) -> list[str]:
    """The ``MOST_GRAMS`` n-grams that most paragraphs hold, two at least; of equally many the shorter, then the lower first.

    No paragraph holds an n-gram without its parts. So the longer ones are counted only where both shorter ones at their
    ends are still among the commonest, and that loses none.
    """
    top: list[tuple[int, int, str]] = []
    grams = background.select(F.col("words").alias("grams"))
    for n in (1, 2, 3):
        least = max(2, -top[-1][0]) if len(top) == MOST_GRAMS else 2
        held = grams.select(F.explode(F.array_distinct("grams")).alias("gram")).where("gram is not null")
        counted = held.groupBy("gram").count().where(F.col("count") >= least).orderBy(F.desc("count"), "gram").limit(MOST_GRAMS)
        top = sorted([*top, *((-r["count"], n, r.gram) for r in counted.collect())])[:MOST_GRAMS]
        kept = ", ".join(f"'{gram}'" for _, m, gram in top if m == n)  # words are letters, digits and points
        if not kept:
            break
        places = F.expr(f"transform(grams, gram -> if(gram in ({kept}), gram, null))")  # as text: a call for each literal is slow
        longer = lambda held: F.transform(held, lambda g, i: F.concat(g, F.lit(" "), F.substring_index(F.get(held, i + 1), " ", -1)))
        grams = grams.select(_bind(places, longer).alias("grams"))
    return [gram for _, _, gram in top]


def _vectors(background: DataFrame) -> list:
    """Stages from words to features: the n-grams of notices, and the commonest ones that several background paragraphs hold.

    Other n-grams add nothing; with hashed ones, a word that met a notice's by chance would count as it.
    """
    stages = [NGram(n=n, inputCol="words", outputCol=f"n{n}") for n in (2, 3)]
    stages.append(SQLTransformer(statement="SELECT *, concat(words, n2, n3) AS grams FROM __THIS__"))
    own = {g for many in (*TEMPLATES.values(), *NAMES.values()) for text in many for g in _grams(text)}
    common = _common(background)  # first, so that weights that are often used together lie together
    vocabulary = [*common, *sorted(own.difference(common))]
    return [*stages, CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)]


def _fit(known: DataFrame, ordinary: DataFrame, weight: float) -> LogisticRegressionModel:
    rows = ordinary.select("features", F.lit(float(len(TEMPLATES))).alias("label"), F.lit(weight).alias("weight"))
    return LogisticRegression(weightCol="weight", regParam=0.002, maxIter=40, family="multinomial").fit(known.unionByName(rows))


def licence() -> Column:
    """Probability that a scored paragraph is a notice of any family."""
    return 1 - F.element_at(vector_to_array("probability"), -1)


def train(lines: DataFrame) -> tuple[PipelineModel, float, float, DataFrame]:
    """The model, the probability above which a paragraph's family counts, that above which it is some licence, and the
    ``key`` of every line of ``background`` that may pass either.

    The background are all lines that share no three words in a row with a template. However many they are, they weigh
    ``ORDINARY`` together, so that notices keep their weight beside them. None gives 0.5 and ``LIKELY``; the second stays
    there where too few paragraphs are held out to show a share as small as ``FALSE_ALARMS``. The background may hold
    notices that share no three words in a row with a template. So each of two parts of it is read by a model that learned
    from the other, and what that calls a notice is not learned as ordinary. A paragraph without words is.
    """
    spark = lines.sparkSession
    none = float(len(TEMPLATES))
    rows = [([], none, WORDLESS)]
    for label, family in enumerate(TEMPLATES):
        for text in TEMPLATES[family]:
            words = text.split()
            cuts = {(i, j) for i in (0, 1, 2) for j in (len(words), len(words) - 1) if j - i >= 4} | {(0, len(words))}
            rows += [(words[i:j], float(label), 20.0) for i, j in sorted(cuts)]
        rows += [(name.split(), float(label), 20.0) for name in NAMES[family]]
    known = spark.createDataFrame(rows, "words array<string>, label double, weight double").coalesce(1)
    vectors = _vectors(lines.where("part > 0 and not meets"))
    features = PipelineModel(stages=vectors)
    known = features.transform(known).select("features", "label", "weight")
    every = publish(features.transform(lines).select("key", "part", "meets", "features"), "features")
    discard(lines)  # words are large, and read no more
    learned = every.where("part > 0 and not meets")
    weight = min(1.0, ORDINARY / max(learned.count(), 1))
    halves = [learned.where("part = 1"), learned.where("part > 1")]
    ordinary = [_fit(known, other, weight).transform(half).where(licence() < LIKELY).select("features") for half, other in (halves, halves[::-1])]
    ordinary = publish(ordinary[0].unionByName(ordinary[1]), "ordinary")
    classes = _fit(known, ordinary, ORDINARY / max(ordinary.count(), 1))
    discard(ordinary)
    best = F.array_max(F.slice(vector_to_array("probability"), 1, len(TEMPLATES)))
    scored = classes.transform(every).select("key", "part", "meets", best.alias("best"), licence().alias("any"))
    cut = [F.percentile_approx(c, 1 - FALSE_ALARMS, 10000) for c in ("best", "any")]
    family, some, n = scored.where("part = 0 and not meets").agg(*cut, F.count("*")).first()
    family, some = max(0.5, family or 0.0), max(LIKELY, some) if 2 * n * FALSE_ALARMS >= 1 else LIKELY
    like = publish(scored.where(F.col("any") >= min(family, some)).select("key"), "like_keys")
    return PipelineModel(stages=[*vectors, classes]), family, some, like


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def may_meet_template() -> str:
    """A pattern that every text in lower case matches where three words in a row are a window of some template.

    It runs compiled over the whole text. Windows that begin alike share their beginning.
    """
    tree: dict = {}
    for window in sorted(set().union(*(_windows(t) for many in TEMPLATES.values() for t in many))):
        level = tree
        for word in window.split():
            level = level.setdefault(word, {})

    def pattern(level: dict) -> str:
        gap = r"[^\p{L}\p{N}]*+"
        rest = [word.replace(".", r"\.") + (gap + pattern(below) if below else "") for word, below in level.items()]
        return rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})"

    return r"(?<!\p{L})" + pattern(tree)


def _meets_template(words: Column) -> Column:
    """Whether three words in a row are a window of some template."""
    every = sorted(set().union(*(_windows(t) for many in TEMPLATES.values() for t in many)))

    def found(w: Column) -> Column:
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).isin(every))

    return _bind(words, found)


def spans(texts: DataFrame) -> DataFrame:
    """From ``row, text``: ``row, first, last, words, head, tail``: single lines, and joined neighbouring lines that a notice may be wrapped over.

    Only spans whose first and last line take part in a window of some template are made. A line without a word ends a
    paragraph. The lines inside a span lie inside the notice, so together they have no more words than the longest
    template. ``head`` and ``tail`` are the words without the last and without the first line.
    """
    longest = max(len(t.split()) for many in TEMPLATES.values() for t in many)
    given = texts.where(_meets_template(tokens(F.col("text"))))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line"), tokens(line).alias("words")))
    lines = F.filter(lines, lambda x: F.size(x["words"]) > 0)
    joined = lambda x: F.flatten(F.transform(x, lambda y: y["words"]))

    def starts(x: Column) -> Column:
        near = F.transform(F.sequence(F.lit(1), F.size(x)), lambda k: F.slice(x, k, longest + 2))
        own = lambda n: F.size(F.get(n, 0)["words"])
        return F.filter(near, lambda n: _meets_template(F.slice(joined(F.slice(n, 1, 3)), 1, own(n) + 2)))

    near = given.select("row", F.explode(_bind(lines, starts)).alias("near"))
    ends = near.select("row", "near", F.explode(F.sequence(F.lit(1), F.size("near"))).alias("n"))
    ends = ends.where(F.get("near", F.col("n") - 1)["line"] - F.get("near", F.lit(0))["line"] == F.col("n") - 1)
    inner = F.when(F.col("n") > 2, F.size(joined(F.slice("near", 2, F.col("n") - 2)))).otherwise(0)
    made = ends.where(inner <= longest).select(
        "row",
        F.get("near", F.lit(0))["line"].cast("long").alias("first"),
        F.get("near", F.col("n") - 1)["line"].cast("long").alias("last"),
        F.size(F.get("near", F.col("n") - 1)["words"]).alias("n_last"),
        joined(F.slice("near", 1, F.col("n"))).alias("words"),
        joined(F.slice("near", 1, F.col("n") - 1)).alias("head"),
        joined(F.slice("near", 2, F.col("n") - 1)).alias("tail"),
    )
    end = F.greatest(F.lit(1), F.size("words") - F.col("n_last") - 1)
    return made.where(_meets_template(F.slice("words", end, F.col("n_last") + 2))).drop("n_last")


def apart(found: Column) -> Column:
    """Of structs ``(less, lines, first, last)`` in ascending order, each that overlaps none taken before it."""

    def step(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(F.struct(x["first"].alias("first"), x["last"].alias("last")))))

    return F.aggregate(found, F.array().cast("array<struct<first:bigint,last:bigint>>"), step)


def licence_scan(docs: DataFrame, shared: float = SHARED) -> DataFrame:
    """``doc_id, n_paragraphs, n_licences, families, paragraphs, last_lines, unknown`` for each row of ``docs(doc_id, text)``.

    ``families`` are the sorted licence families found, ``paragraphs`` the line numbers at which their notices start and
    ``last_lines`` those at which they end: the same line, or a later one if a notice is wrapped. A span of lines counts
    if both its first and its last line add to what it shares with a template; where spans of a family overlap, the one
    that shares most counts, and of those the shortest. A null or wordless text has none; repeated rows each count, null
    doc_ids are carried, other columns are not read, an empty table gives no rows.
    ``unknown`` are further lines that the model calls a licence, but that no template of any family confirms: notices of
    other licences, or pieces of known ones. Every line is read; one that shares no three words in a row with a template
    needs the higher probability.
    """
    may_meet = F.lower("text").rlike(may_meet_template())
    with shuffles_deleted(docs.sparkSession):
        may = publish(docs.where(may_meet).select("text", F.xxhash64("text").alias("key")), "may")
        model, threshold, likely, keys = train(background(docs, may))
    n_lines = F.coalesce(F.regexp_count("text", F.lit(r"[\p{L}\p{N}][^\n]*+")), F.lit(0)).cast("long")
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), n_lines.alias("n_paragraphs"), "text"
    )
    numbered = publish(numbered, "numbered")  # rows are numbered once
    may = numbered.withColumn("key", F.xxhash64("text")).join(may.select("key").distinct(), "key", "left_semi")
    may = publish(may.where(may_meet).select("row", "text"), "may")

    def confirms(text: str) -> Column:
        """Windows of the template in the span, 0 unless they are enough and both outer lines add to them."""
        mine = sorted(_windows(text))
        whole, head, tail = (F.size(F.array_intersect(w, F.array(*map(F.lit, mine)))) for w in ("w_words", "w_head", "w_tail"))
        return F.when((whole >= shared * len(mine)) & (whole > head) & (whole > tail), whole).otherwise(0)

    def agreed(seen: DataFrame) -> DataFrame:
        """``agreed``: for each family the most that a template of it confirms."""
        seen = seen.select("*", *[windows(F.col(c)).alias("w_" + c) for c in ("words", "head", "tail")])
        best = [reduce(F.greatest, map(confirms, many), F.lit(0)) for many in TEMPLATES.values()]
        return seen.select("row", "first", "last", "words", F.array(*best).alias("agreed"))

    confirmed = F.exists("agreed", lambda n: n > 0)
    probabilities = vector_to_array("probability").alias("p")
    scored = model.transform(agreed(spans(may))).select("row", "first", "last", "agreed", probabilities)
    scored = publish(scored, "scored").where(confirmed)  # a row for each span that shares words with a template
    # The classifier has read every distinct line; where those that may pass stand, it reads them again.
    lines = numbered.select("row", F.posexplode(F.split("text", "\n")).alias("first", "line")).withColumn("key", F.xxhash64("line"))
    lines = lines.join(keys, "key", "left_semi").select("row", F.col("first").cast("long").alias("first"), tokens(F.col("line")).alias("words"))
    # A numbered row keeps the filter from being pushed below, where words are found anew for each use.
    like = model.transform(lines).select("row", "first", "words", licence().alias("p"), F.monotonically_increasing_id().alias("at"))
    like = publish(like.where(F.col("p") >= min(threshold, likely)), "like").where(F.size("words") > 0)
    like = like.where((F.col("p") >= likely) | (F.col("p") >= threshold) & _meets_template(F.col("words")))
    empty = F.array().cast("array<string>")
    like = agreed(like.select("row", "first", "words", F.col("first").alias("last"), empty.alias("head"), empty.alias("tail")))
    like = publish(like.select("row", "first", "agreed"), "agreed").where(~confirmed)
    unknown = like.groupBy("row").agg(F.sort_array(F.collect_list("first")).alias("lines"))
    scored = scored.withColumn("best", F.array_max(F.slice("p", 1, len(TEMPLATES)))).where(F.col("best") >= threshold)
    scored = scored.withColumn("label", F.array_position("p", F.col("best")).cast("int"))
    scored = scored.withColumn("agreed", F.element_at("agreed", F.col("label"))).where("agreed > 0")
    place = F.struct((-F.col("agreed")).alias("less"), (F.col("last") - F.col("first")).alias("lines"), "first", "last")
    notices = scored.groupBy("row", "label").agg(apart(F.sort_array(F.collect_list(place))).alias("notices"))
    notices = notices.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("label")))
    found = notices.groupBy("row").agg(
        F.sort_array(F.collect_set("family")).alias("families"),
        F.sort_array(F.flatten(F.collect_list("notices"))).alias("notices"),
    )
    none = F.array().cast("array<long>")
    covered = lambda line: F.exists(F.coalesce("notices", F.array().cast("array<struct<first:bigint,last:bigint>>")), lambda y: line.between(y["first"], y["last"]))
    joined = numbered.select("doc_id", "row", "n_paragraphs").join(found, "row", "left").join(unknown, "row", "left")
    return joined.select(
        "doc_id", "n_paragraphs", F.coalesce(F.array_size("notices"), F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce(F.transform("notices", lambda x: x["first"]), none).alias("paragraphs"),
        F.coalesce(F.transform("notices", lambda x: x["last"]), none).alias("last_lines"),
        F.coalesce(F.filter("lines", lambda x: ~covered(x)), none).alias("unknown"),
    )
