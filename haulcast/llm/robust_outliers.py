"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates, in DataFrame functions only.

1. One projection over whole texts gives each document its counts and, from them, a vector of transformed statistics.
2. Each group of language and source starts from medians and absolute deviations. Concentration steps follow: the
   nearest share of the group's documents gives the next mean and covariance, which gives the next distances.
   All of a group's figures are mergeable aggregates, so a hot group is one partial row for each task.
3. A document beyond the cutoff is rejected if it stands out towards the bad side of some statistic.

The estimates of a small group lean on its language's pooled ones by ``PRIOR`` rows, for every group alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.storage import publish

SHARE = 0.75  # of a group's documents that determine its estimates
STEPS = 3
PRIOR = 200.0
CUTOFF = 37.0  # squared distance; beyond the 99.9999 % point of chi-square with six degrees of freedom
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
STATISTICS = ("symbols", "marks", "capitals", "repeats", "lines", "word_length")
#: Smallest deviation of each statistic: a group in which nearly all documents agree does not reject the rest.
FLOOR = dict(symbols=0.04, marks=0.04, capitals=0.05, repeats=0.15, lines=0.15, word_length=0.08)
ONE_SIDED = ("symbols", "marks", "capitals", "repeats", "lines")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the array."""

    def positions(w: Column) -> Column:
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
        ))
        return _bind(F.sort_array(windows), lambda s: F.transform(
            F.filter(s, lambda x, k: F.coalesce(
                (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
                x["h"] == F.get(s, k - 1)["h"], x["h"] == F.get(s, k + 1)["h"], F.lit(False),
            )), lambda x: x["i"]
        ))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last"))
    return _bind(words, lambda w: F.aggregate(F.sort_array(positions(w)), start, step, lambda a: a["n"]))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their counts: separate columns, so that Catalyst computes each once however often it is used."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    long = lambda c: c.cast("long")
    return docs.withColumns(dict(
        n_words=long(F.size(words)),
        word_chars=long(F.length(F.translate(whole, SPACES, ""))),
        n_symbols=long(F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))),
        n_dup_lines=long(_bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        n_lines=long(F.size(lines)),
        n_repeat_words=_covered(words),
        n_marks=long(F.length(whole) - F.length(F.regexp_replace(whole, r"[!?@=~^_+\\/\[\]{}\p{N}]", ""))),
        n_capitals=long(F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}", ""))),
    ))


def statistics() -> dict[str, Column]:
    """Transformed statistics: square roots of shares (their spread hardly depends on the share), log of word length."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return dict(
        symbols=share("n_symbols", "word_chars"),
        marks=share("n_marks", "word_chars"),
        capitals=share("n_capitals", "word_chars"),
        repeats=share("n_repeat_words", "n_words"),
        lines=share("n_dup_lines", "n_lines"),
        word_length=F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
    )


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.avg(a).alias(f"m_{a}") for a in STATISTICS]
    cross = [F.avg(F.col(a) * F.col(b)).alias(f"x_{a}_{b}") for i, a in enumerate(STATISTICS) for b in STATISTICS[: i + 1]]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums, *cross)


def _estimates(rows: DataFrame) -> DataFrame:
    """Mean and lower Cholesky factor of each group's covariance, leaning on its language and all rows."""
    fine = publish(_moments(rows, ["g_lang", "g_source"]), "moments")
    names = [c for c in fine.columns if c[:2] in ("m_", "x_")]

    def pooled(keys: list[str], prefix: str) -> DataFrame:
        sums = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(prefix + c) for c in names]
        return fine.groupBy(*keys).agg(F.sum("n").alias(prefix + "n"), *sums)

    lang, every = pooled(["g_lang"], "l_"), pooled([], "e_")
    both = lang.join(every.hint("broadcast"), F.lit(True))  # the right side is one row
    mixed = lambda own, n, other: (F.col(own) * F.col(n) + other * PRIOR) / (F.col(n) + PRIOR)
    both = both.select("g_lang", *[mixed("l_" + c, "l_n", F.col("e_" + c)).alias("p_" + c) for c in names])
    given = fine.join(both, "g_lang")
    given = given.select("g_lang", "g_source", *[mixed(c, "n", F.col("p_" + c)).alias(c) for c in names])
    for i, a in enumerate(STATISTICS):  # Cholesky, a row of the factor at a time
        for j, b in enumerate(STATISTICS[: i + 1]):
            rest = F.col(f"x_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")
            for c in STATISTICS[:j]:
                rest = rest - F.col(f"f_{a}_{c}") * F.col(f"f_{b}_{c}")
            value = F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOOR[a] ** 2) if a == b else rest / F.col(f"f_{b}_{b}")
            given = given.withColumn(f"f_{a}_{b}", value)
    factors = [f"f_{a}_{b}" for i, a in enumerate(STATISTICS) for b in STATISTICS[: i + 1]]
    return publish(given.select("g_lang", "g_source", *[f"m_{a}" for a in STATISTICS], *factors), "estimates")


def _standardised() -> dict[str, Column]:
    """Uncorrelated coordinates, by forward substitution; their squares add up to the Mahalanobis distance."""
    solved: dict[str, Column] = {}
    for i, a in enumerate(STATISTICS):
        rest = F.col(a) - F.col(f"m_{a}")
        for b in STATISTICS[:i]:
            rest = rest - F.col(f"f_{a}_{b}") * F.col(f"z_{b}")
        solved[a] = rest / F.col(f"f_{a}_{a}")
    return solved


def _measured(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    joined = rows.join(estimates, ["g_lang", "g_source"], how)
    for a, z in _standardised().items():
        joined = joined.withColumn(f"z_{a}", z)
    total = sum((F.col(f"z_{a}") ** 2 for a in STATISTICS), F.lit(0.0))
    extra = [c for c in joined.columns if c[:2] in ("m_", "f_", "z_")]
    worst = F.greatest(*[(F.col(a) - F.col(f"m_{a}")) / F.col(f"f_{a}_{a}") for a in ONE_SIDED],
                       F.abs(F.col("word_length") - F.col("m_word_length")) / F.col("f_word_length_word_length"))
    return joined.withColumn("distance", total).withColumn("worst", worst).drop(*extra)


def robust_outliers(docs: DataFrame, cutoff: float = CUTOFF, carried: list[str] | None = None) -> DataFrame:
    """Every row of ``docs(text, lang, source, ...)`` as struct ``doc``, with its counts, ``distance`` and ``kept``.

    ``carried`` names the columns of ``doc``, by default all. The counts are computed once and written with them.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows. ``kept`` is false for those and
    for outliers. A null text is empty; a null language or source is a group of its own. Repeated rows count each.
    Carried columns, whatever their names, lie inside ``doc``. An empty table gives no rows.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carried is None else carried)]).alias("doc")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    given = docs.select(doc, F.col("text").alias("whole"), key("lang").alias("g_lang"), key("source").alias("g_source"))
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    given = counted(given, "whole").withColumns({"base_failed": failed, **statistics()}).drop("whole")
    given = publish(given, "statistics")
    rows = given.where(~F.col("base_failed")).select("g_lang", "g_source", *STATISTICS)

    keys = ["g_lang", "g_source"]
    middle = rows.groupBy(*keys).agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"c_{a}") for a in STATISTICS])
    near = rows.join(publish(middle, "medians"), keys)
    spread = [F.percentile_approx(F.abs(F.col(a) - F.col(f"c_{a}")), 0.5, 1000).alias(f"d_{a}") for a in STATISTICS]
    scale = publish(near.groupBy(*keys).agg(*spread), "deviations")
    first = near.join(scale, keys)
    square = lambda a: ((F.col(a) - F.col(f"c_{a}")) / (F.col(f"d_{a}") * 1.4826 + FLOOR[a])) ** 2
    measured = first.withColumn("distance", sum((square(a) for a in STATISTICS), F.lit(0.0)))
    for _ in range(STEPS):
        limit = measured.groupBy(*keys).agg(F.percentile_approx("distance", SHARE, 1000).alias("limit"))
        nearest = measured.join(publish(limit, "limits"), keys).where(F.col("distance") <= F.col("limit"))
        estimates = _estimates(nearest)
        measured = _measured(rows, estimates)

    judged = _measured(given, estimates, "left")
    outlier = (F.col("distance") > cutoff) & (F.col("worst") > 3)
    kept = ~F.col("base_failed") & ~F.coalesce(outlier, F.lit(False))
    return judged.drop("g_lang", "g_source").withColumn("kept", kept)
