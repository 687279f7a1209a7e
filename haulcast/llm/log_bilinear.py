"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Tokens are lower-cased words and one end for each text. The model predicts a *symbol* from the two symbols before it:
the most frequent words are symbols of their own, all other words share a symbol with those of the same ending, and
within such a group a word has its add-one share of the group's counts. So every word, known or not, has a normalised
probability. Parameters are bounded by the number of symbols; counts cover all training text and stay distributed.

Counts: one pass, summed by word in Spark. Training: every task runs stochastic gradient steps over its own text from
the same start, and the tasks' parameters are averaged in Spark (two rounds over disjoint slices, together all training
text). Normalisers of all contexts come from batched matrix products, spread over tasks, so a token costs three look-ups.
Counts of words outside a bounded list of frequent ones reach documents by a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.llm.storage import publish
from haulcast.llm.words import blocks, word_codes

HEAD_WORDS = 640  # words that are symbols of their own
ENDINGS = 382  # groups of other words, by their last three characters
ENDING = 3
LISTED_WORDS = 100_000  # words whose counts every task holds; all others are joined
WIDTH = 24  # size of the vectors
NOISE = 32  # noise symbols a batch is contrasted with
ROUNDS = ((0, 1, 256), (1, 8, 1024))  # slices of 8 (from, to) and batch size
SLICES = 8
RATE = 0.15
COUNT_BYTES = 16 << 20


@dataclass
class Symbols:
    """Words and endings that have a symbol; then one symbol for all other words, and the end."""

    heads: dict[str, int]
    endings: dict[str, int]
    spread: np.ndarray  # log10 of the total of a group's add-one shares, 0 for single words and the end
    unigram: np.ndarray  # noise distribution

    @property
    def other(self) -> int:
        return len(self.heads) + len(self.endings)

    @property
    def end(self) -> int:
        return self.other + 1

    def of(self, words: list[str]) -> np.ndarray:
        heads, endings, other = self.heads, self.endings, self.other
        found = ((h if (h := heads.get(w)) is not None else endings.get(w[-ENDING:], other)) for w in words)
        return np.fromiter(found, np.int32, len(words))


@dataclass
class Parameters:
    """Vectors of the two context positions, of the predicted symbol, and its bias."""

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(symbols: Symbols, seed: int = 1) -> Parameters:
        rng = np.random.default_rng(seed)
        near, far, out = (rng.normal(0, 0.1, (len(symbols.unigram), WIDTH)).astype(np.float32) for _ in range(3))
        return Parameters(near, far, out, np.log(symbols.unigram).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.hstack([self.near, self.far, self.out, self.bias[:, None]])

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        near, far, out = (np.ascontiguousarray(flat[:, i * WIDTH : (i + 1) * WIDTH], np.float32) for i in range(3))
        return Parameters(near, far, out, np.ascontiguousarray(flat[:, -1], np.float32))


def lowered(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes after lower-casing A to Z, the distinct words, and the texts' bounds."""
    codes, distinct, bounds = word_codes(texts)
    lower = pc.ascii_lower(distinct).dictionary_encode()
    return lower.indices.to_numpy(zero_copy_only=False)[codes], lower.dictionary, bounds


def with_ends(symbols: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with an end after each text, and the positions of the ends."""
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    full = np.full(len(symbols) + len(ends), end, np.int32)
    full[np.delete(np.arange(len(full)), ends)] = symbols
    return full, ends


def contexts(tokens: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each token; ends stand before the start of a text."""
    near = np.r_[np.int32(end), tokens[:-1]] if len(tokens) else tokens
    far = np.r_[np.int32(end), near[:-1]] if len(tokens) else tokens
    after = ends[:-1] + 1
    if len(after):
        far = far.copy()
        far[after] = end
    return near, far


def add_rows(table: np.ndarray, power: np.ndarray, index: np.ndarray, gradient: np.ndarray) -> None:
    """One adaptive step: gradients of the same row are added up first."""
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    rows, total = sorted_[starts], np.add.reduceat(gradient[order], starts, axis=0)
    power[rows] += np.square(total).mean(axis=1) if total.ndim > 1 else np.square(total)
    scale = RATE / np.sqrt(power[rows])
    table[rows] += total * (scale[:, None] if total.ndim > 1 else scale)


class Trainer:
    """Noise-contrastive steps over one task's text. A batch shares its noise symbols, so they cost one product."""

    def __init__(self, start: Parameters, symbols: Symbols, batch: int, seed: int):
        self.p, self.batch = start, batch
        self.rng = np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * symbols.unigram).astype(np.float32)
        self.cumulated = np.cumsum(symbols.unigram)
        self.power = [np.full(len(start.bias), 1.0, np.float32) for _ in range(4)]
        self.steps = 0

    def learn(self, tokens: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        for i in self.rng.permutation(len(tokens) // self.batch + 1):
            part = slice(i * self.batch, (i + 1) * self.batch)
            if len(tokens[part]):
                self.step(tokens[part], near[part], far[part])

    def step(self, word: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), len(p.bias) - 1)
        context, out, against = p.near[near] + p.far[far], p.out[word], p.out[noise]
        right = (context * out).sum(axis=1) + p.bias[word] - self.log_noise[word]
        wrong = context @ against.T + (p.bias[noise] - self.log_noise[noise])
        right = 1 / (1 + np.exp(np.clip(right, -30, 30)))  # 1 - sigmoid
        wrong = -1 / (1 + np.exp(np.clip(-wrong, -30, 30)))  # - sigmoid
        to_context = right[:, None] * out + wrong @ against
        add_rows(p.near, self.power[0], near, to_context)
        add_rows(p.far, self.power[1], far, to_context)
        index = np.r_[word, noise]
        add_rows(p.out, self.power[2], index, np.vstack([right[:, None] * context, wrong.T @ context]))
        add_rows(p.bias, self.power[3], index, np.r_[right, wrong.sum(axis=0)])
        self.steps += 1


@dataclass
class Model:
    counts: DataFrame  # word, c: over all training text
    n_tokens: int
    n_distinct: int
    n_ends: int
    symbols: Symbols
    listed: dict[str, int]
    parameters: Parameters
    normalisers: np.ndarray  # natural logarithm, by near and far context


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` over all texts: each block is counted in its task, then Spark adds up by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, limit=COUNT_BYTES):
                codes, distinct, _ = lowered(batch.column("text"))
                times = np.bincount(codes, minlength=len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(times)], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def choose_symbols(counts: DataFrame, n_ends: int) -> Symbols:
    """The most frequent words and endings; only these bounded lists reach the driver."""
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD_WORDS).collect()
    heads = {r["word"]: i for i, r in enumerate(top)}
    rest = counts.join(counts.sparkSession.createDataFrame([(w,) for w in heads], "word string"), "word", "anti")
    ending = F.substring("word", -ENDING, ENDING)
    group = rest.groupBy(ending.alias("ending")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    group = publish(group, "endings")
    chosen = group.orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()
    endings = {r["ending"]: len(heads) + i for i, r in enumerate(chosen)}
    all_c, all_v = group.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    grouped = [(r["c"], r["v"]) for r in chosen]
    grouped.append((all_c - sum(c for c, _ in grouped), all_v - sum(v for _, v in grouped)))
    times = np.array([r["c"] for r in top] + [c for c, _ in grouped] + [n_ends], np.float64) + 1
    spread = np.r_[np.zeros(len(top)), [np.log10(c + v + 1) for c, v in grouped], 0.0]
    return Symbols(heads, endings, spread, times / times.sum())


def train_round(texts: DataFrame, symbols: Symbols, start: np.ndarray, batch: int, seed: int) -> np.ndarray:
    """Every task trains on its own text; the parameters are averaged, weighted by steps, in two levels."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for whole in batches:
            for part in blocks(whole):
                if trainer is None:
                    trainer = Trainer(Parameters.of(start.copy()), symbols, batch, seed)
                codes, distinct, bounds = lowered(part.column("text"))
                tokens, ends = with_ends(symbols.of(distinct.to_pylist())[codes], bounds, symbols.end)
                trainer.learn(tokens, *contexts(tokens, ends, symbols.end))
        if trainer is not None and trainer.steps:
            values = trainer.p.flat().astype(np.float64) * trainer.steps
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(values))),
                    pa.array(np.full(len(values), trainer.steps, np.float64)),
                    pa.array(list(values), pa.list_(pa.float64())),
                ],
                ["symbol", "steps", "v"],
            )

    rows = texts.select("text").mapInArrow(train, "symbol long, steps double, v array<double>")
    summed = rows.select("symbol", "steps", F.posexplode("v").alias("i", "x")).groupBy("symbol", "i")
    summed = summed.agg((F.sum("x") / F.sum("steps")).alias("x")).toPandas()
    out = start.astype(np.float64)
    out[summed["symbol"].to_numpy(), summed["i"].to_numpy()] = summed["x"].to_numpy()
    return out.astype(np.float32)


def normalisers(spark: SparkSession, parameters: Parameters) -> np.ndarray:
    """Log normalisers of all pairs of context symbols: one product of matrices for each near symbol."""
    size = len(parameters.bias)

    def row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parameters
        for batch in batches:
            found = []
            for near in batch.column("id").to_pylist():
                score = (p.near[near] + p.far) @ p.out.T + p.bias
                most = score.max(axis=1, keepdims=True)
                found.append((np.log(np.exp(score - most).sum(axis=1)) + most[:, 0]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.float32()))], ["id", "z"])

    rows = spark.range(0, size, 1, min(size, 24)).mapInArrow(row, "id long, z array<float>").collect()
    return np.array([r["z"] for r in sorted(rows)], np.float32)


def train(docs: DataFrame, training: Column) -> Model:
    """Learn counts and parameters from the rows of ``docs(doc_id, text)`` for which ``training`` holds."""
    spark = docs.sparkSession
    texts = docs.where(training)
    counts = publish(count_words(texts), "word-counts")
    n_ends = texts.select("doc_id").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    symbols = choose_symbols(counts, n_ends)
    listed = {r["word"]: r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(LISTED_WORDS).collect()}
    flat = Parameters.start(symbols).flat()
    slice_ = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))
    for seed, (first, last, batch) in enumerate(ROUNDS):
        flat = train_round(texts.where(slice_.between(first, last - 1)), symbols, flat, batch, seed)
    parameters = Parameters.of(flat)
    return Model(
        counts, total[0] + n_ends, total[1] + (n_ends > 0), n_ends, symbols, listed, parameters,
        normalisers(spark, parameters),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs(doc_id, text)``.

    A null text is empty: its only token is the end. ``base_score`` sums log10((c + 1) / (N + V + 1)) over tokens,
    ``score`` is the model's log10 probability. Repeated rows score alike, null doc_ids are carried, other columns are
    not read, an empty table gives no rows. Without training text every token has base 0.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.symbols, model.listed, model.parameters, model.normalisers))
    n_ends = model.n_ends
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, listed, p, log_z = held.value
        from_near, from_far = p.near @ p.out.T + p.bias, p.far @ p.out.T
        for whole in batches:
            for batch in blocks(whole):
                codes, distinct, bounds = lowered(batch.column("text"))
                words = distinct.to_pylist()
                n_docs = len(bounds) - 1
                tokens, ends = with_ends(symbols.of(words)[codes], bounds, symbols.end)
                near, far = contexts(tokens, ends, symbols.end)
                got = (from_near[near, tokens] + from_far[far, tokens] - log_z[near, far]).astype(np.float64) / np.log(10)
                model_score = np.add.reduceat(got - symbols.spread[tokens], np.r_[0, ends[:-1] + 1])

                doc = np.repeat(np.arange(n_docs), np.diff(bounds))
                count = np.fromiter((listed.get(w, -1) for w in words), np.int64, len(words))[codes]
                share = np.log10(np.maximum(count, 0) + 1.0)
                base = np.bincount(doc, share, n_docs) + np.log10(n_ends + 1.0)
                known = np.bincount(doc, count > 0, n_docs).astype(np.int64) + (n_ends > 0)
                in_group = (tokens < symbols.other + 1) & (tokens >= len(symbols.heads))
                inner = np.where(np.delete(in_group, ends), share, 0.0)
                model_score += np.bincount(doc, inner, n_docs)

                rare, times = np.unique((doc * len(words) + codes)[count < 0], return_counts=True)
                owner, code = np.divmod(rare, max(1, len(words)))
                offsets = np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32)
                names = distinct.take(pa.array(code)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(bounds) + 1),
                        pa.array(known),
                        pa.array(base),
                        pa.array(model_score),
                        pa.ListArray.from_arrays(pa.array(offsets), names),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32))),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base", "score", "words", "times"],
                )

    schema = "doc_id long, n_tokens long, n_known long, base double, score double, words array<string>, times array<int>"
    looked = keys.mapInArrow(look_up, schema).withColumn("row", F.monotonically_increasing_id())
    looked = publish(looked, "looked-up")
    rare = looked.select("row", F.explode(F.arrays_zip("words", "times")).alias("r"))
    rare = rare.select("row", F.col("r.words").alias("word"), F.col("r.times").alias("n"))
    rest = rare.join(model.counts, "word").groupBy("row").agg(
        F.sum("n").cast("long").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more")
    )
    more = F.coalesce("more", F.lit(0.0))
    size = np.log10(model.n_tokens + model.n_distinct + 1.0)
    return looked.drop("words", "times").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(size))).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
