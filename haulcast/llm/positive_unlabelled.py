"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk is minimised in numpy.

Trusted positives and unlabelled texts are bounded samples (about ``MOST_ROWS`` each, by hash of id and text); the scorer
is applied to every whole text in Arrow batches. The driver sees weights, never texts or their features. The prior is
estimated from the scores of positives and unlabelled texts; negative labels are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from haulcast.llm.storage import publish
from haulcast.llm.words import blocks

MOST_ROWS = 20_000  # bound of either training sample
BUCKETS = 512  # hashed shapes of words
EPOCHS = 60
RATE = 0.02
DECAY = 1e-3
LEAST_ROWS = 100  # scores of either kind that an estimate of the prior needs
PRIOR = 0.85  # stands where there are fewer
DENSE = 11
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPE = str.maketrans({**{c: "a" for c in "bcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})


def features(text: str | None) -> np.ndarray:
    """Shares that tell prose from junk, and the normalised counts of hashed word shapes; all 0 for a text without words."""
    out = np.zeros(DENSE + BUCKETS, np.float32)
    words = _WORD.findall(text or "")
    if not words:
        return out
    n, chars = len(words), sum(map(len, words))
    counts: dict[tuple, int] = {}
    for gram in zip(words, words[1:], words[2:]):
        counts[gram] = counts.get(gram, 0) + 1
    repeats = sum(c for c in counts.values() if c > 1)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    out[:DENSE] = (
        np.log1p(n) / 10, n < 20, n < 50, np.sqrt(repeats / max(1, n)), np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.sqrt(sum(map(str.isupper, text)) / chars), np.sqrt(max(0, chars - letters) / chars), len(set(words)) / n,
        np.sqrt(sum(map(text.count, "#*$%&|<>!")) / chars), np.log(chars / n) / 3, np.log1p(n / max(1, len(lines))) / 5,
    )
    shapes: dict[str, int] = {}
    for word in words:
        tail = word[-3:].translate(_SHAPE)
        shapes[tail] = shapes.get(tail, 0) + 1
    for shape, c in shapes.items():
        out[DENSE + xxhash.xxh32_intdigest(shape) % BUCKETS] += c
    out[DENSE:] /= np.linalg.norm(out[DENSE:])
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and deviations. The matrices have a last column of ones, and are standardised in place.

    Logistic loss; where the estimated negative risk falls below zero,
    the step goes against it, so it does not fit the positives among the unlabelled away."""
    p, u = positive, unlabelled
    rows = len(p) + len(u)
    mean = sum(x[:, :-1].sum(axis=0, dtype=np.float64) for x in (p, u)) / rows
    square = sum(np.einsum("ij,ij->j", x[:, :-1], x[:, :-1], dtype=np.float64) for x in (p, u)) / rows
    spread = np.sqrt(np.maximum(square - mean**2, 0)) + 0.02
    for x in (p, u):
        x[:, :-1] -= mean.astype(np.float32)
        x[:, :-1] /= spread.astype(np.float32)
        np.clip(x, -8, 8, out=x)
    rng, w = np.random.default_rng(seed), np.zeros(p.shape[1])
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  # of calling a row negative
    n_batches = max(1, min(len(p), len(u)) // 256)
    for _ in range(EPOCHS):
        for a, b in zip(np.array_split(rng.permutation(len(p)), n_batches), np.array_split(rng.permutation(len(u)), n_batches)):
            x, y = p[a], u[b]
            zx, zy = x @ w, y @ w
            negative = loss(zy).mean() - prior * loss(zx).mean()
            to_negative = y.T @ sigmoid(zy) / len(y) - prior * (x.T @ sigmoid(zx)) / len(x)
            to_positive = -prior * (x.T @ sigmoid(-zx)) / len(x)
            gradient = to_positive + to_negative if negative >= 0 else -to_negative
            gradient = gradient + DECAY * np.r_[w[:-1], 0]
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, mean, spread


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of rows that the scorer was not fitted on.

    Above any score, the unlabelled hold at least the prior's share of what the positives hold there. Every score so gives
    an upper bound, their ratio with its sampling error against it; the estimate is the ratio where the bound is smallest.
    """
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    held_p = np.arange(1, len(p) + 1) / len(p)
    held_u = np.searchsorted(-u, -p, "right") / len(u)
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((held_u + error) / held_p))
    return min(0.95, max(0.05, float(held_u[best] / held_p[best])))


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, deviations and the prior. One half of either sample orders the other half to estimate the prior."""
    halves = [(x[::2].copy(), x[1::2].copy()) for x in (positive, unlabelled)]
    prior = PRIOR
    if all(len(x) >= LEAST_ROWS for pair in halves for x in pair):
        w, mean, spread = fit(halves[0][0], halves[1][0], 0.5)
        scores = [((x[:, :-1] - mean) / spread).clip(-8, 8) @ w[:-1] + w[-1] for _, x in halves]
        prior = class_prior(*scores)
    return *fit(positive, unlabelled, prior), prior


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """Distinct ``key`` of about ``most`` rows at most: those whose hash falls below a share of its range.

    Nothing is sorted and no task sees more than its own rows; repeated rows share a key and count once.
    """
    n = rows.agg(F.approx_count_distinct("key", 0.01)).first()[0]
    below = F.col("key") <= F.lit(-(2**63) + (2**64 - 1) * min(most, n) // max(n, 1))
    return rows.where(below).select("key").distinct()


def train(docs: DataFrame, labels: DataFrame, learnable: Column, most: int = MOST_ROWS) -> tuple:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; ``learnable`` is over doc_id.

    Only label 1 is read, and no label outside ``learnable``; the prior is estimated from the positives and the unlabelled,
    and is ``PRIOR`` where half of either sample has fewer than ``LEAST_ROWS``.
    Both samples are learnt from in one task, which returns the weights. Without positives or texts every text gets 0.5.
    """
    known = labels.where(learnable & (F.col("quality") == 1)).select("doc_id").distinct()
    keyed = docs.where(learnable).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    named = keyed.join(known, "doc_id", "left_semi").select("key")
    keys = sampled(named, most).select("key", F.lit(True).alias("positive"))
    keys = publish(keys.unionByName(sampled(keyed.select("key"), most).select("key", F.lit(False).alias("positive"))), "sample-keys")
    texts = keyed.join(F.broadcast(keys.select("key").distinct()), "key", "left_semi").select("key", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                made = [features(t).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary())], ["key", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(len(batch), -1)
            chosen = batch.column("positive").to_numpy(zero_copy_only=False)
            for side, parts in samples.items():
                parts.append(np.column_stack([held[chosen == side], np.ones((chosen == side).sum(), np.float32)]))
        positive, unlabelled = (np.concatenate(x) if x else np.zeros((0, 0), np.float32) for x in samples.values())
        if len(positive) and len(unlabelled):
            parts = [pa.array([x], pa.list_(pa.float64())) for x in learn(positive, unlabelled)[:3]]
            yield pa.RecordBatch.from_arrays(parts, ["weights", "means", "deviations"])

    made = publish(texts.mapInArrow(vectors, "key long, vector binary").dropDuplicates(["key"]), "sample")
    ordered = made.join(keys, "key").repartition(1).sortWithinPartitions("key")
    model = ordered.select("positive", "vector").mapInArrow(run, "weights array<double>, means array<double>, deviations array<double>")
    model = publish(model, "weights").first()
    if model is None:
        return np.zeros(DENSE + BUCKETS + 1), np.zeros(DENSE + BUCKETS), np.ones(DENSE + BUCKETS)
    return np.array(model.weights), np.array(model.means), np.array(model.deviations)


def score(docs: DataFrame, model: tuple, name: str = "quality_score") -> DataFrame:
    """The rows of ``docs`` with a score (0 to 1) appended as ``name``; a null text is empty. Any other columns are carried
    (one of that name is replaced); repeated rows stay; an empty table gives no rows."""
    w, mean, spread = model
    rest = [c for c in docs.columns if c != name]
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])  # names without dots for the call
    text = f"c{rest.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, text):
                x = np.array([features(t) for t in batch.column(text).to_pylist()])
                z = ((x - mean) / spread).clip(-8, 8) @ w[:-1] + w[-1]
                value = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, "score"])

    return given.mapInArrow(run, StructType([*given.schema.fields, StructField("score", DoubleType())])).toDF(*rest, name)
