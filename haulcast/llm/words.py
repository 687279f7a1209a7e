"""Words of whole texts as integer codes: numpy and Arrow helpers used inside tasks.

A word is a run of characters other than space and the control characters tab to carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 8 << 20


def n_words(text: Column) -> Column:
    """Words of a text column, 0 for null; only one-character matches are replaced, so it is linear in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together stay near ``limit`` bytes; a longer text is a run of its own, whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    run = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for start, end in zip(starts, np.r_[starts[1:], len(sizes)]):
        yield batch.slice(int(start), int(end - start))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Codes of all words in order, the distinct words, and where each text's words start (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    codes, distinct = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # white space at either end of a text leaves an empty piece
        kept = codes != empty
        bounds = np.r_[0, np.cumsum(kept)][bounds]
        codes = codes[kept]
    return codes, distinct, bounds


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same on every machine."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """``values[starts[c]:starts[c] + lengths[c]]`` for every code, end to end."""
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts[codes] - (ends - sizes), sizes)
    return values[shift + np.arange(len(shift))]
