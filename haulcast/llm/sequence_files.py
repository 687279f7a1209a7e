"""Token ids as Arrow stream files of fixed-size lists: equal-length sequences and their masks.

A file holds the ids of a range of documents end to end, cut into sequences of one length; the mask has a bit for each
place, unset for padding. Ids take two bytes where the vocabulary allows. As all lists have one length, sequence i of a
memory-mapped file is a slice of its buffer. Beside each file lies an index with the documents' ids and places. A task
writes under a name of its own attempt and reports it, so that what a lost task left is never read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.storage import publish
from haulcast.llm.words import blocks, ragged_take, word_codes

LENGTH = 2048
BATCH = 256  # sequences a record batch
END = 2
FILE_BYTES = 64 << 20  # text a file is meant to hold
BLOCK_BYTES = 8 << 20  # text encoded at a time
AT_A_TIME = 4096  # texts or words in a call of the library
MARKS = ".,;:!?"
REMEMBERED = 1_000_000  # words whose ids a task keeps


def schema_of(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """One file and its index; memory stays at a batch of sequences besides the block that is added."""

    def __init__(self, system: fs.FileSystem, path: str, length: int, kind: np.dtype):
        self.length, self.at, self.schema = length, 0, schema_of(length, kind)
        self.ids = np.zeros(0, kind)
        self.files = [system.open_output_stream(path), system.open_output_stream(path + ".index")]
        self.data = pa.ipc.new_stream(self.files[0], self.schema)
        self.index = pa.ipc.new_stream(self.files[1], INDEX)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents of ``sizes`` ids, all of them end to end in ``ids``."""
        starts = self.at + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.at += len(ids)
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        step = self.length * BATCH
        while len(self.ids) >= step:
            self._write(self.ids[:step], step)
            self.ids = self.ids[step:]

    def _write(self, ids: np.ndarray, held: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < held)]
        self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if held := len(self.ids):
            self._write(np.pad(self.ids, (0, -held % self.length)), held)
        for x in (self.data, self.index, *self.files):
            x.close()


class Sequences:
    """Sequence i of a file and its mask, as read-only slices of the memory-mapped file; nothing is copied.

    The file must be in a local file system, as only that can be mapped.
    """

    def __init__(self, path: str):
        system, local = fs.FileSystem.from_uri(path)
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError(f"only a local file can be memory-mapped: {path}")
        self.mapped = pa.memory_map(local)
        self.batches = list(pa.ipc.open_stream(self.mapped))
        self.ends = np.cumsum([len(b) for b in self.batches], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.ends, i, "right"))
        at = i - (int(self.ends[k]) - len(self.batches[k]))
        ids, mask = (self.batches[k].column(c)[at].values for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask


class WholeTexts:
    """Ids of texts, each encoded whole."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has. What the library returns is large, so few at a time."""
        parts, sizes = [np.zeros(0, np.uint32)], []
        for i in range(0, len(texts), AT_A_TIME):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_A_TIME], add_special_tokens=False)]
            sizes += map(len, got)
            parts.append(np.fromiter(chain.from_iterable(got), np.uint32))
        return np.concatenate(parts), np.array(sizes, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.ids_of(pc.fill_null(texts, "").to_pylist())


def stem_and_marks(word: str) -> tuple[str, str]:
    """A word as what it is remembered by: in lower case if it is ASCII, and marks after a letter or digit apart."""
    stem = word.rstrip(MARKS)
    if not stem or not (stem[-1].isalnum() and stem[-1] < "\u0250" and len(stem[-1].lower()) == 1):
        stem = word
    marks = word[len(stem) :]
    return (stem.lower() if stem.isascii() and "<" not in stem else stem), marks


class ByWords:
    """The same ids by words: each distinct word is encoded once and remembered, as its stem and the marks after it.

    For tokenizers that drop white space, fold case, and part letters and digits from ``MARKS`` (but for special tokens,
    which hold ``<``).
    """

    def __init__(self, tokenizer):
        self.whole = WholeTexts(tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _append(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _learn(self, words: list[str]) -> None:
        parts = [stem_and_marks(w) for w in words]
        fresh = list({p for pair in parts for p in pair if p not in self.place})
        self._append(fresh, *self.whole.ids_of(fresh))
        rest = [(w, pair) for w, pair in zip(words, parts) if w not in self.place]
        at = np.fromiter((self.place[p] for _, pair in rest for p in pair), np.int64, 2 * len(rest))
        joined = ragged_take(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, at)
        self._append([w for w, _ in rest], joined, self.sizes[at].reshape(-1, 2).sum(axis=1))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct, bounds = word_codes(texts)
        words = distinct.to_pylist()
        if len(self.place) > REMEMBERED:
            self._forget()
        self._learn([w for w in words if w not in self.place])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[codes]
        ends = np.r_[0, np.cumsum(self.sizes[at])][bounds]
        return ragged_take(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, at), np.diff(ends)


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` after the last id of every document."""
    out = np.full(len(ids) + len(sizes), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1


def write_sequences(
    docs: DataFrame, folder: str, tokenizer_json: str, length: int = LENGTH, end: int = END, by_words: bool = False
) -> DataFrame:
    """``file_no, path, n_docs, n_tokens``: the files written for ``docs(doc_id, text)``, in ascending order of doc_id.

    A null text is empty, so its only id is the end. Null doc_ids come first, repeated rows stay, other columns are not
    read. An empty table writes no file. ``by_words`` says that the tokenizer is of the kind that ``ByWords`` is for, so
    that a text's ids are those of its words end to end.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(1, ceil(size / FILE_BYTES))
    most = max(end, *json.loads(tokenizer_json)["model"]["vocab"].values(), *(t["id"] for t in json.loads(tokenizer_json)["added_tokens"]))
    kind = np.min_scalar_type(max(most, 256))
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = keys.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("file_no", F.spark_partition_id().cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library would each hold memory
        from tokenizers import Tokenizer

        tokenizer, writer, docs_ = Tokenizer.from_str(held.value), None, 0
        encode = (ByWords if by_words else WholeTexts)(tokenizer)
        path = f"{folder}/{uuid.uuid4().hex}.arrows"
        for whole in batches:
            for batch in blocks(whole, limit=BLOCK_BYTES):
                if writer is None:
                    number = batch.column("file_no")[0].as_py()
                    system, local = fs.FileSystem.from_uri(path)
                    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    writer = Writer(system, local, length, kind)
                writer.add(batch.column("doc_id"), *with_ends(*encode(batch.column("text")), end))
                docs_ += len(batch)
        if writer is not None:
            writer.close()
            row = [[number], [path], [docs_], [writer.at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["file_no", "path", "n_docs", "n_tokens"])

    written = ranged.mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long")
    return publish(written, "sequence-files")


def read_documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that ``write_sequences`` reports.

    ``start`` counts the ids of all documents before it. Only one row for each file meets in the running sum.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                system, local = fs.FileSystem.from_uri(path)
                with system.open_input_stream(local) as data, system.open_input_stream(local + ".index") as index:
                    stream, gone = pa.ipc.open_stream(data), 0
                    ids = np.zeros(0, stream.schema.field("ids").type.value_type.to_pandas_dtype())
                    for docs in pa.ipc.open_stream(index):
                        starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                        sums = []
                        for start, size in zip(starts.tolist(), sizes.tolist()):
                            parts = [ids]
                            held = gone + len(ids)
                            while held < start + size:
                                more = stream.read_next_batch()
                                kept = more.column("mask").flatten().to_numpy(zero_copy_only=False)
                                parts.append(more.column("ids").flatten().to_numpy()[kept])
                                held += len(parts[-1])
                            ids = np.concatenate(parts) if len(parts) > 1 else ids
                            own = ids[start - gone : start - gone + size]
                            sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                            ids, gone = ids[start - gone + size :], start + size
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), pa.array(starts + base), docs.column("n_tokens"), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spread = publish(placed.select("path", "before"), "places").repartition(n, "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
