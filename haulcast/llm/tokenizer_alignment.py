"""Alignment of two tokenizers over the same bytes: groups of tokens that cover the same range, and how often ids are linked.

Every whole text is encoded, piece by piece between spaces where no token of either tokenizer can span the place before one
(``pieces``), else at once. A piece is aligned once a block. In a text encoded at once, where tokens of both end at the same byte and the next token of both begins with a
space (or the text ends), an anchor cuts the document into windows of token ids. A window is aligned once for its tuple of
ids and remembered: its groups as text and its links. Documents are dealt with in blocks of a bounded size of text; a
block lists its distinct id pairs once and its documents by their numbers, so that what is counted for the corpus is one
row for each block and pair, never one for each token.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from haulcast.llm.storage import publish
from haulcast.llm.words import blocks, ragged_take

BLOCK_BYTES = 16 << 20  # text of a block
CHUNK_BYTES = 1 << 20  # text whose tokens are held at a time
REMEMBERED = 500_000  # windows, and groups, kept in a task's memory between blocks
LONGEST = 64  # characters of a piece that is kept between blocks
#: A split pattern none of whose matches spans a space after a character other than white space.
PARTED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SECOND = np.uint32(1 << 31)  # marks ids of the second tokenizer in a window's key

# A row for each document (its distinct pairs by number, and how often it holds each, as bytes) and for each distinct pair.
WRITTEN = """
block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, pairs binary,
times binary, pair int, a int, b int, docs int
"""
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """The bytes of every id, how long they are, and whether they begin with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def byte_of() -> dict[str, int]:
    """Byte-level alphabets write printable bytes as themselves and the others as the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokens:
    """A byte-level BPE from its JSON file; strings of special tokens are ordinary text.

    The ids are those of the ``tokenizers`` library, by a faster encoder of the same vocabulary and split pattern.
    """

    def __init__(self, tokenizer_json: str, pattern: str):
        file, table = json.loads(tokenizer_json), byte_of()
        self.pattern = pattern
        special = {t["id"] for t in file["added_tokens"]}
        vocabulary = {i: bytes(table[c] for c in t) for t, i in file["model"]["vocab"].items() if i not in special}
        self.encoding = tiktoken.Encoding(
            "bytes", pat_str=pattern, mergeable_ranks={t: i for i, t in vocabulary.items()}, special_tokens={}
        )
        self.vocabulary = Vocabulary([vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)])

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class PieceTokens:
    """A sentence-piece model with byte fallback that puts a space before the text."""

    def __init__(self, model: bytes):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.vocabulary = Vocabulary(
            [
                bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
                for i in range(p.get_piece_size())
            ]
        )

    def encode(self, text: str) -> list[int]:
        return self.processor.encode(text, num_threads=1)

    def parts_at_spaces(self) -> bool:
        """Whether no token has a space after another character, so that none spans the place before one."""
        return not any(b" " in t.lstrip(b" ") for t in self.vocabulary.tokens)


class Alignments:
    """Alignments that a task remembers by their ids: groups as text, their number, linked pairs with repeats.

    A key holds, group after group, the ids of the first tokenizer and the marked ids of the second. A linked pair is one
    integer. The groups that windows consist of are remembered too.
    """

    def __init__(self):
        self.windows: dict[bytes, tuple[str, int, list[int]]] = {}
        self.groups: dict[bytes, tuple[str, list[int]]] = {}
        self.pieces: dict[str, tuple[str, int, list[int], int, int]] = {}

    def forget(self) -> None:
        if len(self.windows) > REMEMBERED:
            self.windows.clear()
        if len(self.groups) > REMEMBERED:
            self.groups.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()

    def group(self, key: bytes) -> tuple[str, list[int]]:
        ids = np.frombuffer(key, np.uint32)
        first, second = ids[ids < SECOND].tolist(), (ids[ids >= SECOND] - SECOND).tolist()
        text = ",".join(map(str, first)) + "|" + ",".join(map(str, second))
        made = self.groups[key] = (text, [x << 32 | y for x in first for y in second])
        return made

    def window(self, key: bytes, groups: list[bytes]) -> tuple[str, int, list[int]]:
        """The alignment of a window that consists of the groups, remembered under ``key``."""
        known = self.groups
        parts = [known.get(g) or self.group(g) for g in groups]
        pairs = [p for _, linked in parts for p in linked]
        made = self.windows[key] = (";".join([text for text, _ in parts]), len(parts), pairs)
        return made


def shared_ends(a: np.ndarray, b: np.ndarray, first: Vocabulary, second: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of one text, how many of either tokenizer stand before each end that both share, and which of those
    ends are anchors: the next tokens of both begin with a space, or the text ends."""
    ends_a, ends_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    near = np.searchsorted(ends_b, ends_a)  # both end with the text, so no place is beyond
    at_a = np.flatnonzero(ends_b[near] == ends_a)
    at_a, at_b = at_a + 1, near[at_a] + 1
    anchor = np.ones(len(at_a), bool)
    anchor[:-1] = first.spaced[a[at_a[:-1]]] & second.spaced[b[at_b[:-1]]]
    return at_a, at_b, anchor


def in_groups(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> bytes:
    """The ids group by group, those of the first tokenizer before the marked ones of the second."""
    both = np.empty(len(a) + len(b), np.uint32)
    size_a, size_b = np.diff(at_a, prepend=0), np.diff(at_b, prepend=0)
    both[np.arange(len(a)) + np.repeat(at_b - size_b, size_a)] = a
    both[np.arange(len(b)) + np.repeat(at_a, size_b)] = b | SECOND
    return both.tobytes()


def pieces(text: str) -> list[str]:
    """A text cut at the spaces that stand after another character than white space.

    No token of either tokenizer spans the place before such a space, and none depends on what is beyond it. So a piece
    with a space before it has the same tokens wherever it stands; one that ends with white space is the last.
    """
    parts = text.split(" ")
    out = parts[:1]
    for part in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


class Block:
    """The documents of up to ``BLOCK_BYTES`` of text, their distinct windows and their distinct pairs."""

    def __init__(self, number: int, known: Alignments, a: ByteTokens, b: PieceTokens):
        self.number, self.known, self.a, self.b = number, known, a, b
        self.place: dict[bytes | str, int] = {}  # of the block's distinct windows and pieces, whose alignments follow
        self.by_pieces = a.pattern == PARTED and b.parts_at_spaces()
        self.n_a: list[int] = []  # tokens of a piece; the windows of texts dealt with whole have 0
        self.n_b: list[int] = []
        self.texts: list[str] = []
        self.n_groups: list[int] = []
        self.pairs: list[list[int]] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.size += len(text)
        found, n_a, n_b = self._pieces(text) if self.by_pieces else None, 0, 0
        if found is not None:
            n_a, n_b = sum(map(self.n_a.__getitem__, found)), sum(map(self.n_b.__getitem__, found))
        elif text:
            found, n_a, n_b = self._whole(text)
        if not found:
            self.docs.append((doc_id, 0, 0, "", np.zeros(0, np.int32)))
            return
        digest = hashlib.sha256(";".join(map(self.texts.__getitem__, found)).encode()).hexdigest()
        self.docs.append((doc_id, n_a, n_b, digest, np.array(found, np.int32)))

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both tokenizers' ids, None unless both join to a space and the text."""
        ids_a, ids_b, own = self.a.encode(text), self.b.encode(text), (" " + text).encode()
        if self.a.vocabulary.joined(ids_a) != own or self.b.vocabulary.joined(ids_b) != own:
            return None
        return np.array(ids_a, np.uint32), np.array(ids_b, np.uint32)

    def _whole(self, text: str) -> tuple[list[int], int, int]:
        """The places of a text's windows, and how many tokens it has; no places where the bytes differ."""
        both = self._encoded(text)
        if both is None:
            return [], 0, 0
        a, b = both
        at_a, at_b, anchor = shared_ends(a, b, self.a.vocabulary, self.b.vocabulary)
        data, cuts = in_groups(a, b, at_a, at_b), [0, *(4 * (at_a + at_b)).tolist()]
        windows = [0, *(np.flatnonzero(anchor) + 1).tolist()]
        ends = list(map(cuts.__getitem__, windows))
        keys = [data[s:e] for s, e in zip(ends, ends[1:])]
        found = list(map(self.place.get, keys))
        if None in found:
            self._place_new(keys, found, data, cuts, windows)
        return found, len(a), len(b)

    def _place_new(self, keys: list[bytes], found: list, data: bytes, cuts: list[int], windows: list[int]) -> None:
        """Align the windows that the block has not met, and fill in their places."""
        place, known = self.place, self.known
        for k, at in enumerate(found):
            if at is not None:
                continue
            key = keys[k]
            at = place.get(key)
            if at is None:
                made = known.windows.get(key)
                if made is None:
                    ends = cuts[windows[k] : windows[k + 1] + 1]
                    made = known.window(key, [data[s:e] for s, e in zip(ends, ends[1:])])
                at = place[key] = self._append(*made)
            found[k] = at

    def _append(self, text: str, n_groups: int, pairs: list[int], n_a: int = 0, n_b: int = 0) -> int:
        for values, value in zip((self.texts, self.n_groups, self.pairs, self.n_a, self.n_b), (text, n_groups, pairs, n_a, n_b)):
            values.append(value)
        return len(self.texts) - 1

    def _pieces(self, text: str) -> list[int] | None:
        """The places of a text's pieces, None if it has to be dealt with whole."""
        place, known = self.place, self.known.pieces
        found = list(map(place.get, text.split(" ")))
        if None not in found:  # whatever is placed is a piece wherever it stands
            return found
        parts = pieces(text)
        own = {p: place.get(p) for p in parts}
        met = [p for p, at in own.items() if at is None]
        new = [p for p in met if p not in known]
        made = dict(zip(new, self._aligned(new) or [])) if new else {}
        if len(made) < len(new):
            return None
        for p in met:
            alignment = known[p] if p in known else made[p]
            at = own[p] = self._append(*alignment)
            if p and not p[-1].isspace():
                place[p] = at
                if len(p) <= LONGEST:
                    known[p] = alignment
        return list(map(own.__getitem__, parts))

    def _aligned(self, parts: list[str]) -> list[tuple] | None:
        """Groups as text, their number, linked pairs, tokens of either kind of pieces encoded together; None unless bytes and ends fit."""
        both = self._encoded(" ".join(parts))
        if both is None:
            return None
        (a, b), first, second = both, self.a.vocabulary, self.b.vocabulary
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        at_a, at_b, _ = shared_ends(a, b, first, second)
        shared = np.cumsum(first.lengths[a])[at_a - 1]
        last = np.searchsorted(shared, ends)
        if not np.array_equal(shared[last], ends):
            return None
        data, cuts = in_groups(a, b, at_a, at_b), [0, *(4 * (at_a + at_b)).tolist()]
        n_a, n_b = np.diff(at_a[last], prepend=0).tolist(), np.diff(at_b[last], prepend=0).tolist()
        known, out, start = self.known.groups, [], 0
        for end, x, y in zip((last + 1).tolist(), n_a, n_b):
            keys = [data[cuts[k] : cuts[k + 1]] for k in range(start, end)]
            found = [known.get(g) or self.known.group(g) for g in keys]
            out.append((";".join([t for t, _ in found]), len(found), [p for _, linked in found for p in linked], x, y))
            start = end
        return out

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of the documents, and of the distinct pairs with the number of documents that hold them."""
        sizes, n_groups = np.fromiter(map(len, self.pairs), np.int64, len(self.pairs)), np.array(self.n_groups, np.int64)
        flat = np.fromiter(chain.from_iterable(self.pairs), np.int64, int(sizes.sum()))
        codes, inverse = np.unique(flat, return_inverse=True)
        starts, docs, links = np.cumsum(sizes) - sizes, np.zeros(len(codes), np.int32), []
        for *_, windows in self.docs:
            held, times = counted(ragged_take(inverse, starts, sizes, windows), len(codes))
            docs[held] += 1
            links.append((n_groups[windows].sum(), times.sum(), len(held), narrow(held), narrow(times)))
        doc_id, n_a, n_b, digest, _ = zip(*self.docs)
        named = dict(zip(("n_groups", "n_links", "n_pairs", "pairs", "times"), zip(*links)))
        yield self._rows(len(doc_id), doc_id=doc_id, n_a=n_a, n_b=n_b, groups_sha256=digest, **named)
        if len(codes):
            yield self._rows(len(codes), pair=np.arange(len(codes)), a=codes >> 32, b=codes & 0xFFFFFFFF, docs=docs)

    def _rows(self, n: int, **columns) -> pa.RecordBatch:
        arrays = [
            pa.array(np.full(n, self.number)) if f.name == "block"
            else pa.nulls(n, f.type) if f.name not in columns
            else pa.array(columns[f.name], f.type)
            for f in _ARROW
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def counted(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values below n, ascending, and how often each comes: by whichever way costs less."""
    if 8 * len(values) < n:
        return np.unique(values, return_counts=True)
    times = np.bincount(values, minlength=n)
    held = np.flatnonzero(times)
    return held, times[held]


def narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def widened(rows: list[bytes], counts: np.ndarray) -> np.ndarray:
    """What ``narrow`` made of several arrays, end to end; the width follows from the number of values."""
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    parts = [np.frombuffer(r, kinds[len(r) // n]).astype(np.int64) for r, n in zip(rows, counts.tolist()) if n]
    return np.concatenate([np.zeros(0, np.int64), *parts])


_KIND = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split()[0], _KIND[c.split()[1]]) for c in WRITTEN.replace("\n", " ").split(",")])


def aligned(docs: DataFrame, byte_json: str, pattern: str, piece_model: bytes) -> DataFrame:
    """Rows of ``WRITTEN``: documents and pairs of every block, told apart by which columns are null."""
    files = docs.sparkSession.sparkContext.broadcast((byte_json, pattern, piece_model))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteTokens(*files.value[:2]), PieceTokens(files.value[2])
        known = Alignments()
        number = TaskContext.get().partitionId() << 32
        block = Block(number, known, a, b)
        for whole in batches:
            for batch in blocks(whole, limit=CHUNK_BYTES):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    block.add(doc_id, text or "")
                if block.size >= BLOCK_BYTES:
                    yield from block.batches()
                    known.forget()
                    number += 1
                    block = Block(number, known, a, b)
        if block.docs:
            yield from block.batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, WRITTEN)


def _scored(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """One block: the counts of its pairs summed over each document's links."""
    order = np.argsort(pairs.column("pair").to_numpy())
    count, best = pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy()[order].astype(np.int64)
    sizes = docs.column("n_pairs").to_numpy().astype(np.int64)
    held, times = (widened(docs.column(c).to_pylist(), sizes) for c in ("pairs", "times"))
    ends = np.cumsum(sizes)
    totals = []
    for value in (best, count):
        running = np.r_[0, np.cumsum(times * value[held])]
        totals.append(pa.array(running[ends] - running[ends - sizes], pa.int64()))
    kept = {name: docs.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(kept | {"n_best": totals[0], "count_sum": totals[1], "groups_sha256": docs.column("groups_sha256")})


def tokenizer_alignment(docs: DataFrame, byte_json: str, pattern: str, piece_model: bytes) -> DataFrame:
    """``RESULT`` for every row of ``docs(doc_id, text)``; other columns are not read.

    A null or empty text, or one whose tokens don't join to a space and the text, has zeros and an empty digest. Repeated
    rows and ids stay rows of their own and each counts as a document. An empty table gives no row.
    """
    written = publish(aligned(docs, byte_json, pattern, piece_model), "aligned")
    pairs = written.where("pair is not null").select("block", "pair", "a", "b", "docs")
    total = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    highest = F.max("count").over(Window.partitionBy("a"))  # at most as many rows as the second vocabulary has ids
    total = total.withColumn("best", F.col("count") == highest)
    scored = pairs.drop("docs").join(total, ["a", "b"]).select(F.col("block").alias("of"), "pair", "count", "best")
    own = written.where("pair is null").drop("pair", "a", "b", "docs")
    return own.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(_scored, RESULT)
