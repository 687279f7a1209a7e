"""Merkle manifest, chat formatting and tokenizer alignment against plain Python, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import groupby
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulcast.llm import chat_format as chat
from haulcast.llm import merkle_manifest as merkle
from haulcast.llm import tokenizer_alignment as alignment


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key(value):
    return (value is not None, value if value is not None else 0)


def tree(digests: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root, and each leaf's siblings from the leaf up."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append((k % 16, run[: k % 16] + run[k % 16 + 1 :]))
            at[i] = k // 16
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def climb(digest: str, path) -> str:
    for place, others in path:
        digest = sha("".join(others[:place] + [digest] + others[place:]))
    return digest


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, rank string, tree string, digest string"


def merkle_rows(sizes: dict) -> list[tuple]:
    rows = [(i, s, "en", i, f"Text {i} É", "a", "b", "c") for s, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        merkle_rows({"a": 1}),
        merkle_rows({None: 17, "": 16, "a": 1, "é": 300, "z": 33}),
        merkle_rows({f"s{i}": i % 3 + 1 for i in range(20)}) + [(None, "s1", None, None, None, None, None, None)] * 2,
        [(5, "a", "en", 1, "same", "x", "y", "z")] * 300 + merkle_rows({"b": 2}),
    ],
)
def test_merkle_manifest_against_a_plain_tree(spark, rows):
    frame = spark.createDataFrame(rows, MERKLE).repartition(5)
    leaves = frame.select("doc_id", "source", merkle.leaf_digest([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    manifest = merkle.build(leaves)
    got = merkle.prove(manifest).join(manifest.trees.select("tree", F.col("digest").alias("subroot")), "tree")
    got = got.withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("hashed", merkle.proof_digest(F.col("proof")))

    made = sorted(((r[1], r[0], sha("".join(map(field, r[:5])))) for r in rows), key=lambda r: (key(r[0])[0], (r[0] or "").encode(), key(r[1]), r[2]))
    groups = [(s, list(g)) for s, g in groupby(made, key=lambda r: r[0])]
    subtrees = [tree([r[2] for r in g]) for _, g in groups]
    root, above = tree([t[0] for t in subtrees])
    expected = []
    for (_, g), (subroot, paths), top in zip(groups, subtrees, above):
        for r, path in zip(g, paths):
            assert climb(r[2], path + top) == root
            expected.append((r[1], r[2], subroot, sha("".join("".join(o) for _, o in path + top)), root))
    assert manifest.root == root
    found = [(r.doc_id, r.leaf, r.subroot, r.hashed, r.back) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_merkle_proofs_of_some_leaves_only(spark):
    frame = spark.createDataFrame(merkle_rows({"a": 40, "b": 300}), MERKLE)
    manifest = merkle.build(frame.select("doc_id", "source", merkle.leaf_digest([F.col(c) for c in merkle.FIELDS]).alias("leaf")))
    asked = manifest.leaves.where("source = 'b' and doc_id in (7, 299)")
    proved = merkle.prove(manifest, asked)
    assert [r.doc_id for r in proved.orderBy("doc_id").collect()] == [7, 299]
    assert proved.where(merkle.fold(F.col("leaf"), F.col("proof")) != manifest.root).count() == 0
    assert proved.where(merkle.fold(F.sha2(F.lit("other"), 256), F.col("proof")) == manifest.root).count() == 0


def test_merkle_manifest_of_nothing(spark):
    manifest = merkle.build(spark.createDataFrame([], "doc_id long, source string, leaf string"))
    assert manifest.root is None
    assert merkle.prove(manifest).count() == 0


CHAT = "conv_id long, turn long, role string, text string, formatted string, piece string, at string"
TRICKY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\NEXT][/ROLE]", "[NEXT]", "<s", "s>", "<", "", None, "[/ROLE]x\n", "$1\\", "é\U0001f600"]


def chat_rows(spark, seed: int):
    pick = random.Random(seed)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(pick.choice([1, 2, 5, 9])):
            rows.append((conv, turn, pick.choice(["user", "assistant", "system", None, "<s>"]), pick.choice(TRICKY), "x", "y", "z"))
    rows += [(100, t // 3, pick.choice(["user", "assistant"]), pick.choice(TRICKY), "", "", "") for t in range(900)]  # ties, several pieces
    rows += [(101, None, "assistant", "same", "", "", "")] * 700  # one message over many pieces, null turns, repeated rows
    rows += [(102, t, "user", "very long " * 20000, "", "", "") for t in range(2)]
    pick.shuffle(rows)
    return spark.createDataFrame(rows, CHAT).repartition(3), rows


def test_chats_are_read_back_as_they_were(spark):
    frame, rows = chat_rows(spark, 1)
    chats = chat.chat_format(frame).cache()
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    made = {}
    for conv, turn, role, text, *_ in rows:
        made.setdefault(conv, []).append((key(turn), role or "", text or ""))
    assert back.keys() == made.keys()
    for conv, turns in made.items():
        turns = [t[1:] for t in sorted(turns)]
        assert [tuple(t) for t in back[conv].turns] == turns
        assert back[conv].loss == "".join(t for r, t in turns if r == "assistant")
        messages = sum(1 for _ in groupby(turns, key=lambda t: t[0]))
        whole = "".join(r.formatted for r in sorted((r for r in chats.where(F.col("conv_id").eqNullSafe(F.lit(conv))).collect()), key=lambda r: r.piece)) if conv in (100, 101, None) else None
        if whole is not None:
            assert whole.count(chat.OPEN) == whole.count(chat.CLOSE) == messages
            assert whole.count(chat.NEXT) == len(turns) - messages
            assert len(whole) == back[conv].formatted_chars
    assert chats.where("conv_id = 100").count() > 10
    assert chats.groupBy().agg(F.max("n_turns")).first()[0] <= chat.LONG_TURNS
    assert chats.agg(F.sum("n_turns")).first()[0] == len(rows)
    chats.unpersist()


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    pick = random.Random(3)
    parts = ["<", "[", "\\", "/", "s>", "ROLE]", "NEXT]", "INST]", "</s>", "a", "\n"]
    texts = ["".join(pick.choice(parts) for _ in range(12)) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("safe", chat.escape(F.col("text")))
    for r in frame.withColumn("back", chat.unescape(F.col("safe"))).collect():
        assert r.back == r.text
        assert not any(c in r.safe for c in (chat.OPEN, chat.CLOSE, chat.ROLE_END, chat.NEXT, "[INST]", "[/INST]"))


def test_no_chats(spark):
    assert chat.read_back(chat.chat_format(spark.createDataFrame([], CHAT))).count() == 0


BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs):
    return alignment.tokenizer_alignment(docs, Path(BYTES).read_text(), public_tokenizers.PATTERN, Path(PIECES).read_bytes())


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    """The contract's columns by direct comparison of byte ranges, without windows, blocks or the faster encoder."""
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = alignment.byte_of()
    rows, held = [], Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text, num_threads=1) if text else []
        left = [bytes(table[c] for c in first.id_to_token(i)) for i in a]
        right = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            rows.append(None)
            continue
        end, ends = 0, []
        for t in left:
            ends.append(end := end + len(t))
        other, end = [], 0
        for t in right:
            other.append(end := end + len(t))
        cuts = sorted(set(ends) & set(other))
        groups = [([], []) for _ in cuts]
        for ids, at, side in ((a, ends, 0), (b, other, 1)):
            k = 0
            for i, e in zip(ids, at):
                while e > cuts[k]:
                    k += 1
                groups[k][side].append(i)
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(links.keys())
        rows.append((len(a), len(b), groups, links))
    highest = {}
    for (x, _), n in held.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for (x, y), n in links.items() if held[x, y] == highest[x])
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * held[k] for k, n in links.items()), sha(written)))
    return out


def alignment_texts(spark) -> list[str | None]:
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    odd = [None, "", " ", "a", "  two  spaces ", "\u2581", "a\u2581b", "<s>hi</s><|endoftext|>", "\n\n\tx\r\n", "\U0001f600\u0301 e\u0301", "x" * 5000, "\x00", "日本語 текст", "  "]
    return given + odd + ["the same text"] * 5


def test_alignment_against_byte_ranges(spark, monkeypatch):
    texts = alignment_texts(spark)
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, windows string, a int")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = sorted(zip([i if i % 9 else None for i in range(len(texts))], plain_alignment(texts)), key=repr)
    got = sorted(((r.doc_id, tuple(r[n] for n in names)) for r in align(docs.repartition(3)).collect()), key=repr)
    assert got == expected


def test_alignment_in_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    texts = alignment_texts(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert alignment.aligned(docs, Path(BYTES).read_text(), public_tokenizers.PATTERN, Path(PIECES).read_bytes()).select("block").distinct().count() > 5
    got = sorted((r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align(docs).collect())
    assert got == [(i, r[3], r[4], r[5], r[6]) for i, r in enumerate(plain_alignment(texts))]


def test_alignment_of_nothing(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_the_faster_encoder_gives_the_library_s_ids():
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    faster = alignment.ByteTokens(Path(BYTES).read_text(), public_tokenizers.PATTERN)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 2048):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}.{chr(c)}{chr(c)} 's{chr(c)}" for c in points[i : i + 2048])
        assert faster.encode(text) == library.encode(" " + text, add_special_tokens=False).ids


def test_a_piece_is_encoded_once_wherever_it_stands():
    """Pieces between spaces give the digests, counts and links of whole texts, and no characters are encoded twice."""
    rng = np.random.default_rng(13)
    parts = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "the", "'s", "9", "é", "日本", "▁", ".", "!!", "́", "\U0001f600", "<s>", "\x00", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(3000)]
    a, b = alignment.ByteTokens(Path(BYTES).read_text(), public_tokenizers.PATTERN), alignment.PieceTokens(Path(PIECES).read_bytes())
    got = []
    for by_pieces in (True, False):
        block = alignment.Block(0, alignment.Alignments(), a, b)
        assert block.by_pieces
        block.by_pieces = by_pieces
        for i, text in enumerate(texts):
            block.add(i, text)
        docs, pairs = (batch.to_pydict() for batch in block.batches())
        rows = list(zip(*(docs[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "groups_sha256"))))
        got.append((rows, sorted(zip(pairs["a"], pairs["b"], pairs["docs"]))))
    assert got[0] == got[1]
    encoded = []
    a.encode = lambda text, own=a.encode: encoded.append(text) or own(text)
    block = alignment.Block(0, alignment.Alignments(), a, b)
    for i, text in enumerate(["one two three", "three two two", "two four. one"]):
        block.add(i, text)
    assert encoded == ["one two three", "four."]
