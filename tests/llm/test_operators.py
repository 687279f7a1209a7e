"""Operators for training data against brute force on small tables with nulls, ties, repeated rows and other columns."""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import near_duplicates
from haulcast.llm import dom_marginals, log_bilinear, positive_unlabelled, sequence_files
from haulcast.llm import licence_scan as licence_scan_module
from haulcast.llm.best_fit_packing import best_fit, best_fit_packing
from haulcast.llm.embedding_near_dedup import embedding_near_dedup, united
from haulcast.llm.licence_scan import TEMPLATES, licence_scan
from haulcast.llm.ngram_jaccard_join import ngram_jaccard_join
from haulcast.llm.robust_outliers import robust_outliers
from haulcast.llm.sequence_files import Sequences, read_documents, write_sequences
from haulcast.llm.storage import new_path
from haulcast.llm.systematic_mix import repeated, systematic_mix, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, copies string, target string"
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \t\n", "a", prose(1, 60), prose(1, 60), prose(2, 300) + "\n" + prose(3, 40), prose(4, 9000)]
    texts += [prose(10 + i, 80 + i) for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", 1, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, prose(1, 60), None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert robust_outliers(none).count() == 0
    assert systematic_mix(none).count() == 0
    assert best_fit_packing(none).count() == 0
    assert ngram_jaccard_join(none).count() == 0
    assert licence_scan(none).count() == 0
    assert positive_unlabelled.score(none, positive_unlabelled.train(none, labels, F.lit(True))).count() == 0
    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    assert read_documents(write_sequences(none, new_path(spark, "none"), tokenizer)).count() == 0
    assert embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert dom_marginals.extract(pages, dom_marginals.train(dom_marginals.labelled_pages(pages))).count() == 0
    model = log_bilinear.train(none, F.lit(True))
    assert log_bilinear.score(none, model).count() == 0


def test_sequence_files_round_trip(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = read_documents(write_sequences(docs, new_path(spark, "sequences"), Path(path).read_text(), length=64)).collect()
    tokenizer, at = Tokenizer.from_file(path), 0
    given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: -1 if x[0] is None else x[0])
    want = []
    for doc_id, text in given:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_sequences_by_words_are_those_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(sequence_files, "REMEMBERED", 200)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    pick = np.random.default_rng(4)
    odd = [*"aZ9 .,'\t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2028\u3000\u0301\u03a3\u0130\ufb01\U0001f600\u200d", "<|endoftext|>", "'s", "\u00e9", "ab", None]
    given += ["".join(x for x in pick.choice(odd, 30) if x) for _ in range(2000)] + [None, ""]
    by_words, whole = sequence_files.ByWords(tokenizer), sequence_files.WholeTexts(tokenizer)
    for i in range(0, len(given), 300):
        for a, b in zip(by_words(pa.array(given[i : i + 300], pa.string())), whole(pa.array(given[i : i + 300], pa.string()))):
            assert a.tolist() == b.tolist()


def test_memory_mapped_sequences(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    files = write_sequences(docs, new_path(spark, "sequences"), Path(path).read_text(), length=16).collect()
    assert files
    for file in files:
        with pa.OSFile(file.path.removeprefix("file://")) as data:
            table = pa.ipc.open_stream(data).read_all()
        streamed = list(zip(table.column("ids").to_pylist(), table.column("mask").to_pylist()))
        mapped = Sequences(file.path)
        held = pa.total_allocated_bytes()
        assert len(mapped) == len(streamed) > 256
        for i in reversed(range(len(mapped))):
            ids, mask = mapped[i]
            assert (ids.tolist(), mask.tolist()) == streamed[i] and not ids.flags.writeable
        assert pa.total_allocated_bytes() == held
        with pytest.raises(IndexError):
            mapped[len(mapped)]


def reshared(sizes, weights):
    """Targets by repeated resharing, as the contract words it."""
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        out = [3 * s if i in full else rest * w / share for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i in range(len(sizes)) if i not in full and out[i] > 3 * sizes[i] + 1e-9}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 50, 900, 3, 40], [0, 5, 5], [7]])
def test_targets_reshare_the_excess(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in targets(table).orderBy("source").collect()]
    assert got == pytest.approx(reshared(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_mix_keeps_rows_and_bounds(docs):
    mixed = systematic_mix(docs)
    rows = mixed.select("doc.doc_id", "size", "source_size", "target", "copies").collect()
    again = systematic_mix(docs).select("doc.doc_id", "size", "source_size", "target", "copies").collect()
    key = lambda r: str(tuple(r))
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == docs.count()
    assert all(0 <= r.copies <= 3 for r in rows)
    assert repeated(mixed).columns == docs.columns
    assert repeated(mixed).count() == sum(r.copies for r in rows)


def test_mix_keeps_every_row_if_later_scans_are_split_otherwise(spark, docs):
    path = new_path(spark, "source")
    docs.repartition(8).write.parquet(path)
    mixed = systematic_mix(spark.read.parquet(path)).select("doc.doc_id", "doc.source", "size", "source_size", "copies")
    conf = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    given = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = mixed.collect()
    finally:
        for k, v in given.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_near_duplicates_keep_one_row_of_every_class(spark):
    """Ids repeated over different texts lose no class; rows without an id keep no copy."""
    a, b, c, d = (prose(i, 200) for i in (1, 2, 3, 4))
    near = lambda t: t + " thirteen"
    rows = [(1, a), (1, b), (1, near(a)), (2, b), (None, c), (None, near(c)), (None, a), (3, d), (3, d), (4, near(d)), (5, None)]
    table = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in near_duplicates(spark, table, "").collect()]
    kept = lambda i, *texts: sum((i, t) in got for t in texts)
    assert len(got) == 5
    assert kept(1, a, near(a)) == kept(1, b) == kept(None, c, near(c)) == kept(3, d) == kept(5, None) == 1


def test_base_counts(docs):
    for r in robust_outliers(docs).collect():
        text = r.doc.text or ""
        w, covered = words(text), set()
        times = Counter(zip(w, w[1:], w[2:]))
        for i in range(len(w) - 2):
            if times[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_packing_packs_every_word_once(docs):
    rows = best_fit_packing(docs, capacity=500, per_source=2).collect()
    assert sum(r.n_words for r in rows) == sum(len(words(r.text)) for r in docs.collect())
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.start, r.n_words))
    for held in bins.values():
        held.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 500


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    size, source, cluster = np.sort(rng.integers(1, 60, 300))[::-1], rng.integers(0, 4, 300), rng.integers(0, 30, 300)
    bins, _ = best_fit(size, source, cluster, 100, 2)
    held: list[list[int]] = []
    for i in range(300):
        fits = [
            (100 - sum(size[j] for j in b), k)
            for k, b in enumerate(held)
            if 100 - sum(size[j] for j in b) >= size[i]
            and cluster[i] not in [cluster[j] for j in b]
            and sum(source[j] == source[i] for j in b) < 2
        ]
        k = min(fits)[1] if fits else len(held)
        if k == len(held):
            held.append([])
        held[k].append(i)
        assert bins[i] == k


def plain_best_fit(size, source, cluster, capacity, per_source):
    held: list[list[int]] = []
    for i in range(len(size)):
        fits = [
            (capacity - sum(size[j] for j in b), k)
            for k, b in enumerate(held)
            if capacity - sum(size[j] for j in b) >= max(size[i], 1)
            and (cluster[i] < 0 or cluster[i] not in [cluster[j] for j in b])
            and sum(source[j] == source[i] for j in b) < per_source
        ]
        k = min(fits)[1] if fits else len(held)
        if k == len(held):
            held.append([])
        held[k].append(i)
    return [next(k for k, b in enumerate(held) if i in b) for i in range(len(size))]


def test_best_fit_of_equal_pieces_in_a_row():
    """Large clusters, whose searches start where the last one ended, against a plain search."""
    rng = np.random.default_rng(8)
    rows = sorted(zip((-rng.integers(0, 40, 400)).tolist(), rng.integers(0, 3, 400).tolist(), rng.integers(0, 2, 400).tolist()))
    size, cluster, source = np.array([-r[0] for r in rows]), np.array([r[1] if r[0] else -1 for r in rows]), np.array([r[2] for r in rows])
    assert best_fit(size, source, cluster, 100, 3)[0].tolist() == plain_best_fit(size, source, cluster, 100, 3)


def test_many_wordless_and_equal_texts_pack_in_seconds():
    start = time.monotonic()
    n = 100_000
    bins, _ = best_fit(np.r_[np.full(n, 3), np.zeros(n, int)], np.zeros(2 * n, int), np.r_[np.zeros(n, int), np.full(n, -1)], 2048, 16)
    assert len(set(bins[:n].tolist())) == n  # copies of one text never share a bin
    assert time.monotonic() - start < 30


def test_packed_pieces_keep_their_rows_and_conflicts(spark):
    text, long = prose(1, 40), prose(2, 1300)
    rows = [(1, text, "a")] * 5 + [(1, long, "a"), (1, long, "b"), (None, None, None), (2, " ", "a"), (3, prose(5, 30), None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, size string, row string")
    got = best_fit_packing(docs, capacity=500, per_source=2).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.row, []).append((r.piece, r.n_words))
    assert sorted(sorted(p) for p in pieces.values()) == sorted([[(0, 40)]] * 5 + [[(0, 500), (1, 500), (2, 300)]] * 2 + [[(0, 0)]] * 2 + [[(0, 30)]])
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.n_words)
    assert all(sizes.count(40) <= 1 and sizes.count(300) <= 1 and sum(sizes) <= 500 for sizes in bins.values())


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    vectors = [(base[i % 12] + rng.normal(size=16) * 0.12).tolist() for i in range(80)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, vectors[0], vectors[0]]
    rows = list(enumerate(vectors + odd))
    got = {r.vec_id: r.n_links for r in embedding_near_dedup(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    kept = [i for i, v in rows if v and all(x is not None and x == x for x in v) and any(v)]
    m = np.array([rows[i][1] for i in kept])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = dict(zip(kept, ((m @ m.T) >= 0.9).sum(axis=1) - 1))
    assert got == {i: int(want.get(i, 0)) for i, _ in rows}


def test_licences_and_look_alikes(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "mit dem Zug under the bridge", None, ""]
    rows = [(i, f"{prose(i, 30)}\n{t}\n{prose(i + 50, 30)}" if t else t) for i, t in enumerate(lines)]
    got = {r.doc_id: (r.families, r.paragraphs) for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (["mit"], [1]), 1: (["cc-by-nc-4.0"], [1]), 2: ([], []), 3: ([], []), 4: ([], [])}


NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "bsd": "Released under the BSD license.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
}


def test_a_licence_line_of_every_family(spark):
    assert set(NOTICES) == set(TEMPLATES)
    rows = [(i, f"{prose(i, 30)}\n{t}\n{prose(i + 50, 30)}") for i, t in enumerate(NOTICES.values())]
    got = {r.doc_id: (r.families, r.paragraphs) for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ([f], [1]) for i, f in enumerate(NOTICES)}


def test_notices_of_other_licences_are_unknown(spark):
    lines = ["Licensed under the European Union Public License, version 1.2.", "He was to be free of charge to any person in the end.", "Released under the MIT License."]
    rows = [(i, f"{prose(i, 30)}\n{t}\n{prose(i + 50, 30)}") for i, t in enumerate(lines)] + [(9, "\n".join(lines))]
    got = {r.doc_id: (r.families, r.unknown) for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == ([], [1]) and got[2] == (["mit"], []) and got[9][0] == ["mit"] and 0 in got[9][1] and 2 not in got[9][1]


def test_every_line_reaches_the_classifier(spark):
    """Notices that share no three words in a row with a template are unknown too; ordinary lines beside them are not."""
    lines = ["MIT license applies", "GNU license applies", "Apache license applies", "BSD license terms apply"]
    rows = [(i, f"{prose(i, 30)}\n{t}\n{prose(i + 50, 30)}") for i, t in enumerate(lines)] + [(9, prose(90, 400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    meets = licence_scan_module._meets_template(licence_scan_module.tokens(F.col("text")))
    assert frame.where(meets).count() == 0
    got = {r.doc_id: (r.families, r.unknown) for r in licence_scan(frame).collect()}
    assert got == {i: ([], [1]) for i in range(len(lines))} | {9: ([], [])}


def test_the_classifier_learns_from_every_distinct_line(spark):
    """Of 6,000 lines in 1,500 texts none is left out, repeated lines count once, and notices keep their weight beside them."""
    texts = ["\n".join(prose(4 * i + k, 8) + f" {4 * i + k}" for k in range(4)) for i in range(1500)]
    rows = [*enumerate([*texts, *texts[:50], None, "", " \n-"]), *((2000 + i, f"{prose(i, 30)}\n{t}") for i, t in enumerate(NOTICES.values()))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lines = licence_scan_module.background(frame, frame)
    assert {line for t in texts for line in t.split("\n")} <= {" ".join(r.words) for r in lines.where("not meets").collect()}
    assert lines.count() == 6000 + 2 * len(NOTICES) and lines.where("meets").count() == len(NOTICES)
    got = {r.doc_id: (r.families, r.unknown) for r in licence_scan(frame).where("n_licences > 0 or size(unknown) > 0").collect()}
    assert got == {2000 + i: ([f], []) for i, f in enumerate(NOTICES)}


def test_the_commonest_grams_are_those_of_a_full_count(spark, monkeypatch):
    rng = np.random.default_rng(8)
    lines = [[str(w) for w in rng.choice(list("abcdefghij"), rng.integers(0, 9), p=np.arange(1, 11) / 55)] for _ in range(300)]
    frame = spark.createDataFrame([(w,) for w in lines], "words array<string>")
    held = Counter(gram for w in lines for gram in set(licence_scan_module._grams(" ".join(w))))
    want = sorted((-n, len(gram.split()), gram) for gram, n in held.items() if n > 1)
    for most in (5, 40, 150, 100_000):
        monkeypatch.setattr(licence_scan_module, "MOST_GRAMS", most)
        assert licence_scan_module._common(frame) == [gram for _, _, gram in want[:most]]
    assert licence_scan_module._common(frame.limit(0)) == []


def test_no_text_with_a_template_window_is_passed_over(spark):
    """The compiled pattern over whole texts finds whatever the comparison of words finds."""
    rng = np.random.default_rng(6)
    vocabulary = sorted({w for many in TEMPLATES.values() for t in many for w in t.split()}) + ["x", "é", "4"]
    gaps = [" ", "\n", ", ", "", "-", ".", " \n# "]
    windows = sorted(set().union(*(licence_scan_module._windows(t) for many in TEMPLATES.values() for t in many)))
    texts = []
    for _ in range(1500):
        words_ = list(rng.choice(vocabulary, 8)) + str(rng.choice(windows)).split() + list(rng.choice(vocabulary, 4))
        texts.append("".join(w.upper() if rng.random() < 0.2 else w for x in words_ for w in (x, str(rng.choice(gaps)))))
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    exact = licence_scan_module._meets_template(licence_scan_module.tokens(F.col("text")))
    got = frame.select(exact.alias("exact"), F.lower("text").rlike(licence_scan_module.may_meet_template()).alias("may")).collect()
    assert sum(r.exact for r in got) > 300
    assert not any(r.exact and not r.may for r in got)


WRAPPED = [
    ("bsd", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""),
    ("gpl-3.0", """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by"""),
    ("mit", """Permission is hereby granted,
free of charge, to any person
obtaining a copy of this
software and associated
documentation files"""),
]


def test_wrapped_notices(spark):
    """A wrapped notice is one licence with its span; a line without a word between its lines ends it; lines of two notices stay two."""
    rows = [f"{prose(i, 30)}\n{t}\n{prose(i + 50, 30)}" for i, (_, t) in enumerate(WRAPPED)]
    want = [([f], [1], [1 + t.count("\n")]) for f, t in WRAPPED]
    rows += [WRAPPED[0][1].replace("\n", "\n\n"), "Released under the MIT License.\nReleased under the MIT License."]
    want += [([], [], []), (["mit"], [0, 1], [0, 1])]
    rows.append("\n".join(t for _, t in WRAPPED))
    want.append((["bsd", "gpl-3.0", "mit"], [0, 3, 5], [2, 4, 9]))
    got = licence_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.families, r.paragraphs, r.last_lines) for r in got} == dict(enumerate(want))


def test_messages_give_exact_marginals():
    p = dom_marginals.train(dom_marginals.built_pages())
    tree = dom_marginals.parse("<div><p>Some text here, and more.</p><nav><a href=x>Go</a></nav></div>")
    dense, index = dom_marginals.features(tree)
    z = np.clip(dense @ p.dense + p.names[index].sum(axis=1), -12, 12)
    weight = np.zeros((len(z), 2))
    for state in np.ndindex(*[2] * len(z)):
        total = sum(z[i] * s for i, s in enumerate(state))
        total += sum(p.pair[dom_marginals.relation(tree, i), state[tree.parent[i]], state[i]] for i in range(1, len(z)))
        for i, s in enumerate(state):
            weight[i, s] += np.exp(total)
    assert dom_marginals.marginals(tree, p) == pytest.approx(weight[:, 1] / weight.sum(axis=1))


def test_main_text(spark):
    """By the model of the query: built pages alone are too few to learn from."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    p = dom_marginals.train(dom_marginals.labelled_pages(pages))
    page = "<nav><ul><li><a>Menu</a></ul></nav><article><h1>T &amp; U</h1><p>One <b>two<br>\n three.<p>Four.</article><div class=comments><p>Nice.</p></div><footer>End</footer>"
    assert dom_marginals.main_text(page, p) == "T & U One two three. Four."
    assert dom_marginals.main_text(None, p) == "" == dom_marginals.main_text("", p)
    form = "<article><h1>Title</h1><p>One two three, and four five six.</p><form><p>Subscribe now, please.</p><input></form><p>Seven eight nine, ten eleven.</p></article>"
    assert dom_marginals.main_text(form, p) == "Title One two three, and four five six. Seven eight nine, ten eleven."
    wrapped = f"<form>{form.replace('<form>', '<div>').replace('</form>', '</div>')}</form>"
    assert "Seven eight nine, ten eleven." in dom_marginals.main_text(wrapped, p)


def test_labelled_pages_are_bounded_and_the_same_however_split(spark):
    rows = [(i, f"<article><p>{prose(i, 30)}</p></article>") for i in range(500)] + [(1000, "<article><p>x</p></article>")] * 300
    pages = spark.createDataFrame(rows, "page_id long, html string")
    built = len(dom_marginals.built_pages()) * dom_marginals.BUILT_TIMES
    got = dom_marginals.labelled_pages(pages, most=50)
    assert 20 < len(got) - built < 100
    assert got == dom_marginals.labelled_pages(pages.repartition(9), most=50)


def test_labels_of_links_reach_the_smallest_row():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (400, 390), (300, 5000)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        plain = np.arange(n)
        for _ in range(n):
            for i, j in zip(x, y):
                plain[i] = plain[j] = min(plain[i], plain[j])
        assert united(np.arange(n), x, y).tolist() == plain.tolist()


def test_vectors_of_odd_kinds(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [2.0, 0.1]), (None, [0.0, 1.0]), (5, [1e-30, 0.0]), (5, [1e30, 1e29]), (6, None)]
    got = embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr)
    assert found == sorted([(1, 3, 1, True), (2, 0, 2, True), (None, 3, 1, False), (None, 0, None, True), (5, 3, 1, False), (5, 3, 1, False), (6, 0, 6, True)], key=repr)


def test_class_prior_from_scores():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        positive, negative = rng.normal(2, 1, 20_000), rng.normal(-2, 1, 20_000)
        n = int(20_000 * share)
        mixed = np.r_[rng.normal(2, 1, n), negative[: 20_000 - n]]
        assert abs(positive_unlabelled.class_prior(positive, mixed) - min(0.95, share)) < 0.05


def test_quality_scores_of_odd_rows(spark):
    rows = [(i, prose(i, 120), 1, "x") for i in range(120)] + [(200 + i, "### $$ " * 60, 0, "x") for i in range(60)]
    rows += [(900, None, 1, "x"), (901, "", 0, "x"), (None, prose(3, 100), 1, "x"), rows[0], rows[0]]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, `key.quality_score` string")
    model = positive_unlabelled.train(table, table.select("doc_id", "quality"), F.lit(True), most=150)
    got = positive_unlabelled.score(table, model).collect()
    again = positive_unlabelled.train(table.repartition(7), table.select("doc_id", "quality").repartition(3), F.lit(True), most=150)
    assert all(np.allclose(a, b) for a, b in zip(model, again))
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    assert len({r.quality_score for r in got if r.doc_id == 0}) == 1


def test_quality_on_held_out_labels(spark):
    good = [(i, prose(i, 120), 1) for i in range(300)]
    bad = [(1000 + i, prose(i, 120).replace(" ", "### "), 0) for i in range(100)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    learnable = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = positive_unlabelled.train(table.drop("quality"), table.drop("text"), learnable)
    held = positive_unlabelled.score(table, model).where(~learnable).collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in held]) > 0.95


def test_token_counts(docs):
    by_id = {r.doc_id: r for r in docs.collect()}
    for r in log_bilinear.score(docs, log_bilinear.train(docs, F.lit(True))).collect():
        assert r.n_tokens == len(words(by_id[r.doc_id].text)) + 1


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = log_bilinear.score(docs.where(held_out), log_bilinear.train(docs, ~held_out)).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_names_of_nodes_are_hashed_once():
    dom_marginals._names.cache_clear()
    tree = dom_marginals.parse('<div class="a b"><p>One.</p><p>Two.</p></div>' * 50)
    dense, index = dom_marginals.features(tree)
    assert dom_marginals._names.cache_info().misses == 4 and index.shape == (len(tree.tag), 3) and len(dense) == len(tree.tag)
