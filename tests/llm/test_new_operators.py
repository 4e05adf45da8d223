"""Spelling variants, periodic runs and best-fit packing against brute force and the library."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gazette.llm import best_fit, periodic, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    small, large = sorted((a, b), key=len)
    return len(large) == len(small) + 1 and any(large[:i] + large[i + 1 :] == small for i in range(len(large)))


def expected_variants(docs: list[tuple]) -> set[tuple]:
    """The contract of the query, word by word."""
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in n:
                near[w].add(cut), near[cut].add(w)
    by_gap = {}
    for w in n:
        for i in range(len(w)):
            by_gap.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    for same in by_gap.values():
        for a, b in itertools.permutations(same, 2):
            near[a].add(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def test_spelling_variants_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = expected_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    found = [tuple(r) for r in spelling.spelling_variants(docs, edit=True).collect()]
    assert len(found) == len(expected) and set(found) == expected
    assert any(r[1] and r[2] != r[1] for r in found)


def test_spelling_in_hot_blocks_and_long_words(spark, monkeypatch):
    """Words of one half in blocks of every number of parts, signatures dealt in cells, and words longer than LONG letters."""
    rng = random.Random(4)
    words = {"anti" + "".join(rng.choices("abcd", k=rng.randint(3, 6))) for _ in range(900)} | {"".join(rng.choices("éÀxyz", k=5)) for _ in range(300)}
    words |= {"q" * 200 + x for x in ("", "q", "r", "rq")} | {"ab" * 70, "ab" * 70 + "a", "ab" * 30 + "c" + "ab" * 40}
    table = [(w, rng.randint(3, 60)) for w in sorted(words)]
    expected = expected_variants([(None, " ".join(w for w, n in table for _ in range(n)))])
    monkeypatch.setattr(spelling, "BLOCK", 20)
    found = [tuple(r) for r in spelling.variants(spark.createDataFrame(table, "word string, n bigint")).collect()]
    assert len(found) == len(expected) and set(found) == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aAbÿ", min_size=1, max_size=9), min_size=2, max_size=12, unique=True))
def test_words_of_one_edit_share_a_signature_and_are_verified(words):
    raw = np.empty(len(words), object)
    raw[:] = [w.encode("latin-1") for w in words]
    for i, j in itertools.combinations(range(len(words)), 2):
        near = spelling.single_edits(raw, spelling.laid_out(raw), np.array([i]), np.array([j]))[0]
        assert near == one_edit(words[i], words[j])
        if near:
            for parts in (2, 3, 4, 6, 8):
                a, b = spelling.signatures([raw[i], raw[j]], parts)
                assert (a == b).any()


def test_spelling_edges(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "colour " * 8 + "color " * 3), (None, "colour, COLOUR"), (2, None), (3, ""), (3, "abcd " * 9), (4, "colom " * 3)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS word", "2 AS n", "3 AS `a.b`")
    found = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert found == {("colour", None, "colour", 10, 1, None), ("color", "colour", "colour", 3, 2, 10), ("colom", None, "colom", 3, 1, None)}


def test_spelling_ties_go_to_the_first_word(spark):
    table = [("beard", 3), ("heard", 9), ("board", 9)]
    found = {r.word: r.form for r in spelling.variants(spark.createDataFrame(table, "word string, n bigint")).collect()}
    assert found == {"beard": "board", "heard": None, "board": None}


def expected_runs(words: list) -> list[tuple]:
    """Every maximal stretch of every period, kept if no smaller period holds over it."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - i >= max(6, 4 * q):
                found.setdefault((i, end), q)
            i = end - q + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 9)), max_size=8))
def test_runs_of_generated_words(parts):
    words = [b"%d" % x for some, times in parts for x in some * times]
    assert periodic.runs_of([words])[0] == expected_runs(words)


def test_runs_of_long_periods_in_many_documents():
    rng = random.Random(9)
    documents = []
    for p in (5, 7, 8, 11, 12, 16, 40, 41, 97, 300, 1000):
        period = [b"%d" % rng.randint(0, 60) for _ in range(p)]
        tail = period[: rng.randint(0, p - 1)]
        documents += [period * 4, period * 4 + tail, [b"x", *period * 5, b"y"], period * 3 + period[:-1], [b"a"] * 9 + period * 6 + [b"a", b"b"] * 7]
    documents += [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4]
    assert periodic.runs_of(documents) == [expected_runs(d) for d in documents]


def expected_digests(doc, text) -> tuple:
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = expected_runs(words)
    keep = [True] * n
    for start, length, q in runs:
        keep[start + q : start + length] = [False] * (length - q)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(listed), sha(" ".join(w for w, k in zip(words, keep, strict=True) if k)))


def test_periodic_digests(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "c d", "ü"]) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows += [(7, "x y " * 9), (7, "x y " * 9), (None, "z " * 7), (400, None), (401, ""), (402, "\t\n \x0b"), (403, "w " * 200_000), (20, " lead  a\tb a b a b a b "), (404, "long" * 300_000 + " b")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS words", "2 AS n", "3 AS `my col`")
    found = sorted(map(tuple, periodic.digests(docs).collect()), key=str)
    expected = sorted((expected_digests(*r) if r[0] != 403 else None for r in rows), key=str)
    assert [r for r in found if r[0] != 403] == [r for r in expected if r]
    assert next(r for r in found if r[0] == 403)[1:6] == (1, 0, 200_000, 1, 200_000_000)
    assert periodic.digests(spark.createDataFrame([], DOCS)).count() == 0
    by_id = {r.doc_id: r.text for r in periodic.collapsed_documents(docs.filter("doc_id = 7 OR doc_id IS NULL")).collect()}
    assert by_id == {7: "x y", None: "z"}
    assert {tuple(r) for r in periodic.run_rows(docs.filter("doc_id >= 403")).collect()} == {(403, 0, 200_000, 1)}


def check_packing(spark, rows: list[tuple], pieces: list, window: int = 1024) -> int:
    """Checks the contract for rows with distinct ids; returns the number of sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {doc: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for doc, text in rows}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert set(by_doc) == set(ids)
    for doc, some in by_doc.items():
        some.sort(key=lambda r: r.piece)
        assert [r.piece for r in some] == list(range(len(some)))
        assert [r.start for r in some] == [0, *np.cumsum([r.length for r in some])[:-1]] and sum(r.length for r in some) == len(ids[doc])
        assert all(r.length == window for r in some[1:]) and (len(some) == 1) == (len(ids[doc]) <= window)
    for some in by_sequence.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == [0, *np.cumsum([r.length for r in some])[:-1]] and sum(r.length for r in some) <= window
    return len(by_sequence)


def test_best_fit_packing_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    pieces = best_fit.pack_best(docs.repartition(3)).collect()
    used = check_packing(spark, rows, pieces)
    tokens = sum(r.length for r in pieces)
    assert used <= -(-tokens // 1024) + 2


def test_best_fit_packing_edges(spark):
    words = " ".join(f"w{i % 97}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (4, words), (5, words), (6, "ünï 漢字   x"), (7, "x" * 50_000), (8, " " * 5000 + "y"), (9, "a\tb\r\n c"), (10, "  two  spaces\n\n")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS ids", "2 AS short", "3 AS _p", "4 AS `my col`")
    check_packing(spark, rows, best_fit.pack_best(docs).collect())
    assert best_fit.pack_best(spark.createDataFrame([], DOCS)).count() == 0
    twice = best_fit.pack_best(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c")], DOCS)).collect()
    assert len(twice) == 3 and len({r.sequence_id for r in twice}) == 1


@pytest.mark.parametrize("kind", ["few", "many", "halves", "thirds", "one"])
def test_plan_holds_every_piece_in_few_sequences(kind):
    rng = np.random.default_rng(3)
    lengths = {"few": rng.integers(1, 1024, 60), "many": np.minimum(1 + rng.exponential(200, 50_000), 1023).astype(int), "halves": np.repeat([512, 511, 513], 900), "thirds": rng.integers(330, 350, 9000), "one": np.array([1023])}[kind]
    counts = np.bincount(lengths, minlength=1025)
    whole = best_fit.plan(counts)
    held = Counter()
    for some, n in whole:
        assert sum(some) <= 1024 and n > 0
        for length in some:
            held[length] += n
    assert held == Counter(lengths.tolist())
    used, plain = sum(n for _, n in whole), sum(best_fit.best_fit(counts, 1024).values())
    assert used <= plain + 1
    if kind == "many":
        assert used <= 1.003 * -(-int(lengths.sum()) // 1024)


def test_knapsack_prices_are_the_best():
    lengths, prices = np.array([7, 5, 3]), np.array([9.0, 6.0, 2.5])
    best, first = best_fit.knapsack(lengths, prices, 20)
    for room in range(21):
        brute = max(a * 9 + b * 6 + c * 2.5 for a in range(3) for b in range(5) for c in range(7) if 7 * a + 5 * b + 3 * c <= room)
        assert best[room] == brute
        assert (first[room] == -1) == (room < 3)
