from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from footfall.llm import near_dup
from footfall.llm.components import components
from footfall.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """component_id by id; ids may repeat."""
    up = {doc: doc for doc, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(doc, shingles(text, size)) for doc, text in rows]
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return {doc: find(doc) for doc in up}


def family(draw, words, n, edits, start):
    base = [draw.choice(words) for _ in range(80)]
    rows = []
    for k in range(n):
        text = list(base)
        for _ in range(draw.randint(0, edits)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((start + k, " ".join(text)))
    return rows


def corpus(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(30))
    rows = family(draw, words, 60, 6, 0) + family(draw, words, 20, 2, 100)
    rows += [(200 + k, passage + " " + " ".join(draw.choice(words) for _ in range(50))) for k in range(30)]
    rows += [(300, "a b"), (301, "A  b"), (302, "a"), (303, ""), (304, None), (305, " \t\n"), (306, "a b")]
    rows += [(400, rows[3][1].upper()), (401, rows[3][1] + "\n"), (5, rows[70][1]), (6, rows[6][1])]
    draw.shuffle(rows)
    return rows


def test_sets_and_words():
    draw = random.Random(5)
    texts = ["".join(draw.choice("aAbB éß\t\n\x0b.") for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["", " "]
    for size in (1, 3, 5):
        sets = shingle_sets([t.encode() for t in texts], size)
        assert [len(s) for s in sets] == [len(shingles(t, size)) for t in texts]
    hashes, counts = word_hashes([b"x y", b"", b"Y  x"])
    assert counts.tolist() == [2, 0, 2] and hashes[0] == hashes[3] and hashes[1] == hashes[2]
    assert shingle_sets([], 3) == []


def test_keys_pair_the_groups():
    hashes = near_dup.group_hashes([np.arange(50, dtype=np.uint64), np.arange(48, dtype=np.uint64)], 4, 2)
    assert hashes.shape == (2, 8)
    keys = near_dup.table_keys(hashes, 4)
    for i in range(4):
        for j in range(4):
            same = hashes[0, i] == hashes[1, i] and hashes[0, 4 + j] == hashes[1, 4 + j]
            assert (keys[0, 4 * i + j] == keys[1, 4 * i + j]) == same


@pytest.mark.parametrize("block", [2048, 7])
def test_against_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus(1)
    got = near_dup.near_duplicates(make_docs(*rows), shingle=3, percent=85, width=3).collect()
    want = brute(rows, 3, 85)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = sorted((doc, len(shingles(text, 3))) for doc, text in rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sizes


def test_five_words_and_kept_rows(make_docs, rows_of):
    rows = corpus(2)
    docs = make_docs(*rows, (None, rows[0][1]))
    want = brute(rows, 5, 80)
    kept = near_dup.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [doc for doc, _ in rows if want[doc] == doc]
    assert [r[0] for r in rows_of(kept, "doc_id")] == sorted([*ids, None], key=lambda i: repr((i,)))


def test_no_rows(make_docs, rows_of):
    assert near_dup.near_duplicates(make_docs()).count() == 0
    found = near_dup.near_duplicates(make_docs((1, None), (2, "")))
    assert rows_of(found, "component_id", "kept") == [(1, True), (2, True)]


def test_links_in_blocks_of_columns(monkeypatch):
    monkeypatch.setattr(near_dup, "COLUMNS", 16)
    monkeypatch.setattr(near_dup, "PAIRS", 8)
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    hashes = np.zeros((30, 4), dtype=np.uint64)  # all share all tables
    first = near_dup.linked_groups(sets, hashes, 2, 60)
    up = list(range(30))
    for a, b in combinations(range(30), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((up[a], up[b]))
            up = [low if x == high else x for x in up]
    assert first.tolist() == up


def test_components(spark):
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)]
    edges += [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(70)] + [(7, 7), (500, 500), (None, 1)]
    frame = spark.createDataFrame(edges, "a long, b long")
    up = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            up[high] = low
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {x: find(x) for x in up}
    assert components(frame.where("a < 0")).count() == 0
