from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from footfall.llm import matrices as m

PATH = P.path("word_bpe_49k.json")


def plain_best_fit(lengths, size):
    """The definition, looking through all open rows."""
    rows, free = [], []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[piece]]
        if fits:
            row = min(fits, key=lambda r: free[r])
        else:
            row = len(rows)
            rows.append([])
            free.append(size)
        rows[row].append(piece)
        free[row] -= lengths[piece]
    return free


@pytest.mark.parametrize("size", [1, 7, 64, 100])
def test_best_fit_decreasing(size):
    draw = random.Random(size)
    for _ in range(50):
        lengths = [draw.randint(1, size) for _ in range(draw.randint(0, 80))]
        rows = m.best_fit_decreasing(np.array(lengths, dtype=np.int64), size)
        assert sorted(k for row in rows for k in row) == list(range(len(lengths)))
        free = [size - sum(lengths[k] for k in row) for row in rows]
        assert all(f >= 0 for f in free) and sorted(free) == sorted(plain_best_fit(lengths, size))


def test_the_tree_finds_the_least_space():
    draw = random.Random(3)
    tree, spaces = m.FreeSpace(50), []
    for step in range(2000):
        if draw.random() < 0.5:
            spaces.append(draw.randint(0, 50))
            tree.put(spaces[-1], step)
            continue
        need = draw.randint(0, 50)
        fits = [s for s in spaces if s >= need]
        found = tree.take(need)
        assert (found is None) == (not fits)
        if fits:
            assert found[0] == min(fits)
            spaces.remove(found[0])


@pytest.mark.parametrize("group", [1 << 21, 200])
def test_nothing_is_lost(make_docs, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP_TOKENS", group)
    draw = random.Random(5)
    texts = {k: " ".join(draw.choice("red green blue, grey!".split()) for _ in range(draw.randint(0, 60))) for k in range(50)}
    texts |= {100: None, 101: "", 102: "word " * 700}
    rows = m.pack_matrices(make_docs(*texts.items(), (None, "red"), (7, texts[7])).repartition(3), PATH, size=64, pad_id=9).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    tokenizer, pieces = Tokenizer.from_file(PATH), {}
    for row in rows:
        ids = np.frombuffer(row.ids, dtype="<u4")
        assert len(ids) == 64 and (ids[row.n_tokens :] == 9).all()
        assert row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.n_tokens <= 64
        assert row.position_resets == row.cu_seqlens[:-1]
        for doc, start, a, b in zip(row.doc_ids, row.starts, row.cu_seqlens, row.cu_seqlens[1:]):
            pieces.setdefault((doc, start), []).append(ids[a:b].tolist())
    for doc, text in [*texts.items(), (None, "red")]:
        whole = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted((s, p[0]) for (d, s), p in pieces.items() if d == doc)
        assert [t for _, part in parts for t in part] == whole
    assert all(len(p) == (2 if d == 7 else 1) for (d, _), p in pieces.items())
    total = sum(r.n_tokens for r in rows)
    if group > 200:
        assert len(rows) <= -(-total // 64) + 6


def test_files_and_no_rows(make_docs, spark, tmp_path):
    sequences = m.pack_matrices(make_docs((1, "red green")), PATH, size=16)
    m.write_matrices(sequences, str(tmp_path / "out"))
    [row] = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row.doc_ids == [1] and len(row.ids) == 64
    assert m.pack_matrices(make_docs(), PATH).count() == 0
