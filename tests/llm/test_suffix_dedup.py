from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import suffix_dedup as s


def brute(rows, match):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; no id is the last of all."""
    last = 1 << 62
    texts = [(last if doc is None else doc, (text or "").encode()) for doc, text in rows]
    first: dict[bytes, int] = {}
    for doc, text in texts:
        for k in range(len(text) - match + 1):
            part = text[k : k + match]
            first[part] = min(first.get(part, doc), doc)
    result = []
    for (doc, _), (number, text) in zip(rows, texts):
        gone = np.zeros(len(text), dtype=bool)
        for k in range(len(text) - match + 1):
            if first[text[k : k + match]] < number:
                gone[k : k + match] = True
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        result.append((doc, len(text), int(gone.sum()), spans, kept))
    return sorted(result, key=repr)


def corpus(seed):
    draw = random.Random(seed)
    syllables = ["the ", "an ", "ing ", "é", "st ", "or\n", "Des. ", "of "]
    make = lambda n: "".join(draw.choice(syllables) for _ in range(n))
    passages = [make(30) for _ in range(5)]
    rows = []
    for k in range(90):
        parts = [make(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            chosen = draw.choice(passages)
            cut = draw.randint(0, 20)
            parts += [chosen[cut : cut + draw.randint(30, 200)], make(draw.randint(0, 15))]
        rows.append((draw.randrange(10_000), "".join(parts)))
    rows += [(k, rows[k % 7][1]) for k in range(20_000, 20_015)]  # copies
    rows += [(3, "x" * 500), (4, "x" * 120), (5, "ab" * 200), (6, "ba" * 90), (7, "Des. " * 100)]
    rows += [(8, "y" * 49), (9, "y" * 49), (10, "z" * 50), (11, "z" * 50), (12, None), (13, "")]
    rows += [(20_001, rows[2][1]), (20_001, passages[0] * 3), (None, passages[1]), (None, passages[1] + "!")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("batch_bytes, stretch", [(1 << 20, 1 << 20), (500, 1 << 20), (3000, 64)])
def test_against_brute_force(make_docs, rows_of, monkeypatch, batch_bytes, stretch):
    monkeypatch.setattr(s, "STRETCH", stretch)
    rows = corpus(batch_bytes + stretch)
    found = s.remove_repeats(make_docs(*rows).repartition(3), batch_bytes=batch_bytes)
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.collect()]
    assert sorted(got, key=repr) == brute(rows, 50)


def test_other_lengths_and_no_rows(make_docs):
    rows = corpus(9)
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in s.remove_repeats(make_docs(*rows), match=33).collect()]
    assert sorted(got, key=repr) == brute(rows, 33)
    assert s.remove_repeats(make_docs()).count() == 0
    with pytest.raises(ValueError):
        s.remove_repeats(make_docs(), match=10)


def test_family_in_any_order_and_geometric():
    draw = np.random.default_rng(2)
    arrays = []
    for batch in range(37):
        keys = np.unique(draw.integers(0, 400, 60)).astype(np.uint64)
        arrays.append((batch, keys // np.uint64(3), keys % np.uint64(3), draw.integers(0, 25, len(keys))))
    smallest: dict[tuple, int] = {}
    others: dict[int, set] = {}
    for _, one, two, ids in arrays:
        for a, b, i in zip(one.tolist(), two.tolist(), ids.tolist()):
            smallest[a, b] = min(smallest.get((a, b), i), i)
            others.setdefault(a, set()).add(b)
    for order in (range(37), reversed(range(37))):
        family = s.Family()
        for k in order:
            family.add(*arrays[k])
            ranks = [rank for rank, _ in family.levels]
            assert ranks == sorted(set(ranks), reverse=True)
        says = family.close()
        for batch, one, two, ids in arrays:
            for k, (a, b, i) in enumerate(zip(one.tolist(), two.tolist(), ids.tolist())):
                want = s.REPEATED if i > smallest[a, b] else s.MIXED if len(others[a]) > 1 else s.UNIQUE
                assert says[batch][k] == want


def test_rows_keep_their_columns(make_docs, rows_of, spark):
    passage = "a passage of more than fifty bytes that two documents have, é"
    rows = [(1, f"one {passage} end"), (2, f"two {passage} fin"), (2, f"two {passage} fin"), (3, None), (None, "ö" * 30), (4, passage[:-2])]
    docs = make_docs(*rows).selectExpr("*", "length(text) AS n_chars")
    left = s.without_repeats(docs)
    assert left.columns == docs.columns and left.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    # Document 2 shares the blanks beside the passage, and the é is not cut: "fin" is left.
    assert rows_of(left, "doc_id", "text", "n_chars") == sorted(
        [(1, rows[0][1], len(rows[0][1])), (2, "twofin", 6), (2, "twofin", 6), (3, None, None), (None, "ö" * 30, 30), (4, "", 0)],
        key=repr,
    )
    cut = pa.record_batch([pa.array([1]), pa.array(["x"]), pa.array(["aé".encode()[:2]])], ["a", "b", "c"])
    assert next(s._as_text(iter([cut]))).column(2).to_pylist() == ["a"]


def test_order_is_that_of_lexsort():
    draw = np.random.default_rng(4)
    for size, values in [(0, 3), (1, 3), (500, 4), (500, 400), (2000, 10**9)]:
        one, two, ids = draw.integers(0, values, (3, size)).astype(np.uint64)
        for part in (one, np.concatenate([np.sort(one[: size // 2]), np.sort(one[size // 2 :])])):
            assert (s.in_order(part, two, ids) == np.lexsort((ids, two, part))).all()
