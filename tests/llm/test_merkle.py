from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm import merkle

ROWS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operator uses on the way.
        T.StructField("grp", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("size", T.StringType()),
    ]
)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    cells = (row[0], row[3], row[2], row[4], text)
    return H(*["-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells])


def lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """The root, and for each node the levels' (left, right) siblings."""
    paths = [[] for _ in nodes]
    members = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, joined = [], []
        for start in range(0, len(nodes), 8):
            run = nodes[start : start + 8]
            for place in range(len(run)):
                for k in members[start + place]:
                    paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
            above.append(H(*run))
            joined.append([k for m in members[start : start + 8] for k in m])
        nodes, members = above, joined
    return nodes[0], paths


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((leaf(row, row[1]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    subtrees = {name: tree([h for h, _ in groups[name]]) for name in names}
    root, upper = tree([subtrees[name][0] for name in names])
    result = []
    for name, above in zip(names, upper):
        subroot, paths = subtrees[name]
        for (h, row), own in zip(groups[name], paths):
            path = own + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, lower(row[1])) if tampered else h
            for left, right in path:
                node = H(left, node, right)
            proof = H(*[left + right for left, right in path])
            result.append((row[0], h, subroot, root, proof, node, node == root))
    return sorted(result, key=repr)


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


@pytest.fixture
def make_rows(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], ROWS)

    return build


def rows_with(counts, seed=1):
    draw = random.Random(seed)
    rows, number = [], 0
    for lang, count in counts.items():
        for _ in range(count):
            number += draw.randrange(1, 4)
            text = draw.choice(["Some Text", "ohne", "ÄÖÜ É", "", None, "x" * 50, f"Own {number}"])
            rows.append((number, text, lang, draw.choice(["a", "b:1", None]), draw.choice([None, 0, 12])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "counts",
    [
        {"en": 1},
        {"en": 9},
        {"en": 600, "de": 64, "fr": 8, None: 7, "": 1, "é": 65, "z": 2},
        {f"l{k}": 1 + k % 3 for k in range(70)},
    ],
)
def test_against_brute_force(make_rows, rows_of, counts):
    rows = rows_with(counts)
    got = rows_of(merkle.manifest(make_rows(rows), tampered()))
    assert got == expected(rows)


def test_repeated_rows_and_missing_ids(make_rows, rows_of):
    rows = rows_with({"en": 30})
    rows += [rows[3], rows[3], (rows[4][0], "other Text", "en", None, 1), (None, "A", "en", "s", 1), (None, "A", "en", "s", 1)]
    rows += [(5, "Long Text " * 30_000, "de", None, None)]
    assert rows_of(merkle.manifest(make_rows(rows), tampered())) == expected(rows)


def test_tampering_is_found(make_rows):
    rows = [(k, "Some Text", "en", "s", 9) for k in range(50)]
    found = {r.doc_id: r.verified for r in merkle.manifest(make_rows(rows), tampered()).collect()}
    assert found == {k: zlib.crc32(str(k).encode()) % 3 != 0 for k in range(50)}
    assert all(r.verified for r in merkle.manifest(make_rows(rows), F.lit(None).cast("boolean")).collect())


def test_empty_table(make_rows):
    frame = merkle.manifest(make_rows([]), tampered())
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert frame.count() == 0


def test_values_cannot_be_shifted_between_columns():
    assert leaf((1, None, "a", "b", 2), "c") != leaf((1, None, "ab", "", 2), "c")
