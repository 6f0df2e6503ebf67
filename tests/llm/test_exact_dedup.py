from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from footfall.llm import exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, best):
    groups: dict[str, list] = {}
    for doc, text in rows:
        groups.setdefault(lower(text), []).append(doc)
    result = []
    for doc, text in rows:
        group = groups[lower(text)]
        ids = [i for i in group if i is not None]
        keep = best(ids) if ids else None
        digest = hashlib.sha256(lower(text).encode()).hexdigest()
        result.append((doc, keep, len(group), doc == keep, digest))
    return sorted(result, key=repr)


@pytest.mark.parametrize("keep, best", [("smallest", min), ("largest", max)])
def test_against_brute_force(make_docs, rows_of, keep, best):
    draw = random.Random(2)
    rows = [(k, draw.choice(["One", "oNE", "two", "", None, "ÄÖ", "äö", "x" * 5000])) for k in range(300)]
    rows += [(k, f"own {k}") for k in range(300, 400)] + [(5, rows[5][1]), (None, "two"), (None, "alone")]
    groups = exact_dedup.exact_groups(make_docs(*rows), keep=keep)
    assert rows_of(groups, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected(rows, best)


def test_every_round_keeps_one_row_per_digest(make_docs):
    rows = exact_dedup.digests(make_docs(*[(k, "hot") for k in range(500)]))
    leaf = exact_dedup.leaf_runs(rows, "min")
    assert 1 < leaf.count() <= 64
    root = exact_dedup.merge_runs(leaf, "min").collect()
    assert [(r.keep_id, r.group_size, r.run) for r in root] == [(0, 500, 0)]


def test_rows_that_stay(make_docs, rows_of):
    docs = make_docs((3, "a"), (1, "A"), (2, "b"), (2, "b"), (None, "b"), (9, None), (8, ""))
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(1,), (2,), (2,), (8,)]


def test_empty_table_and_wrong_choice(make_docs):
    assert exact_dedup.exact_groups(make_docs()).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(make_docs(), keep="any")


def test_only_functions(make_docs):
    plan = exact_dedup.exact_groups(make_docs((1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


def test_runs_are_merged_in_order(make_docs):
    rows = exact_dedup.digests(make_docs(*[(k, f"text {k % 9}") for k in range(90)]))
    leaf = exact_dedup.leaf_runs(rows, "min")
    plan = exact_dedup.merge_runs(leaf, "min")._jdf.queryExecution().executedPlan().toString()
    # Leaves and three rounds: sorted before and behind each exchange, never hashed.
    assert "HashAggregate" not in plan and plan.count("Exchange hash") == 4
    assert plan.count("SortAggregate") == 8 and len(re.findall(r"\bSort \[", plan)) >= 8


def test_equal_digests_of_different_texts_are_found(make_docs):
    rows = exact_dedup.digests(make_docs((1, "one"), (2, "two")))
    forged = rows.withColumns({"text_sha256": F.lit("same"), "run": F.col("doc_id").cast("int") * 16})
    with pytest.raises(Exception, match="different texts have the digest same"):
        exact_dedup.merge_runs(exact_dedup.leaf_runs(forged, "min"), "min").collect()
