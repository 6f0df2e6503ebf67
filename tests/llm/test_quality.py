from __future__ import annotations

import random
import re
from collections import Counter
from math import log

import pytest
import xxhash
from pyspark.sql import functions as F

from footfall.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def corpus(n=160, seed=8):
    draw = random.Random(seed)
    good = ["".join(draw.choice("aeioulmnr") for _ in range(5)) for _ in range(60)]
    rows, labels = [], []
    for k in range(n):
        words = [draw.choice(good) for _ in range(draw.randint(55, 120))]
        poor = k % 5 == 0
        if poor:
            words = [w + "$$$" if draw.random() < 0.7 else w for w in words]
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        rows.append((k, "\n".join(lines)))
        labels.append((k, 0 if poor else 1))
    return rows, labels


EDGES = [
    (1000, None), (1001, ""), (1002, " \n\t"), (1003, "a b a b a b " * 30), (1004, "x\ny\nx\n\n x\nx"),
    (1005, "w " * 20_000), (1006, "é ß <a|b> #%&*$"), (None, "a b c"), (1003, "a b c a b c"),
]


def test_base_rules(make_docs, rows_of):
    rows = corpus()[0][:30] + EDGES
    docs = make_docs(*rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(quality.base_rules(docs), *names) == sorted(((d, *base(t)) for d, t in rows), key=repr)


def test_weights_and_verdicts_against_brute_force(make_docs, spark):
    rows, labels = corpus()
    buckets = 64
    known = [(d, q) for d, q in labels if d % 2] + [(None, 1), (2, None)]
    ratio = quality.fit(make_docs(*rows), spark.createDataFrame(known, "doc_id long, quality int"), buckets=buckets)
    tokens = {d: re.findall(r"[a-z]+|[0-9]+|[^\sa-z0-9]+", t) for d, t in rows}

    def grams(words):
        singles = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        pairs = [xxhash.xxh64_intdigest(b.encode(), a) for a, b in zip(singles, words[1:])]
        signed = [h - (1 << 64) if h >> 63 else h for h in singles + pairs]
        return [h % buckets for h in signed]

    corpus_, target = Counter(), Counter()
    for d, words in tokens.items():
        corpus_.update(grams(words))
        if (d, 1) in known:
            target.update(grams(words))
    n, m = sum(corpus_.values()) + buckets, sum(target.values()) + buckets
    want = tuple(round(1e6 * log(((target[b] + 1) / m) / ((corpus_[b] + 1) / n))) for b in range(buckets))
    assert ratio.weights == want
    got = {r.doc_id: r for r in quality.judge(make_docs(*rows), ratio).collect()}
    for d, words in tokens.items():
        found = grams(words)
        assert got[d].mean_ratio == sum(want[b] for b in found) // len(found)
        assert got[d].kept == (not got[d].base_failed and got[d].mean_ratio >= ratio.threshold)
    # Documents whose labels were not seen.
    unseen = [(got[d].kept, q == 1) for d, q in labels if d % 2 == 0]
    assert sum(a == b for a, b in unseen) >= 0.97 * len(unseen)


@pytest.mark.parametrize(
    "rated, cost, cut",
    [([(1, 0), (5, 1)], 20, 3), ([(1, 1), (2, 1)], 20, -(10**9)), ([(1, 1), (2, 0)], 20, -(10**9)), ([(4, 0)], 5, 5), ([], 5, -(10**9))],
)
def test_threshold(rated, cost, cut):
    assert quality._threshold(rated, cost) == cut


def test_all_trusted_documents_count(make_docs, spark):
    rows, labels = corpus()
    labelled = spark.createDataFrame(labels + [(7, 0)], "doc_id long, quality int")
    few = quality.fit(make_docs(*rows), labelled, buckets=64, trusted_rows=10, poor_rows=10)
    assert few.weights == quality.fit(make_docs(*rows), labelled, buckets=64).weights


def test_repeated_ids_are_rated_once(make_docs, spark, monkeypatch):
    rows, labels = corpus()
    seen = []
    monkeypatch.setattr(quality, "_threshold", lambda rated, cost: seen.extend(rated) or 0)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    quality.fit(make_docs(*rows, *[rows[5]] * 300), labelled, buckets=64, trusted_rows=20, poor_rows=40)
    assert sorted(q for _, q in seen) == [0] * 32 + [1] * 20


def test_the_threshold_takes_all_labelled_documents(make_docs, spark):
    # Of 10,200 poor documents the 200 of which a bound of 10,000 would leave out look like some good ones.
    ids = spark.range(10_200).orderBy(F.xxhash64("id"), "id").collect()
    rows = [(r.id, "bad stuff") for r in ids[:10_000]] + [(r.id, "mixed bag") for r in ids[10_000:]]
    rows += [(20_000 + k, "mixed bag") for k in range(5)] + [(30_000 + k, "fine words") for k in range(50)]
    labels = [(d, int(d >= 20_000)) for d, _ in rows]
    docs, labels = make_docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int")
    ratio = quality.fit(docs, labels, buckets=1024)
    mean = {r.doc_id: r.mean_ratio for r in quality.judge(docs, ratio).collect()}
    assert mean[20_000] < ratio.threshold <= mean[30_000]
    assert quality.fit(docs, labels, buckets=1024, trusted_rows=20_000, poor_rows=10_000).threshold <= mean[20_000]


def test_threshold_over_tables(spark):
    draw = random.Random(3)
    for size, spread, cost in [(0, 1, 20), (1, 5, 20), (30, 4, 1), (400, 30_000, 2), (400, 90, 20), (300, 10**7, 1)]:
        rated = [(draw.randint(-spread, spread), int(draw.random() < 0.4)) for _ in range(size)]
        rated = [(mean + spread * quality_ // 2, quality_) for mean, quality_ in rated]
        frame = spark.createDataFrame(rated, "mean long, quality int")
        assert quality.threshold(frame, cost) == quality._threshold(sorted(rated), cost)


def test_fit_and_judge_at_once(make_docs, spark, rows_of):
    rows, labels = corpus()
    docs = make_docs(*rows, *EDGES, rows[5], rows[5])
    for known in (labels + [(7, 0), (None, 1)], [(k, 0) for k, _ in labels], []):
        labelled = spark.createDataFrame(known, "doc_id long, quality int")
        want = quality.judge(docs, quality.fit(docs, labelled, buckets=64))
        got = quality.fit_and_judge(docs, labelled, buckets=64)
        assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_edges_and_no_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    ratio = quality.fit(make_docs(*EDGES), none, buckets=16)
    got = quality.judge(make_docs(*EDGES), ratio).collect()
    assert len(got) == len(EDGES) and all(r.kept != r.base_failed for r in got)
    assert quality.judge(make_docs(), quality.fit(make_docs(), none, buckets=16)).count() == 0


def test_only_functions(make_docs):
    plan = quality.judge(make_docs((1, "a")), quality.Ratio((1,) * 16, 0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
