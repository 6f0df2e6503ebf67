from __future__ import annotations

import random
import time

from footfall.llm import toxicity
from footfall.llm.toxicity import Lexicon, collected, features, fold


def test_fold():
    assert fold("ІDІ0T") == fold("idiot") == fold("1d|ot") == fold("ｉｄｉｏｔ") == fold("id\u00adiot")
    assert fold("a.b,c\nd") == " a b c d "


def test_phrases_excuse_a_hit():
    machine = Lexicon({fold("trash").strip(): 2.0}, (fold("trash can").strip(),)).automaton()
    assert collected(machine, fold("trash")) == 2.0
    assert collected(machine, fold("a trash can here")) == 0.0
    assert collected(machine, fold("trash trash can")) == 2.0
    assert collected(machine, fold("whitetrash")) == 0.0
    assert collected(Lexicon().automaton(), fold("trash")) == 0.0


def test_length_counts():
    assert features(5.0, 10)[1] > features(5.0, 1000)[1]
    assert features(0.0, 0) == (0.0, 0.0)


def corpus(n=600, seed=3):
    draw = random.Random(seed)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "garbage"]
    rows, labels = [], []
    for k in range(n):
        words = [draw.choice(plain[:-1]) for _ in range(draw.randint(5, 60))]
        toxic = int(k % 4 == 0)
        if toxic:
            for bad in draw.sample(["jerkface", "numbsk" + draw.choice("abcd"), "g4rbage"], 2):
                words.insert(draw.randrange(len(words)), bad)
        elif k % 20 == 1:
            words.insert(0, "garbage truck")
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_learned_and_held_out(make_docs, spark):
    rows, labels = corpus()
    docs = make_docs(*rows, (10_000, None), (10_001, ""), (None, "jerkface numbska"), (5, rows[5][1]))
    labelled = spark.createDataFrame([(d, t) for d, t in labels if d % 3] + [(None, 1), (4, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labelled)
    assert any(stem.startswith("jerk") for stem in lexicon.weights)
    assert any(stem.startswith("garb") for stem in lexicon.weights)
    assert any("truck" in phrase for phrase in lexicon.exceptions)
    scored = toxicity.score(docs, lexicon).collect()
    assert len(scored) == len(rows) + 4
    truth = dict(labels)
    held = [(truth[r.doc_id], r.predicted) for r in scored if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 3 == 0]
    assert sum(t == p for t, p in held) / len(held) > 0.97
    assert all(p == 0 for t, p in held if t == 0)
    by = {r.doc_id: r for r in scored}
    assert by[None].predicted == 1 and by[10_000].score == by[10_001].score < 0.5
    assert all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in scored)


def test_sample_is_bounded(make_docs, spark):
    rows, labels = corpus()
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(make_docs(*rows), labelled, toxic_rows=60, clean_rows=100)
    assert lexicon == toxicity.learn(make_docs(*rows).repartition(7), labelled, toxic_rows=60, clean_rows=100)


def test_short_words_are_whole_words(make_docs, spark):
    draw = random.Random(9)
    plain = ["lorem", "ipsum", "dolor", "sit", "kyle", "by", "zygote", "日本語", "日光浴だ"]
    rows, labels = [], []
    for k in range(400):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 30))]
        if k % 4 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(["ky", "zyg", "日"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    labelled = spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, toxic int")
    lexicon = toxicity.learn(make_docs(*rows), labelled)
    assert set(lexicon.weights) == {"ky ", "zyg ", "日 "}
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in toxicity.score(make_docs(*rows), lexicon).collect())
    machine = Lexicon({"ky ": 2.0}).automaton()
    assert (collected(machine, fold("KY, ky")), collected(machine, fold("kyle sky"))) == (4.0, 0.0)


def test_repeated_ids_count_once(make_docs, spark):
    rows, labels = corpus()
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    copies = [rows[4]] * 900 + [rows[5]] * 900
    assert toxicity.learn(make_docs(*rows, *copies), labelled) == toxicity.learn(make_docs(*rows), labelled)


def test_nothing_to_learn(make_docs, spark):
    docs = make_docs((1, "some text"), (2, None))
    for labels in ([], [(1, 0)], [(1, 1)], [(1, 0), (2, 1)]):
        lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert lexicon == Lexicon()
        assert [r.predicted for r in toxicity.score(docs, lexicon).collect()] == [0, 0]
    assert toxicity.score(make_docs(), Lexicon({"x": 1.0})).count() == 0


def plain(lexicon, folded):
    """By looking everywhere for everything."""
    total = 0.0
    spans = [
        (k, k + len(p) + 2) for p in lexicon.exceptions for k in range(len(folded)) if folded.startswith(f" {p} ", k)
    ]
    for stem, weight in lexicon.weights.items():
        for k in range(len(folded)):
            if folded.startswith(f" {stem}", k) and not any(a <= k and k + len(stem) + 1 <= b for a, b in spans):
                total += weight
    return total


def test_against_a_plain_search():
    draw = random.Random(6)
    for _ in range(400):
        word = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(1, 3)))
        lexicon = Lexicon(
            {word() + draw.choice(["", " "]): float(1 << k) for k in range(5)},
            tuple({" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(3)}),
        )
        text = fold(" ".join(word() for _ in range(draw.randint(0, 30))))
        assert collected(lexicon.automaton(), text) == plain(lexicon, text)


def test_many_hits_and_many_phrases_take_linear_time():
    lexicon = Lexicon({"bad": 1.0}, (fold("bad luck").strip(),))
    machine, text = lexicon.automaton(), fold("bad luck bad " * 100_000)
    began = time.process_time()
    assert collected(machine, text) == 100_000.0
    assert time.process_time() - began < 10
