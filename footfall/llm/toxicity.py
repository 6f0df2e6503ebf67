"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Text is folded before it is matched: case, letters of other scripts that look alike,
full-width forms, invisible characters, and digits or signs written for letters. The
lexicon holds beginnings of words, and short words as a whole, with weights learned from
labelled documents, and phrases around them that labelled documents show to be harmless. The weights a document
collects are set against its length and turned into a score by a fitted logistic curve.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.common import prepare, texts_of, written

# Characters that pass for Latin letters, and what they pass for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
# Digits and signs written for letters. One stroke may be an i or an l, so
# both letters fold to one.
WRITTEN_FOR = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "€": "e", "|": "i", "l": "i",
}
# Beginnings in fewer documents are not tested.
OFTEN = 4
INVISIBLE = "­​‌‍⁠﻿"
SEPARATORS = "\t\n\r\x0b\x0c !\"#%&'()*+,-./:;<=>?[\\]^_`{}~¡¿«»“”„‘’…–—·•"


def _folding() -> dict[int, str | None]:
    """One table for str.translate, applied after lower-casing."""
    table: dict[int, str | None] = {ord(c): " " for c in SEPARATORS}
    table |= {ord(c): None for c in INVISIBLE}
    table |= {ord(c): WRITTEN_FOR.get(to, to) for c, to in LOOKALIKES.items()}
    table |= {ord(c): to for c, to in WRITTEN_FOR.items()}
    for code in range(0x21, 0x7F):  # full-width forms lie at a fixed distance
        plain = chr(code).lower()
        table[code + 0xFEE0] = table.get(ord(plain), plain)
    return table


FOLDING = _folding()


def fold(text: str) -> str:
    """Folded text, a blank at either end; words are apart by blanks."""
    return f" {text.lower().translate(FOLDING)} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of word beginnings, harmless phrases, and the curve of the score. A
    beginning that ends with a blank is a whole word."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-6.0, 0.0, 0.0)

    def automaton(self):
        """Aho-Corasick over both kinds; a value is (length, weight), without a weight for
        a phrase. None when there is nothing to find."""
        if not self.weights:
            return None
        machine = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            machine.add_word(f" {stem}", (len(stem) + 1, weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        machine.make_automaton()
        return machine


def collected(machine, folded: str) -> float:
    """Sum of the weights found outside harmless phrases."""
    if machine is None:
        return 0.0
    total, harmless, hits = 0.0, [], []
    for end, (length, weight) in machine.iter(folded):
        if weight is None:
            harmless.append((end - length + 1, end))
        else:
            hits.append((end - length + 1, end, weight))
    # Of the phrases that begin up to a place, how far the farthest reaches.
    harmless.sort()
    begins, reach = [a for a, _ in harmless], list(accumulate((b for _, b in harmless), max))
    for start, end, weight in hits:
        before = bisect_right(begins, start)
        if not before or reach[before - 1] < end:
            total += weight
    return total


def features(total: float, words: int) -> tuple[float, float]:
    """What is found, and what is found per hundred words, both on a log scale."""
    return float(np.log1p(total)), float(np.log1p(100.0 * total / max(words, 1)))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _prefixes(folded: str, shortest: int, longest: int) -> set[str]:
    """Beginnings of words, and with a blank behind them the words that are too short."""
    words = set(folded.split())
    found = {word[:n] for word in words for n in range(shortest, min(len(word), longest) + 1)}
    return found | {f"{word} " for word in words if len(word) < shortest}


def _counted(sample: DataFrame, parts) -> DataFrame:
    """part, toxic, clean: in how many documents of each kind a part occurs.

    ``parts`` maps folded text to a set of strings; counts are added up by batch before
    they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(parts(fold(text)))
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string())] + [
                pa.array([counts[label][name] for name in names], pa.int64()) for label in (1, 0)
            ]
            yield pa.record_batch(columns, ["part", "toxic", "clean"])

    counts = sample.select("toxic", "text").mapInArrow(run, "part string, toxic long, clean long")
    return counts.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _choose(counts: DataFrame, toxic: int, clean: int, entries: int, chance: float) -> dict[str, float]:
    """Beginnings far more frequent in toxic documents than chance explains.

    A beginning must have a log-likelihood ratio statistic of toxic against clean that
    among all beginnings seen some times (``OFTEN``) chance would reach with a probability
    of about ``chance``. Of nested beginnings the most telling one is taken.
    """
    candidates = counts.where(F.col("toxic") + F.col("clean") >= OFTEN).count()
    surprise = 2 * math.log(max(candidates, 1) / chance)
    share = toxic / (toxic + clean)
    seen = F.col("toxic") + F.col("clean")
    mine, theirs = F.col("toxic"), F.col("clean")
    statistic = 2 * (
        mine * F.log(F.greatest(mine, F.lit(1)) / (seen * share))
        + theirs * F.log(F.greatest(theirs, F.lit(1)) / (seen * (1 - share)))
    )
    rows = (
        counts.withColumn("statistic", statistic)
        .where((F.col("statistic") >= surprise) & (mine * clean > 9 * theirs * toxic))
        .orderBy(F.desc("statistic"), F.length("part"), "part")
        .limit(20 * entries)
        .collect()
    )
    weights: dict[str, float] = {}
    taken: set[str] = set()  # all beginnings of what is chosen
    for row in rows:
        part = row.part
        if len(weights) >= entries:
            break
        if part in taken or any(part[:n] in weights for n in range(1, len(part))):
            continue
        odds = ((row.toxic + 0.5) / (toxic + 1)) / ((row.clean + 0.5) / (clean + 1))
        weights[part] = round(float(np.log(odds)), 4)
        taken.update(part[:n] for n in range(1, len(part) + 1))
    return weights


def _harmless(sample: DataFrame, weights: dict[str, float], phrases: int) -> tuple[str, ...]:
    """Two-word phrases with a word of the lexicon that clean documents use at least three
    times as often as toxic ones."""
    stems = re.compile("|".join(map(re.escape, sorted(weights, key=len, reverse=True))))

    def around(folded: str) -> set[str]:
        words = folded.split()
        found = set()
        for k, word in enumerate(words):
            if stems.match(f"{word} "):
                found.update(" ".join(words[a : a + 2]) for a in (k - 1, k) if 0 <= a < len(words) - 1)
        return found

    counts = _counted(sample, around).where("clean >= 3 AND clean >= 3 * toxic")
    return tuple(r.part for r in counts.orderBy(F.desc("clean"), "part").limit(phrases).collect())


def _fit_curve(found: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's steps, slightly pulled to zero; slopes stay positive."""
    x = np.column_stack([np.ones(len(found)), found])
    w, pull = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - labels) + pull @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 6) for v in w)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = 4_000,
    clean_rows: int = 12_000,
    entries: int = 500,
    phrases: int = 200,
    shortest: int = 4,
    longest: int = 12,
    chance: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Lexicon:
    """Learns from labelled documents; ``labels`` has doc_id and toxic (0 or 1).

    At most ``toxic_rows`` and ``clean_rows`` labelled rows are used, those whose id has the
    smallest hash. Rows with a null id or label are left out, an id labelled more than once
    counts as toxic if one label says so. Entries have ``shortest`` to ``longest`` letters;
    shorter words may be entries as a whole. Of rows that repeat an id the least text counts. With one kind of label only, or none, the
    lexicon is empty and every score is low.
    """
    spark = prepare(docs.sparkSession)
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("draw", F.xxhash64("doc_id"))
    )
    chosen = [
        labelled.where(F.col("toxic") == label).orderBy("draw", "doc_id").limit(rows).select("doc_id", "toxic")
        for label, rows in ((1, toxic_rows), (0, clean_rows))
    ]
    picked = written(chosen[0].unionByName(chosen[1]), "toxicity-rows")  # bounded, so it may be broadcast
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
    # Of rows that repeat an id one, so that the sample is bounded by the two parameters.
    sample = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Lexicon()
    sample = sample.repartition(spark.sparkContext.defaultParallelism)
    counts = written(
        _counted(sample, lambda folded: _prefixes(folded, shortest, longest)), "toxicity-counts"
    )
    weights = _choose(counts, kinds[1], kinds[0], entries, chance)
    if not weights:
        return Lexicon()
    exceptions = _harmless(sample, weights, phrases)
    found = _found(sample.select("doc_id", "text", "toxic"), Lexicon(weights, exceptions))
    rows = found.select("toxic", "total", "words").toPandas()
    measured = np.array([features(t, n) for t, n in zip(rows.total, rows.words)])
    return Lexicon(weights, exceptions, _fit_curve(measured, rows.toxic.to_numpy(dtype=float)))


def _found(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of doc_id, text and toxic with total and words in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            folded = [fold(text) for text in batch.column(1).to_pylist()]
            totals = pa.array([collected(machine, text) for text in folded], pa.float64())
            words = pa.array([len(text.split()) for text in folded], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), totals, words], ["doc_id", "toxic", "total", "words"])

    return rows.mapInArrow(run, "doc_id long, toxic int, total double, words long")


def scorer(lexicon: Lexicon):
    """A column function from text to score (0 to 1); a null text is scored as empty."""
    base, slope, dense = lexicon.curve

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = lexicon.automaton()
        for texts in batches:
            scores = []
            for text in texts:
                folded = fold(text or "")
                total = collected(machine, folded)
                one, two = features(total, len(folded.split()) if total else 1)
                scores.append(float(_sigmoid(base + slope * one + dense * two)))
            yield pd.Series(scores, dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def score(
    docs: DataFrame,
    lexicon: Lexicon,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (1 from ``threshold``).

    Only the text is looked at. Null and empty texts get the score of a text in which
    nothing is found. Rows that repeat an id, or have none, are scored each; other columns
    are ignored.
    """
    prepare(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select("doc_id", scorer(lexicon)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    prepare(docs.sparkSession)
    return docs.where(scorer(lexicon)(docs[text_col].cast("string")) < threshold)
