"""Quality rules: counts over words and lines, and a log-likelihood ratio of hashed n-grams.

Single tokens and pairs of neighbours are hashed into buckets. Two multinomials over the
buckets are counted in one scan: that of trusted documents and that of the whole corpus.
A document's score is the mean over its n-grams of log P(trusted) / P(corpus). The weights
are whole millionths, so sums do not depend on their order and equal texts get equal
verdicts everywhere. All of it runs as DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import texts_of, written

WORD = r"[^\x20\x09-\x0D]+"
# Runs of letters, of digits, and of anything else that is not blank.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
SYMBOLS = "[#*$%&|<>]"
SCALE = 1_000_000
# Below all means.
KEEP_ALL = -(10**9)
# Means, in millionths, whose running sums one group holds.
PART = 4096


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _between(first: int, size: Column, short: int) -> Column:
    """Places first .. first + size - short, or none: where n-grams of ``short`` begin."""
    places = F.sequence(F.lit(first), F.lit(first) + size - short)
    return F.when(size >= short, places).otherwise(F.array().cast("array<int>"))


def window_hashes(words: Column) -> Column:
    """Hashes of all three-word windows."""
    return F.transform(
        _between(0, F.size(words), 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )


def sorted_windows(hashes: Column) -> Column:
    """Hash and place of windows, in order: a window that the text has twice or more lies
    beside one with its hash. Empty where all hashes differ, which is found without sorting."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def base_rules(rows: DataFrame) -> DataFrame:
    """Adds to rows with ``text``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed."""
    text = F.col("text")
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    lines = rows.withColumns({"words": words_of(text), "lines": with_word})
    hashed = lines.withColumn("hashes", window_hashes(F.col("words")))
    ordered = hashed.withColumn("windows", sorted_windows(F.col("hashes")))
    windows = F.col("windows")
    twice = F.filter(
        windows,
        lambda w, k: F.coalesce(w["h"] == F.get(windows, k - 1)["h"], F.lit(False))
        | F.coalesce(w["h"] == F.get(windows, k + 1)["h"], F.lit(False)),
    )
    places = ordered.withColumn("places", F.transform(twice, lambda w: w["i"]))
    at = F.col("places")
    spread = F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))
    counted = places.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.size(F.array_distinct(spread)).cast("long"),
        }
    ).drop("words", "lines", "hashes", "windows", "places")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def buckets_of(tokens: Column, buckets: int) -> Column:
    """Buckets of the tokens and of pairs of neighbours."""

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    pairs = F.transform(
        _between(0, F.size(tokens), 2), lambda i: bucket(F.get(tokens, i), F.get(tokens, i + 1))
    )
    return F.concat(F.transform(tokens, lambda t: bucket(t)), pairs)


def with_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds ``grams``, the buckets of a row's n-grams, to rows with ``text``."""
    tokens = rows.withColumn("tokens", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    return tokens.withColumn("grams", buckets_of(F.col("tokens"), buckets)).drop("tokens")


@dataclass(frozen=True)
class Ratio:
    """Weights of the buckets in millionths, and the least mean that is kept."""

    weights: tuple[int, ...]
    threshold: int

    def total(self, grams: Column) -> Column:
        # Folded to one constant before the query runs.
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<bigint>")
        return F.aggregate(grams, F.lit(0).cast("long"), lambda sum_, g: sum_ + F.get(table, g))

    def mean(self, grams: Column) -> Column:
        """Mean weight of the n-grams in millionths, rounded down; 0 without any."""
        many = F.greatest(F.size(grams), F.lit(1)).cast("long")
        return F.floor(self.total(grams) / many).cast("long")


def _drawn(labelled: DataFrame, quality: int, rows: int | None) -> DataFrame:
    """The ids of one label; if ``rows`` are given, at most so many with the smallest hashes."""
    of = labelled.where(F.col("quality") == quality)
    return of if rows is None else of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id and quality once per id; an id with both labels is poor."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return rows.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def weigh(docs: DataFrame, labelled: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> Ratio | None:
    """Weights of the buckets, from all documents, to keep everything; None without trusted ones."""
    # Labels may be as many as documents: one join plan at all sizes.
    marked = texts_of(docs, id_col, text_col).join(labelled.hint("merge"), "doc_id", "left")
    # The outer form: else a filter on the size of the array is inferred, and pushing it
    # down to the scan would repeat the tokenizing for every element.
    hashed = with_buckets(marked, buckets).select("quality", F.explode_outer("grams").alias("bucket"))
    counts = (
        hashed.where("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count("*").alias("corpus"), F.count_if(F.col("quality") == 1).alias("trusted"))
        .collect()  # one row per bucket
    )
    corpus, target = [0] * buckets, [0] * buckets
    for row in counts:
        corpus[row.bucket], target[row.bucket] = row.corpus, row.trusted
    if not sum(target):
        return None
    all_corpus, all_target = sum(corpus) + buckets, sum(target) + buckets
    weights = tuple(
        round(SCALE * math.log(((t + 1) / all_target) / ((c + 1) / all_corpus)))
        for t, c in zip(target, corpus)
    )
    return Ratio(weights, KEEP_ALL)


def threshold(rated: DataFrame, cost: int) -> int:
    """The cut with the least loss over all rows of mean and quality, in the middle of the
    gap it lies in; equals ``_threshold`` of the same rows.

    Dropping what is at or below a mean changes the loss by a sum over the means up to it.
    The sums run inside parts of PART neighbouring means, on from those of the parts before:
    one row per part, of which the range of the weights allows some thousands.
    """
    change = F.sum(F.when(F.col("quality") == 1, cost).otherwise(-1))
    levels = rated.groupBy("mean").agg(change.alias("change"))
    levels = written(levels.withColumn("part", F.floor(F.col("mean") / PART)), "quality-levels")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = levels.groupBy("part").agg(F.sum("change").alias("sum"))
    bases = parts.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("mean").rowsBetween(Window.unboundedPreceding, 0)
    running = levels.withColumn("inside", F.sum("change").over(inside)).join(bases, "part")
    best = running.agg(F.min(F.struct(F.col("base") + F.col("inside"), "mean"))).first()[0]
    if best is None or best[0] >= 0:
        return KEEP_ALL  # dropping gains nothing
    low = best[1]
    high = levels.where(F.col("mean") > low).agg(F.min("mean")).first()[0]
    return low + max(1, ((low + 2 if high is None else high) - low) // 2)


def _rated(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean and quality of labelled rows; of a repeated id, the poorest."""
    known = rows.select("doc_id", "mean").join(labelled.hint("merge"), "doc_id")
    return known.groupBy("doc_id", "quality").agg(F.min("mean").alias("mean"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 17,
    trusted_rows: int | None = None,
    poor_rows: int | None = None,
    cost: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Ratio:
    """Counts the corpus and fits the threshold.

    ``labels`` has doc_id and quality (0 or 1). The trusted side counts all documents of
    quality 1, the corpus side every document. The threshold separates the trusted from the
    documents of quality 0, where a good document lost weighs ``cost`` times a poor one kept.
    It takes all of both, unless ``trusted_rows`` or ``poor_rows`` bound them; then they are
    drawn by the hash of their id. Null ids and labels do not count. Without trusted or poor
    documents everything is kept. An id that repeats is one document to the threshold, with
    the least of its means.
    """
    labelled = written(_labelled(labels), "quality-labels")
    ratio = weigh(docs, labelled, buckets, id_col, text_col)
    if ratio is None:
        return Ratio((0,) * buckets, KEEP_ALL)
    # Only ids and means are dealt out; texts are rated where they are read.
    rows = with_buckets(texts_of(docs, id_col, text_col), buckets).select("doc_id", ratio.mean(F.col("grams")).alias("mean"))
    drawn = _drawn(labelled, 1, trusted_rows).unionByName(_drawn(labelled, 0, poor_rows))
    rated = _rated(rows, drawn)
    if trusted_rows is None or poor_rows is None:
        return Ratio(ratio.weights, threshold(rated, cost))
    some = sorted((r["mean"], r.quality) for r in rated.collect())  # bounded by the parameters
    return Ratio(ratio.weights, _threshold(some, cost))


def fit_and_judge(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 17,
    cost: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``judge(docs, fit(docs, labels))``, where each text is rated once: the threshold is
    fitted on the means of the rows that are judged, which are written in between."""
    labelled = written(_labelled(labels), "quality-labels")
    ratio = weigh(docs, labelled, buckets, id_col, text_col)
    if ratio is None:
        return judge(docs, Ratio((0,) * buckets, KEEP_ALL), id_col, text_col)
    rows = written(judge(docs, ratio, id_col, text_col), "quality-rated")
    cut = threshold(_rated(rows.withColumnRenamed("mean_ratio", "mean"), labelled), cost)
    return rows.withColumn("kept", F.col("kept") & (F.col("mean_ratio") >= cut))


def _threshold(rated: list[tuple[int, int]], cost: int) -> int:
    """The cut with the least loss, in the middle of the gap it lies in."""
    poor = sum(1 for _, quality in rated if quality == 0)
    if not poor:
        return KEEP_ALL
    best, at = cost * len(rated), 0
    loss = poor  # nothing is dropped
    for k in range(len(rated) + 1):
        if (k == 0 or k == len(rated) or rated[k][0] != rated[k - 1][0]) and loss < best:
            best, at = loss, k
        if k < len(rated):
            loss += -1 if rated[k][1] == 0 else cost
    if at == 0:
        return KEEP_ALL
    low = rated[at - 1][0]
    high = rated[at][0] if at < len(rated) else low + 2
    return low + max(1, (high - low) // 2)


def judge(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the mean ratio in millionths.

    A null or empty text has no words and fails the base rules. Rows that repeat an id, or
    have none, are judged each; other columns are ignored.
    """
    rows = base_rules(texts_of(docs, id_col, text_col))
    scored = with_buckets(rows, len(ratio.weights)).withColumn("mean_ratio", ratio.mean(F.col("grams")))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("mean_ratio") >= ratio.threshold)).alias("kept"),
        "mean_ratio",
    )
