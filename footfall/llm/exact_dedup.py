"""Exact duplicates: sorted runs of digests merged along a tree.

Every text is reduced to (SHA-256, length) and a second digest of another kind. Rows are
dealt to leaf runs by their id, and the runs are merged in binomial rounds: in each round
the run numbers lose a few bits, so that ``fan_in`` runs meet in partitions by digest, are
merged in the order of the digests, and a digest keeps one row: its best identifier with the
second digest of its text, and its count. The identifier is a struct, for which Spark
aggregates over sorted rows only, so each run is sorted before it is exchanged and merged
in order behind the exchange. At every level the second digests of a group must agree,
which verifies that equal digests are equal texts. A text that makes up a third of the table
never reaches the root as more than ``fan_in`` rows, because each leaf has reduced it
already, and every round is spread over tasks by digest as well as by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import ascii_lower, texts_of, written

KEY = ["text_sha256", "n_chars"]
FAN_IN_BITS = 2  # four runs meet
ROUNDS = 3


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and length of the text with A-Z lower-cased, and the leaf run."""
    rows = texts_of(docs, id_col, text_col)
    normal = ascii_lower(F.col("text"))
    runs = 1 << (FAN_IN_BITS * ROUNDS)
    return rows.select(
        "doc_id",
        F.sha2(normal, 256).alias("text_sha256"),
        F.length("text").alias("n_chars"),
        F.xxhash64(normal).alias("second"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(runs)).cast("int").alias("run"),
    ).withColumn("run", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("run")))


def _reduced(level: DataFrame, best: str, rows: Column) -> DataFrame:
    """One row per digest and run, by a merge of sorted rows; see above."""
    merged = (
        level.groupBy(*KEY, "run")
        .agg(
            getattr(F, best)("kept_row").alias("kept_row"),
            F.sum(rows).alias("group_size"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
        )
    )
    complaint = F.concat(F.lit("different texts have the digest "), F.col("text_sha256"))
    same = F.when(F.col("least") == F.col("most"), F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    return merged.where(same)


def leaf_runs(rows: DataFrame, best: str) -> DataFrame:
    """Each run with one row per digest: the best identifier and the number of rows."""
    named = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), "second"))
    leaves = rows.withColumns({"kept_row": named, "least": F.col("second"), "most": F.col("second")})
    return _reduced(leaves, best, F.lit(1).cast("long"))


def merge_runs(leaf: DataFrame, best: str) -> DataFrame:
    """The root of the tree, one row per digest; ``best`` is ``min`` or ``max``."""
    level = leaf
    for _ in range(ROUNDS):
        level = _reduced(level.withColumn("run", F.shiftright("run", FAN_IN_BITS)), best, F.col("group_size"))
    return level.withColumn("keep_id", F.col("kept_row.id"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty
    texts form one group. ``keep`` says whether the smallest or largest id of a group
    stays. Rows that repeat an id with the same text count each, and all of them carry the
    id that stays. A null id never stays while its group has another; a group of null ids
    alone has a null keep_id and ``kept`` is true. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows = written(digests(docs, id_col, text_col), "digests")
    best = "min" if keep == "smallest" else "max"
    leaf = written(leaf_runs(rows, best), "digest-leaves")
    root = written(merge_runs(leaf, best), "digest-root")
    answers = leaf.select(*KEY, "run").join(root.select(*KEY, "keep_id", "group_size"), KEY)
    return rows.join(answers, [*KEY, "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def without_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat an id with an equal text stay or go together.
    """
    groups = exact_groups(docs, id_col, text_col, keep)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    text = ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(gone["_id"]) & (F.sha2(text, 256) == gone["_digest"])
    return docs.join(gone, same, "left_anti")
