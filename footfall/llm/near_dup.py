"""Near duplicates: MinHash with tensored banding, then exact confirmation.

Banding needs many tables, each keyed by several minhashes. Instead of new minhashes for
every table, two collections of ``groups`` groups are computed, and table (i, j) is keyed
by group i of the first with group j of the second: groups x groups tables from
2 x groups x ``width`` minhashes. Two sets of similarity s share a table unless one
collection has no equal group, which happens with a probability below
2 (1 - s^width)^groups: 12 groups of 2 miss a pair at 0.8 once in 100,000, 12 groups of 3
one at 0.85 once in 45,000, and more similar ones far more rarely.

Equal sets are one class and only its first document is compared. Documents that share a
table are gathered around the smallest id among them, and within these neighbourhoods all
pairs that share a table are confirmed on their full sets. A neighbourhood is dealt into
blocks of bounded size, and each pair of blocks is a unit of work, so that a family with a
third of all documents is spread over tasks and no task holds it whole. Pairs never become
rows: a unit returns one edge per document, to the smallest id of its group.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import prepare, texts_of, written
from footfall.llm.components import components
from footfall.llm.shingles import mixed, shingle_sets

GROUPS, WIDTH = 12, 2
# Documents of a block; a unit holds the sets of two.
BLOCK = 2048
# Tasks that the members of one neighbourhood are spread over while they are dealt.
SALTS = 16
# Set members that are compared at a time, and pairs.
COLUMNS, PAIRS = 1 << 15, 1 << 20


def _multipliers(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)


def group_hashes(sets: list[np.ndarray], groups: int, width: int) -> np.ndarray:
    """(sets, 2 x groups): hashes of ``width`` minhashes each. Sets must not be empty."""
    result = np.zeros((len(sets), 2 * groups), dtype=np.uint64)
    if not sets:
        return result
    members = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k, by in enumerate(_multipliers(2 * groups * width)):
        least = np.minimum.reduceat(mixed_lightly(members, by), starts)
        column = result[:, k // width]
        column[:] = mixed(column * np.uint64(31) + least)
    return result


def mixed_lightly(x: np.ndarray, by: np.uint64) -> np.ndarray:
    """One of a family of permutations of 64-bit values; enough for values that are hashes."""
    x = x * by
    return (x ^ (x >> np.uint64(32))) * by


def table_keys(hashes: np.ndarray, groups: int) -> np.ndarray:
    """(sets, groups^2): a key for each pair of a group of either collection."""
    first, second = hashes[:, :groups], mixed(hashes[:, groups:])
    table = np.arange(groups * groups, dtype=np.uint64).reshape(groups, groups)
    return mixed(first[:, :, None] + mixed(second[:, None, :] + table)).reshape(len(hashes), -1)


def _texts(column: pa.Array) -> list[bytes]:
    return [text.encode("utf-8", "surrogatepass") for text in column.to_pylist()]


def signatures(rows: DataFrame, shingle: int, groups: int, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and the group hashes, of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch.column(1)), shingle)
            some = [k for k, s in enumerate(sets) if len(s)]
            hashes: list[bytes | None] = [None] * len(sets)
            for k, row in zip(some, group_hashes([sets[k] for k in some], groups, width)):
                hashes[k] = row.tobytes()
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column(0), sizes, pa.array(digest, pa.binary()), pa.array(hashes, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "n_shingles", "digest", "hashes"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, hashes binary")


def _neighbours(classes: DataFrame, groups: int) -> DataFrame:
    """centre, doc_id: documents that share a table with a centre, the smallest id there."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64)
                keys = table_keys(hashes.reshape(batch.num_rows, -1), groups)
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "doc_id"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None  # of the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1]))
            centres = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))].copy()
            if not new[0]:
                centres[: np.argmax(new) if new.any() else len(ids)] = centre
            last, centre = keys[-1], centres[-1]
            pairs = np.unique(np.column_stack([centres, ids])[centres != ids], axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["centre", "doc_id"])

    tables = classes.select("doc_id", "hashes").mapInArrow(keyed, "key long, doc_id long")
    sorted_by_key = tables.repartition("key").sortWithinPartitions("key", "doc_id")
    return sorted_by_key.mapInArrow(met, "centre long, doc_id long").distinct()


def _units(pairs: DataFrame) -> DataFrame:
    """centre, one, two, own, doc_id: each neighbourhood dealt into blocks, a unit for each pair
    of blocks (one <= two); a document is in every unit of its block. The centre is dealt
    like the others."""
    members = pairs.union(pairs.select("centre", F.col("centre").alias("doc_id")).distinct())
    blocks = members.groupBy("centre").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    # Members of one centre meet its number of blocks in several tasks.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("salt", salt).join(salted, ["centre", "salt"]).withColumn("own", own)
    others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return others.select(
        "centre",
        F.least("own", "other").alias("one"),
        F.greatest("own", "other").alias("two"),
        "own",
        "doc_id",
    )


class _Groups:
    """Union-find over 0 .. n - 1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            further = self.up[self.up]
            if (further == self.up).all():
                return further
            self.up = further

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins all pairs; each sweep hooks larger roots to smaller ones."""
        while True:
            up = self.roots()
            x, y = up[a], up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _overlaps(
    left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray, count: int, width: int
) -> np.ndarray:
    """Sizes of the intersections of pairs of ``count`` sets given as (row, column) members
    in order of columns."""
    shared = np.zeros(len(left), dtype=np.int64)
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(columns, (start, start + COLUMNS))
        if a == b:
            continue
        bits = np.zeros((count, min(COLUMNS, width - start)), dtype=bool)
        bits[rows[a:b], columns[a:b] - start] = True
        packed = np.packbits(bits, axis=1)
        padded = np.zeros((count, -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
        padded[:, : packed.shape[1]] = packed
        words = padded.view(np.uint64)
        step = max(1, (1 << 22) // words.shape[1])
        for k in range(0, len(left), step):
            both = words[left[k : k + step]] & words[right[k : k + step]]
            shared[k : k + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return shared


def linked_groups(
    sets: list[np.ndarray], hashes: np.ndarray, groups: int, percent: int, side: np.ndarray | None = None
) -> np.ndarray:
    """For each set the first one it is linked with, directly or through others.

    Sets are linked when they share a table and 100 x intersection >= percent x union.
    With ``side``, only pairs of which one is in block 0 and one in block 1 are looked at.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    found = _Groups(n)
    members = np.concatenate(sets)
    rows = np.repeat(np.arange(n), sizes)
    _, code, often = np.unique(members, return_inverse=True, return_counts=True)
    keep = often[code] > 1  # a member of one set only adds to no intersection
    _, columns = np.unique(code[keep], return_inverse=True)
    rows = rows[keep]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    width = int(columns[-1]) + 1 if len(columns) else 0
    step = max(1, PAIRS // n)
    for start in range(0, n, step):
        stop = min(n, start + step)
        up = found.roots()
        maybe = up[start:stop, None] != up[None, :]
        maybe &= np.arange(start, stop)[:, None] < np.arange(n)[None, :]
        if side is not None:
            maybe &= side[start:stop, None] != side[None, :]
        small = np.minimum(sizes[start:stop, None], sizes[None, :])
        maybe &= 100 * small >= percent * np.maximum(sizes[start:stop, None], sizes[None, :])
        for half in (hashes[:, :groups], hashes[:, groups:]):
            met = np.zeros_like(maybe)
            for k in range(groups):
                met |= half[start:stop, k, None] == half[None, :, k]
            maybe &= met
        left, right = np.nonzero(maybe)
        if not len(left) or not width:
            continue
        left = left + start
        shared = _overlaps(left, right, rows, columns, n, width)
        linked = 100 * shared >= percent * (sizes[left] + sizes[right] - shared)
        found.join(left[linked], right[linked])
    return found.roots()


def _confirmed(units: DataFrame, sets: DataFrame, groups: int, percent: int) -> DataFrame:
    """a, b: each document of a unit with the smallest id it is linked with there."""
    ordered = units.join(sets, "doc_id").repartition("centre", "one", "two").sortWithinPartitions("centre", "one", "two", "doc_id")

    def solve(unit: tuple, rows: list[tuple]) -> pa.RecordBatch:
        own, ids, blobs, hashes = zip(*rows)
        table = np.frombuffer(b"".join(hashes), dtype=np.uint64).reshape(len(ids), -1)
        members = [np.frombuffer(blob, dtype=np.uint64) for blob in blobs]
        # Pairs inside a block belong to the unit of that block with itself.
        side = None if unit[1] == unit[2] else np.array(own)
        first = linked_groups(members, table, groups, percent, side)
        number = np.array(ids, dtype=np.int64)
        apart = first != np.arange(len(ids))
        return pa.record_batch([pa.array(number[first[apart]]), pa.array(number[apart])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for batch in batches:
            for centre, one, two, *row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (centre, one, two) != unit:
                    if len(held) > 1:
                        yield solve(unit, held)
                    unit, held = (centre, one, two), []
                # An id may repeat, with other texts or the same one.
                same_id = itertools.takewhile(lambda other: other[1] == row[1], reversed(held))
                if all(other[2] != row[2] for other in same_id):
                    held.append(row)
        if len(held) > 1:
            yield solve(unit, held)

    return ordered.select("centre", "one", "two", "own", "doc_id", "set", "hashes").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    groups: int = GROUPS,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than the ASCII blanks, A-Z lower-cased; a set holds
    the distinct shingles of ``shingle`` words, or the whole sequence of a shorter text.
    Documents are linked when 100 x intersection >= ``percent`` x union of their sets.
    ``component_id`` is the smallest id reachable over links, and that document is kept.
    Null, empty and blank texts have no set and are linked with nothing. Rows that repeat
    an id are one document for its links. Rows without an id are linked with nothing and
    kept. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col)
    signed = written(signatures(rows, shingle, groups, width), "near-signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("first")), "near-classes")
    firsts = usable.join(classes.withColumnRenamed("first", "doc_id"), ["digest", "doc_id"])
    firsts = firsts.dropDuplicates(["digest", "doc_id"]).select("doc_id", "hashes")
    pairs = written(_neighbours(firsts, groups), "near-neighbours")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch.column(1)), shingle)
            some = [k for k, s in enumerate(sets) if len(s)]
            sets = [sets[k] for k in some]
            tables = [row.tobytes() for row in group_hashes(sets, groups, width)]
            blobs = pa.array([s.tobytes() for s in sets], pa.binary())
            ids = batch.column(0).take(pa.array(some, pa.int64()))
            yield pa.record_batch([ids, blobs, pa.array(tables, pa.binary())], ["doc_id", "set", "hashes"])

    compared = pairs.select("doc_id").union(pairs.select("centre")).distinct()
    # One plan at every size: ids are never broadcast, however few they are.
    texts = rows.join(compared.hint("merge"), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(whole, "doc_id long, set binary, hashes binary"), "near-sets")
    edges = _confirmed(_units(pairs), sets, groups, percent)
    same_id = usable.join(classes, "digest").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    roots = components(edges.union(same_id.where("a <> b")))
    answered = signed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return answered.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each
    group. Rows without an id stay. ``parameters`` are those of ``near_duplicates``."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **parameters)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_id"], "left_anti")
