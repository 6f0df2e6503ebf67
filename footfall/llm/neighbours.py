"""Nearest neighbours: p-stable hashing, several cells probed per table, exact distances.

A table has a few functions floor((a.v + b) / width) with Gaussian a, so the difference of
two projections is Gaussian with the distance of the vectors as its deviation. A vector's
cell is the tuple of its slots. For a query the chance that a neighbour at the typical
distance lies in a slot is known, hence that of every cell near its own; the cells are
probed in the order of that chance. All tables' candidates are ranked by exact distance.

Equal vectors are one class with its smallest ids, as no other can be among the nearest.
Cells are dealt into blocks of bounded size, and so are the queries that probe a cell: a
unit of work is a block of vectors and a block of queries, whatever a cell holds. Pairs never
become rows: a unit returns the nearest of each query. A query with too few candidates is
compared with all vectors, in the same blocks.

Width, functions and probes are fitted on a bounded sample (``SAMPLE`` vectors). A sample is
thinner than the table, its neighbours are farther apart, so the recall seen there is a
cautious estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import prepare, written
from footfall.llm.shingles import mixed

TABLES, SAMPLE, SAMPLE_QUERIES = 2, 4096, 256
# Most cells probed per table, slots looked at on either side, vectors wanted in a cell.
PROBES, REACH, CELL_ROWS = 64, 3, 2048
# A unit's vectors and queries; rows of an Arrow batch; queries compared at a time.
BLOCK, QUERY_BLOCK, ARROW_ROWS, STEP = 1 << 15, 1 << 13, 2048, 128
# The table number of the comparison with everything.
ALL = -1


@dataclass(frozen=True)
class Index:
    """How vectors are hashed and how many cells a query probes."""

    functions: int
    width: float
    reach: float  # the typical distance of a neighbour
    probes: int
    tables: int = TABLES
    seed: int = 7

    def projected(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """(rows, functions) places in units of the width."""
        draw = np.random.default_rng([self.seed, table, vectors.shape[1]])
        directions = draw.standard_normal((vectors.shape[1], self.functions))
        return vectors @ directions / self.width + draw.uniform(0, 1, self.functions)

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return _named(np.floor(self.projected(vectors, table)), vectors.shape[1])

    def probed(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """(rows, cells) by falling chance to hold a neighbour.

        Functions are added one by one, and the best beginnings kept: a beginning that
        ``probes`` others beat cannot end among the best.
        """
        places = self.projected(vectors, table)
        own = np.floor(places)
        shifts = np.arange(-REACH, REACH + 1)
        rows = np.arange(len(vectors))[:, None]
        chance = np.zeros((len(vectors), 1))
        slots = np.zeros((len(vectors), 1, 0))
        for k in range(self.functions):
            slot = own[:, k, None] + shifts
            edges = (np.concatenate([slot, slot[:, -1:] + 1], axis=1) - places[:, k, None]) * self.width / self.reach
            share = np.diff(_normal(edges), axis=1)
            chance = (chance[:, :, None] + np.log(np.maximum(share, 1e-300))[:, None]).reshape(len(vectors), -1)
            best = np.argsort(-chance, axis=1, kind="stable")[:, : self.probes]
            chance = chance[rows, best]
            before, shift = np.divmod(best, len(shifts))
            slots = np.concatenate([slots[rows, before], slot[rows, shift][:, :, None]], axis=2)
        return _named(slots.reshape(-1, self.functions), vectors.shape[1]).reshape(chance.shape)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to some seven digits."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail *= np.exp(-np.minimum(x * x, 1400) / 2) / math.sqrt(2 * math.pi)
    return np.where(x > 0, 1 - tail, tail)


def _named(slots: np.ndarray, dimensions: int) -> np.ndarray:
    """One number for each row of slots; vectors of other lengths get other numbers."""
    name = np.full(len(slots), dimensions, dtype=np.uint64)
    for column in np.clip(slots, -(2.0**62), 2.0**62).astype(np.int64).T:
        name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return name.astype(np.int64)


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding; unknown where they overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (left * left).sum(1)[:, None] + (right * right).sum(1) - 2 * left @ right.T


def distance(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    gap = vectors - query
    with np.errstate(over="ignore"):
        exact = np.sqrt((gap * gap).sum(1))
    for far in np.flatnonzero(~np.isfinite(exact)):
        top = np.abs(gap[far]).max()
        exact[far] = top * math.sqrt(((gap[far] / top) ** 2).sum())
    return exact


def fit(sample: np.ndarray, rows: int, k: int = 10, recall: float = 0.95) -> Index:
    """An index for a table of ``rows`` vectors, from a sample of them.

    Slots are two deviations of a projection wide, about one bit each. Starting with as
    many functions as leave ``CELL_ROWS`` vectors in a cell, functions are given up until
    the probes find the asked share of the sample's own neighbours.
    """
    sample = np.unique(sample.astype(float), axis=0)
    functions = max(1, round(math.log2(max(rows, 1) / CELL_ROWS))) if rows > CELL_ROWS else 1
    if len(sample) < 2:
        return Index(functions, 1.0, 1.0, PROBES)
    with np.errstate(over="ignore"):
        width = 2 * math.sqrt(sample.var(axis=0).sum())
    if not math.isfinite(width):
        # Components so large that squares overflow: cells tell nothing, all is compared.
        return Index(1, 1.0, 1.0, 1)
    draw = np.random.default_rng(3)
    asked = draw.permutation(len(sample))[:SAMPLE_QUERIES]
    gaps = squared(sample[asked], sample)
    gaps[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(gaps, axis=1)[:, : min(k, len(sample) - 1)]
    reach = math.sqrt(max(np.median(np.take_along_axis(gaps, near, 1)[:, -1]), 0.0))
    reach = max(reach, 1e-6 * width)
    while True:
        index = Index(functions, width, reach, PROBES)
        found = np.full((*near.shape, index.tables), PROBES)
        for table in range(index.tables):
            cells, probed = index.cells(sample, table), index.probed(sample[asked], table)
            hit = cells[near][:, :, None] == probed[:, None, :]
            found[:, :, table] = np.where(hit.any(2), hit.argmax(2), PROBES)
        ranks = np.sort(found.min(2), axis=None)
        needed = int(ranks[min(math.ceil(recall * len(ranks)), len(ranks)) - 1]) + 1
        if needed <= PROBES or functions == 1:
            return Index(functions, width, reach, min(needed, PROBES))
        functions -= 1


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector of the rows that take part: neither is null, and the vector has
    finite components only and is not zero. Components stay single where they are."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = vectors[vector_col] if kind == "array<float>" else vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    some = F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite & some, F.lit(False)))


def _list_type(frame: DataFrame) -> str:
    return frame.schema["v"].dataType.simpleString()


def _blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(ends)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[ends[rows][:, None] + np.arange(length)]


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """v, ids: every different vector with its smallest ids, at most ``ids`` of them.

    Tasks keep only the smallest ids of a vector before anything is shuffled, so that a
    vector that a third of all rows have costs no more than any other.
    """
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= ids)
    places = [F.min(F.when(F.col("rank") == place, F.col("id"))) for place in range(1, ids + 1)]
    return ranked.groupBy("v").agg(F.array_compact(F.array(*places)).alias("ids"))


def _with_cells(rows: DataFrame, index: Index, probe: bool) -> DataFrame:
    """The rows with ``cell``, an array of a table's number and a cell each."""
    names = [c for c in rows.columns if c != "places"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, matrix in _blocks(batch.column("v")):
                for start in range(0, len(rows_), STEP * 4):
                    part = slice(start, start + STEP * 4)
                    table, cell = [], []
                    for t in range(index.tables):
                        found = index.probed(matrix[part], t) if probe else index.cells(matrix[part], t)[:, None]
                        cell.append(found)
                        table.append(np.full_like(found, t))
                    table, cell = np.concatenate(table, axis=1), np.concatenate(cell, axis=1)
                    ends = pa.array(np.arange(len(cell) + 1, dtype=np.int32) * cell.shape[1])
                    pairs = pa.StructArray.from_arrays(
                        [pa.array(table.ravel().astype(np.int32)), pa.array(cell.ravel())], ["table", "cell"]
                    )
                    some = batch.take(pa.array(rows_[part]))
                    yield pa.RecordBatch.from_arrays(
                        [*[some.column(n) for n in names], pa.ListArray.from_arrays(ends, pairs)], [*names, "places"]
                    )

    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    found = rows.mapInArrow(hashed, f"{fields}, places array<struct<table:int,cell:bigint>>")
    return found.select("*", F.inline("places")).drop("places")


def _hot(placed: DataFrame, size: int, name: str, spark_name: str) -> DataFrame:
    """Cells with more rows than a block, and into how many they are dealt. As a written
    table its size is known, so that Spark broadcasts it only where it is small."""
    counts = placed.groupBy("table", "cell").agg(F.count("*").alias("n")).where(F.col("n") > size)
    parts = F.ceil(F.col("n") / size).cast("int").alias(name)
    return written(counts.select("table", "cell", parts), spark_name)


def _dealt(placed: DataFrame, own: str, hot: dict[str, DataFrame], key: Column) -> DataFrame:
    """One row for each unit: a row is dealt to one of its own side's blocks, and goes to
    every block of the other side."""
    for name, cells in hot.items():
        placed = placed.join(cells, ["table", "cell"], "left").withColumn(name, F.coalesce(name, F.lit(1)))
    [other] = [name for name in hot if name != own]
    return placed.withColumns(
        {own: F.pmod(F.xxhash64(key), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
    )


def _nearest_in_units(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, vec_id, score: the nearest ``k`` ids of every unit and query."""
    unit = ["table", "cell", "block", "query_block"]
    columns = [*unit, "query", "ids", "v"]
    no_ids, no_query = F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("long").alias("query")
    both = vectors.withColumn("query", no_query).select(columns).unionByName(queries.withColumn("ids", no_ids).select(columns))
    # The vectors of a unit come before its queries.
    both = both.repartition(*unit).sortWithinPartitions(*unit, F.asc_nulls_first("query"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in unit], axis=1)
            is_query = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (is_query[1:] != is_query[:-1])) + 1
            for start, stop in zip([0, *change], [*change, len(keys)]):
                if now is None or (keys[start] != now).any():
                    now, held, block = keys[start], [], None
                part = batch.slice(start, stop - start)
                if not is_query[start]:
                    held.append(part)
                elif held:
                    block = block or _Block(pa.Table.from_batches(held).combine_chunks())
                    yield from block.answer(part, k)

    return both.mapInArrow(compare, "query bigint, vec_id bigint, score double")


class _Block:
    """Vectors of one length and their ids."""

    def __init__(self, table: pa.Table):
        [(_, self.matrix)] = list(_blocks(table.column("v")))
        ids = table.column("ids").combine_chunks()
        self.ids, self.ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        # An id with several vectors may appear more than once.
        self.repeats = len(np.unique(self.ids)) < len(self.ids)

    def answer(self, part: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        asked = part.column("query").to_numpy()
        [(_, queries)] = list(_blocks(part.column("v")))
        wanted = len(self.matrix) if self.repeats else min(k, len(self.matrix))
        names, ids, scores = [], [], []
        for start in range(0, len(queries), STEP):
            some = queries[start : start + STEP]
            rough = squared(some, self.matrix)
            size = (some * some).sum(1)[:, None] + (self.matrix * self.matrix).sum(1).max()
            # As good as the last one wanted, but for rounding; what overflows is looked at.
            bound = np.partition(rough, wanted - 1, axis=1)[:, wanted - 1 : wanted] + 1e-9 * size
            close = ~(rough > bound)
            for row in range(len(some)):
                chosen = np.flatnonzero(close[row])
                exact = distance(some[row], self.matrix[chosen])
                lengths = self.ends[chosen + 1] - self.ends[chosen]
                places = np.repeat(self.ends[chosen] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                own, score = self.ids[places], np.repeat(exact, lengths)
                order = np.lexsort((own, score))
                if self.repeats:
                    order = order[np.sort(np.unique(own[order], return_index=True)[1])]
                order = order[:k]
                names.append(np.full(len(order), asked[start + row]))
                ids.append(own[order])
                scores.append(score[order])
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (names, ids, scores)], ["query", "vec_id", "score"]
            )


def _merged(found: DataFrame, k: int) -> DataFrame:
    """query, hits: the nearest ``k`` of all units, nearest first."""
    best = found.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    kept = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("hits"))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    index: Index | None = None,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest ``k`` other rows found for each query.

    ``queries`` tells by the id (a column named ``id``) which rows are asked for. Distance is
    Euclidean, ties go to the smaller id. A null id, a vector that is null, empty, zero or
    holds null or non-finite components takes no part; an empty table gives no rows. Vectors
    of different lengths have no distance and never meet. Repeated rows count once; an id
    with several vectors is as near as the nearest of them, and its rows are never found for
    itself. Other columns are not read, whatever their names.
    """
    spark = prepare(vectors.sparkSession, ARROW_ROWS)
    rows = valid(vectors, id_col, vector_col)
    if index is None:
        # Drawn by a hash of the vector; at most SAMPLE of them reach the driver.
        drawn = rows.select("v").orderBy(F.xxhash64(F.lit(11), "v")).limit(SAMPLE).collect()
        lengths = [len(r.v) for r in drawn]
        usual = max(set(lengths), key=lambda n: (lengths.count(n), n), default=1)
        sample = np.array([r.v for r in drawn if len(r.v) == usual], dtype=float).reshape(-1, usual)
        index = fit(sample, rows.count(), k)
    wanted = k + 1  # one may be the query itself
    asked = rows.where(queries).distinct()
    asked_classes = written(asked.groupBy("v").agg(F.min("id").alias("query")), "neighbours-queries")
    known = classes(rows, wanted)
    stored, probes = _with_cells(known, index, False), _with_cells(asked_classes, index, True)
    hot = {
        "block": _hot(_with_cells(rows.select("v"), index, False), block, "block", "neighbours-cells"),
        "query_block": _hot(probes, query_block, "query_block", "neighbours-probed"),
    }
    found = _nearest_in_units(
        _dealt(stored, "block", hot, F.col("ids")[0]), _dealt(probes, "query_block", hot, F.col("query")), wanted
    )
    merged = written(_merged(found, wanted), "neighbours-found")
    lacking = asked_classes.join(merged.where(F.size("hits") >= wanted), "query", "left_anti")
    if not lacking.isEmpty():
        # Too few candidates in the probed cells: these queries meet every vector.
        whole = {"table": F.lit(ALL), "cell": F.size("v").cast("long")}
        stored, probes = known.withColumns(whole), written(lacking, "neighbours-lacking").withColumns(whole)
        hot = {
            "block": _hot(rows.withColumns(whole), block, "block", "neighbours-cells"),
            "query_block": _hot(probes, query_block, "query_block", "neighbours-probed"),
        }
        found = _nearest_in_units(
            _dealt(stored, "block", hot, F.col("ids")[0]), _dealt(probes, "query_block", hot, F.col("query")), wanted
        )
        full = _merged(found, wanted)
        merged = merged.join(probes.select("query"), "query", "left_anti").unionByName(full)
    # An id with several vectors asks once for each; the nearest answers count.
    answers = asked.join(asked_classes, "v").join(merged, "query").select("id", F.explode("hits").alias("hit"))
    best = answers.where(F.col("hit.vec_id") != F.col("id")).groupBy("id", F.col("hit.vec_id").alias("vec_id")).agg(
        F.min("hit.score").alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))
    ranked = best.select(F.col("id").alias("query_id"), rank.alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
