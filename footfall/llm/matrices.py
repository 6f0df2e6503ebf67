"""Token matrices: best-fit-decreasing packing with a segment tree over free space.

Every document's ids are cut into pieces of at most ``size`` (whole rows first, then what is
left), so nothing of an overlong document is lost. Pieces are packed longest first, each
into the open row with the least free space that holds it; a segment tree over the amounts
of free space finds that amount in steps of its depth. A row of the result is a row of the
matrix, with the cumulative lengths of its segments and the places where positions restart.

Tasks pack groups of some two million tokens of their own, so that memory is bounded and
no document moves; the last rows of a group are the only ones that stay emptier.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from footfall.llm import packing
from footfall.llm.common import prepare, texts_of

# Tokens that are packed together.
GROUP_TOKENS = 1 << 21

MATRIX = (
    "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, "
    "cu_seqlens array<int>, position_resets array<int>, ids binary"
)


class FreeSpace:
    """Open rows by free space, 0 .. size; a tree over the amounts says where rows are."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.rows_below = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def _count(self, space: int, change: int) -> None:
        node = space + self.leaves
        while node:
            self.rows_below[node] += change
            node >>= 1

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._count(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, row) of the least space that is at least ``need``; None without any."""
        below, node = self.rows_below, need + self.leaves
        if not below[node]:
            # Up to the first ancestor with rows to the right, then down to its left.
            while node > 1 and (node & 1 or not below[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not below[node]:
                    node += 1
        space = node - self.leaves
        self._count(space, -1)
        return space, self.rows[space].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Pieces by row; each piece is at most ``size`` long. Equal lengths keep their order."""
    rows: list[list[int]] = []
    free = FreeSpace(size)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = free.take(need)
        if found is None:
            found = size, len(rows)
            rows.append([])
        space, row = found
        rows[row].append(piece)
        if space > need:
            free.put(space - need, row)
    return rows


def cut(ids: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces of a document."""
    return [(start, ids[start : start + size]) for start in range(0, len(ids), size)]


def pack_matrices(
    docs: DataFrame,
    path: str,
    size: int = 4096,
    end_id: int = 2,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per sequence.

    ``ids`` are ``size`` little-endian unsigned 32-bit integers, ``pad_id`` behind the first
    ``n_tokens``. Segment k of a row holds the ids cu_seqlens[k] .. cu_seqlens[k + 1] of
    document doc_ids[k] from its token starts[k] on; positions restart at each of
    position_resets, so they count from 0 in every segment. Each document ends with
    ``end_id``; a null or empty text is that alone. Rows that repeat an id, or have none, are
    packed each. No rows give no sequences. ``sequence_id`` is unique: the task's number
    above, the row's below. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def packed(pieces: list[tuple[int | None, int, np.ndarray]], first: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(7)]
        lengths = np.array([len(ids) for _, _, ids in pieces], dtype=np.int64)
        for number, row in enumerate(best_fit_decreasing(lengths, size)):
            matrix = np.full(size, pad_id, dtype="<u4")
            bounds = np.concatenate(([0], np.cumsum(lengths[row])))
            matrix[: bounds[-1]] = np.concatenate([pieces[k][2] for k in row])
            values = (
                first + number,
                int(bounds[-1]),
                [pieces[k][0] for k in row],
                [pieces[k][1] for k in row],
                bounds.tolist(),
                bounds[:-1].tolist(),
                matrix.tobytes(),
            )
            for column, value in zip(columns, values):
                column.append(value)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int32(), longs, longs, ints, ints, pa.binary()]
        names = [part.split()[0] for part in MATRIX.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, next_id = packing.loaded(path), TaskContext.get().partitionId() << 32
        pieces, held = [], 0
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(texts), packing.TEXTS):
                encoded = encoder.encode_packed(texts[k : k + packing.TEXTS])
                for doc, blob in zip(docs[k : k + packing.TEXTS], encoded):
                    ids = np.frombuffer(blob + end, dtype="<u4")
                    pieces += [(doc, start, part) for start, part in cut(ids, size)]
                    held += len(ids)
                if held >= GROUP_TOKENS:
                    result = packed(pieces, next_id)
                    next_id, pieces, held = next_id + result.num_rows, [], 0
                    yield result
        if pieces:
            yield packed(pieces, next_id)

    return texts_of(docs, id_col, text_col).mapInArrow(run, MATRIX)


def write_matrices(sequences: DataFrame, folder: str) -> None:
    """The sequences as Parquet files: a file's ids, one below the other, are a matrix."""
    sequences.write.parquet(folder)
