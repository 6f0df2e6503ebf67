"""Repeated passages: a family of suffix arrays that merge geometrically.

A byte goes when it lies in a string of ``match`` bytes that also starts in a document with
a smaller id. Documents are packed into batches. A batch is searched in two steps, each of
which builds sorted arrays per batch, deals them out by key, and merges the arrays of all
batches like a binary counter: arrays of equal rank are merged, each merge scans equal keys
side by side, reports what a smaller document has too, and keeps one entry per key.

* Sampled suffixes. Each window of ``match`` bytes has an anchor, the leftmost of its
  ``ANCHOR``-byte strings with the least hash, so equal windows have equal anchors. Windows
  that follow each other share anchors, some 14 at a time. The array has one entry per
  anchor, sorted by the anchor, then by all bytes of its windows. An entry that occurs in a
  smaller document is repeated as a whole; one whose anchor occurs nowhere else is unique.
* Suffixes. Only where an anchor occurs in different surroundings is anything undecided:
  there, and for the first document with these surroundings, every window is entered as a
  suffix, sorted by its first eight bytes and then by a digest of the others.

Keys have over 80 bits, so chance does not make strings equal. Copies within a batch are
one entry, so a passage in a third of all documents is one entry per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import prepare, texts_of, written
from footfall.llm.shingles import _BASE, _BYTE, _INVERSE, _powers, mixed

MATCH = 50
ANCHOR = 24
# Text of a batch, and of the stretch whose hashes are held at a time.
BATCH_BYTES = 4 << 20
STRETCH = 1 << 18
# Rows that a Python worker receives at a time; most are packed batches or arrays.
ROWS = 16
# Cells for each shuffle partition.
CELLS = 4
# What a family says of an entry.
UNIQUE, REPEATED, MIXED = 0, 1, 2
# A document without an id counts as the last of all.
NO_ID = np.iinfo(np.int64).max

_SCALES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _scales(count: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(STRETCH + 256, 1 << (count - 1).bit_length())
    if size not in _SCALES:
        _SCALES.clear()
        _SCALES[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return _SCALES[size]


def in_order(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """The order by ``first``, then ``rest``, as np.lexsort gives it. The stable sort only
    merges where ``first`` consists of sorted runs; what follows it decides among equals."""
    order = np.argsort(first, kind="stable")
    key = first[order]
    equal = np.zeros(len(key) + 1, dtype=bool)
    equal[1:-1] = key[1:] == key[:-1]
    tied = np.flatnonzero(equal[1:] | equal[:-1])
    some = order[tied]
    order[tied] = some[np.lexsort([column[some] for column in (*reversed(rest), first)])]
    return order


# Batches of documents ---------------------------------------------------------------


class Batch:
    """Documents in order of their ids, as one buffer."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes):
        self.ids, self.sizes = ids, sizes
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.stops = np.cumsum(sizes)

    @staticmethod
    def pack(ids: list[int | None], texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
        number = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        order = np.argsort(number, kind="stable")
        sizes = np.array([len(texts[k]) for k in order], dtype=np.int64)
        data = zstandard.compress(b"".join([texts[k] for k in order]), 1)
        return number[order].tobytes(), sizes.tobytes(), data

    @classmethod
    def unpack(cls, ids: bytes, sizes: bytes, data: bytes) -> Batch:
        raw = zstandard.decompress(data)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), raw)


def batches_of(rows: DataFrame, batch_bytes: int) -> DataFrame:
    """Rows of doc_id and text packed: batch, ids, sizes, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def packed() -> pa.RecordBatch:
            columns = [[base + number], *[[part] for part in Batch.pack(ids, texts)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["batch", "ids", "sizes", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text.encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= batch_bytes:
                    yield packed()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield packed()

    return rows.mapInArrow(run, "batch long, ids binary, sizes binary, data binary")


# Sampled suffixes -------------------------------------------------------------------


class Anchors:
    """The anchors of a batch, equal ones gathered into entries.

    ``first`` and ``last`` are the window starts of an anchor, ``doc`` its document's place
    in the batch, ``entry`` the number of its entry. Entries are in order of (anchor,
    windows); ``rep`` is an anchor of an entry in its smallest document, ``rep_id`` that
    document's id.
    """

    def __init__(self, batch: Batch, match: int):
        parts = [part for part in self._stretches(batch, match)]
        if parts:
            anchor, windows, self.first, self.last, self.doc = map(np.concatenate, zip(*parts))
        else:
            anchor = windows = np.zeros(0, np.uint64)
            self.first = self.last = self.doc = np.zeros(0, np.int64)
        order = in_order(anchor, windows, self.doc)
        anchor, windows = anchor[order], windows[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1])
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.rep = order[new]
        self.rep_id = batch.ids[self.doc[self.rep]]
        self.keys = anchor[new], windows[new]

    @staticmethod
    def _stretches(batch: Batch, match: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Whole documents up to STRETCH bytes at a time; longer ones in parts that share
        match - 1 bytes, so that each window is in one part."""
        begin, doc = 0, 0
        while doc < len(batch.sizes):
            size = int(batch.sizes[doc])
            if size > STRETCH:
                for x in range(0, size - match + 1, STRETCH):
                    stop = min(size, x + STRETCH + match - 1)
                    yield Anchors._find(batch.data, begin + x, np.array([stop - x]), doc, match)
                begin, doc = begin + size, doc + 1
                continue
            end = int(np.searchsorted(batch.stops, begin + STRETCH, side="right"))
            end = max(doc + 1, min(end, len(batch.sizes)))
            while end > doc + 1 and batch.sizes[end - 1] > STRETCH:
                end -= 1
            yield Anchors._find(batch.data, begin, batch.sizes[doc:end], doc, match)
            begin, doc = int(batch.stops[end - 1]), end

    @staticmethod
    def _find(data: np.ndarray, begin: int, sizes: np.ndarray, doc: int, match: int):
        data = data[begin : begin + int(sizes.sum())]
        n, width = len(data), match - ANCHOR + 1
        empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        if n < match:
            return empty
        power, inverse = _scales(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:], dtype=np.uint64)
        hashes = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n + 1 - ANCHOR])
        # The low bits give way to how far the least hash lies behind a place.
        least, span = hashes & ~np.uint64(63), 1
        while span < width:
            more = min(span, width - span)
            least = np.minimum(least[:-more], least[more:] + np.uint64(more))
            span += more
        starts = np.arange(len(least))
        own = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
        inside = starts + match <= np.cumsum(sizes)[own]
        starts, own = starts[inside], own[inside]
        if not len(starts):
            return empty
        at = starts + (least[starts] & np.uint64(63)).astype(np.int64)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        first, last, at = starts[head], starts[np.append(head[1:], len(starts)) - 1], at[head]
        shape = (at - first).astype(np.uint64) * np.uint64(64) + (last - first).astype(np.uint64)
        windows = mixed((sums[last + match] - sums[first]) * inverse[first] + mixed(shape + np.uint64(1)))
        # The least of many hashes is small; mixed again it is even over all cells.
        return mixed(hashes[at]), windows, first + begin, last + begin, own[head] + doc


# Suffixes of undecided windows --------------------------------------------------------


class Suffixes:
    """The suffixes at the windows of the entries that are MIXED, equal ones gathered.

    ``start`` is a window's place in the batch, ``of`` its suffix's number, ``doc_id`` its
    document's id; suffixes are in order of (cell, first eight bytes, digest), ``rep_id``
    is the smallest id of each.
    """

    def __init__(self, batch: Batch, anchors: Anchors, says: np.ndarray, match: int, cells: int):
        rep = anchors.rep[says == MIXED]
        count = anchors.last[rep] - anchors.first[rep] + 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.start = np.repeat(anchors.first[rep], count) + nth
        self.entry = np.repeat(np.flatnonzero(says == MIXED), count)
        self.doc_id = np.repeat(batch.ids[anchors.doc[rep]], count)
        front, digest = self._words(batch.data, self.start, match)
        cell = cell_of(digest, cells)
        order = np.lexsort((self.doc_id, digest, front, cell))
        front, digest = front[order], digest[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (front[1:] != front[:-1]) | (digest[1:] != digest[:-1])
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.rep_id = self.doc_id[order[new]]
        self.keys, self.cell = (front[new], digest[new]), cell[order[new]]

    @staticmethod
    def _words(data: np.ndarray, starts: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
        front, digest = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        padded = -(-match // 8) * 8
        for k in range(0, len(starts), 100_000):
            some = np.zeros((len(starts[k : k + 100_000]), padded), dtype=np.uint8)
            some[:, :match] = data[starts[k : k + 100_000, None] + np.arange(match)]
            words = some.view(">u8").astype(np.uint64)
            front[k : k + 100_000] = words[:, 0]
            sum_ = np.zeros(len(some), dtype=np.uint64)
            for column in words.T[1:]:
                sum_ = mixed(sum_ * _BASE + column)
            digest[k : k + 100_000] = sum_
        return front, digest


# The family of arrays ------------------------------------------------------------------


def cell_of(key: np.ndarray, cells: int) -> np.ndarray:
    """0 .. cells - 1, growing with the key."""
    return (((key >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)


class Family:
    """Sorted arrays of (key, key, id), merged when two have the same rank.

    A merge drops an entry when the other side or its own has the key with a smaller id,
    and notes that for the batch it came from. Entries with equal ids stay side by side.
    """

    def __init__(self):
        self.levels: list[tuple[int, tuple[np.ndarray, ...]]] = []
        self.says: dict[int, np.ndarray] = {}

    def add(self, batch: int, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> None:
        """A batch's array: keys in order, each once."""
        self.says[batch] = np.zeros(len(one), dtype=np.uint8)
        number = np.full(len(one), batch, dtype=np.int64)
        place = np.arange(len(one), dtype=np.uint32)
        rank, level = 0, (one, two, ids, number, place)
        while self.levels and self.levels[-1][0] == rank:
            level, rank = self._merge(self.levels.pop()[1], level), rank + 1
        self.levels.append((rank, level))

    def _merge(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        both = [np.concatenate(pair) for pair in zip(a, b)]
        order = in_order(*both[:3])
        one, two, ids, number, place = (column[order] for column in both)
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        smallest = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = ids > smallest
        self._say(number[late], place[late], REPEATED)
        return tuple(column[~late] for column in (one, two, ids, number, place))

    def _say(self, number: np.ndarray, place: np.ndarray, what: int) -> None:
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order]
        edges = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
        for start, stop in zip(edges, np.append(edges[1:], len(number)) if len(number) else []):
            self.says[int(number[start])][place[start:stop]] = what

    def close(self) -> dict[int, np.ndarray]:
        """Merges what is left. Entries whose first key others have too are MIXED."""
        while len(self.levels) > 1:
            _, b = self.levels.pop()
            _, a = self.levels.pop()
            self.levels.append((0, self._merge(a, b)))
        if self.levels:
            one, two, _, number, place = self.levels[0][1]
            new = np.ones(len(one), dtype=bool)
            new[1:] = one[1:] != one[:-1]
            other = np.zeros(len(one), dtype=bool)  # not what the entry before it is
            other[1:] = two[1:] != two[:-1]
            group = np.cumsum(new) - 1
            kinds = np.bincount(group, weights=(other & ~new))
            mixed_ = kinds[group] > 0 if len(group) else np.zeros(0, dtype=bool)
            self._say(number[mixed_], place[mixed_], MIXED)
        return self.says


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that they compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> bytes:
    """A sorted array, its keys cut to 64 and 48 bits."""
    steps = np.diff(one, prepend=np.uint64(0))
    short = two >> np.uint64(16)
    return zstandard.compress(_planes(steps) + _planes(short) + _planes(ids), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(3, 8, -1)
    words = [np.ascontiguousarray(part.T).view(np.uint64).ravel() for part in planes]
    return np.cumsum(words[0], dtype=np.uint64), words[1], words[2].view(np.int64)


def _each(rows: pa.RecordBatch) -> Iterator[list]:
    """One row at a time; rows are large."""
    for k in range(rows.num_rows):
        yield [column[k].as_py() for column in rows.columns]


def _slices(cell: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
    for start, stop in zip(edges, np.append(edges[1:], len(cell)) if len(cell) else []):
        yield int(cell[start]), slice(int(start), int(stop))


ARRAYS = "cell int, batch long, entries binary"
SAYS = "cell int, batch long, says binary"


def _rows(cell: np.ndarray, batch: int, keys, ids: np.ndarray) -> pa.RecordBatch:
    cells, blobs = [], []
    for number, part in _slices(cell):
        cells.append(number)
        blobs.append(_pack(keys[0][part], keys[1][part], ids[part]))
    columns = [pa.array(cells, pa.int32()), pa.array([batch] * len(cells), pa.int64()), pa.array(blobs, pa.binary())]
    return pa.record_batch(columns, ["cell", "batch", "entries"])


def _merged(arrays: DataFrame, cells: int) -> DataFrame:
    """What the family of each cell says of every array, by cell and batch."""

    def said(cell: int, family: Family) -> pa.RecordBatch:
        says = family.close()
        blobs = [zstandard.compress(found.tobytes(), 1) for found in says.values()]
        columns = [pa.array([cell] * len(says), pa.int32()), pa.array(list(says), pa.int64()), pa.array(blobs, pa.binary())]
        return pa.record_batch(columns, ["cell", "batch", "says"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, family = None, Family()
        for rows in batches:
            for cell, batch, blob in _each(rows):
                if cell != last and last is not None:
                    yield said(last, family)
                    family = Family()
                last = cell
                family.add(batch, *_unpack(blob))
        if last is not None:
            yield said(last, family)

    dealt = arrays.repartition(cells, "cell").sortWithinPartitions("cell", "batch")
    return dealt.mapInArrow(run, SAYS)


def _gathered(says: DataFrame, name: str) -> DataFrame:
    """One row per batch: what was said of its cells, a byte for each of its entries."""
    rows = F.collect_list(F.struct("cell", "says"))
    return says.groupBy("batch").agg(F.sort_array(rows).getField("says").alias(name))


def _bytes_of(blobs: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(zstandard.decompress(blob) for blob in blobs or []), dtype=np.uint8)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text_sha256 string"

# The operator ---------------------------------------------------------------------------


def _removed(batch: Batch, anchors: Anchors, says: np.ndarray, suffixes: Suffixes, later: np.ndarray, match: int):
    """For each byte of the batch whether it goes."""
    edge = np.zeros(len(batch.data) + 1, dtype=np.int32)
    # A whole entry: repeated elsewhere, or here in a document with a smaller id.
    own = batch.ids[anchors.doc]
    whole = (says[anchors.entry] == REPEATED) | (own > anchors.rep_id[anchors.entry])
    np.add.at(edge, anchors.first[whole], 1)
    np.add.at(edge, anchors.last[whole] + match, -1)
    # Single windows of MIXED entries, in every anchor of the smallest document.
    late = (later[suffixes.of] == REPEATED) | (suffixes.doc_id > suffixes.rep_id[suffixes.of])
    shift = suffixes.start - anchors.first[anchors.rep[suffixes.entry]]
    entry, shift = suffixes.entry[late], shift[late]
    twin = np.flatnonzero((says[anchors.entry] == MIXED) & ~whole)
    twin = twin[np.argsort(anchors.entry[twin], kind="stable")]
    low = np.searchsorted(anchors.entry[twin], entry, side="left")
    count = np.searchsorted(anchors.entry[twin], entry, side="right") - low
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = anchors.first[twin[np.repeat(low, count) + nth]] + np.repeat(shift, count)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + match, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def remove_repeats(
    docs: DataFrame,
    match: int = MATCH,
    batch_bytes: int = BATCH_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes
    that are left), text_sha256 (of the input).

    Texts are UTF-8 bytes, a null one is empty; matches never cross documents. A byte goes
    when it lies in a string of ``match`` bytes (32 to 87) of the input that starts in a
    document with a smaller id, too; overlaps within a document do not count as such.
    ``n_spans`` counts maximal removed runs. Texts shorter than ``match`` stay whole. Rows
    that repeat an id are one document here: nothing of one goes because of another. A row
    without an id counts as the last of all. Other columns are ignored.
    """
    if not 32 <= match <= ANCHOR + 63:
        raise ValueError("match is out of range")
    spark = prepare(docs.sparkSession, ROWS)
    cells = CELLS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = written(batches_of(texts_of(docs, id_col, text_col), batch_bytes), "suffix-batches")

    def sampled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for number, *parts in _each(row):
                anchors = Anchors(Batch.unpack(*parts), match)
                yield _rows(cell_of(anchors.keys[0], cells), number, anchors.keys, anchors.rep_id)

    first = written(_merged(packed.mapInArrow(sampled, ARRAYS), cells), "suffix-anchors")
    judged = packed.join(_gathered(first, "first"), "batch", "left")

    def undecided(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for number, *parts, blobs in _each(row):
                batch, says = Batch.unpack(*parts), _bytes_of(blobs)
                suffixes = Suffixes(batch, Anchors(batch, match), says, match, cells)
                yield _rows(suffixes.cell, number, suffixes.keys, suffixes.rep_id)

    second = written(_merged(judged.mapInArrow(undecided, ARRAYS), cells), "suffix-windows")
    judged = judged.join(_gathered(second, "second"), "batch", "left")

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for _, *parts, one, two in _each(row):
                batch, says = Batch.unpack(*parts), _bytes_of(one)
                anchors = Anchors(batch, match)
                suffixes = Suffixes(batch, anchors, says, match, cells)
                yield from _results(batch, _removed(batch, anchors, says, suffixes, _bytes_of(two), match))

    return judged.mapInArrow(apply, RESULT)


def _results(batch: Batch, gone: np.ndarray, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    begins = batch.stops - batch.sizes
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    full = batch.sizes > 0
    starts[begins[full]] = gone[begins[full]]  # a run ends with its document
    removed, spans = np.zeros((2, len(gone) + 1), dtype=np.int64)
    np.cumsum(gone, out=removed[1:])
    np.cumsum(starts, out=spans[1:])
    raw = batch.data.tobytes()
    for k in range(0, len(batch.ids), rows):
        kept, digests = [], []
        for a, b in zip(begins[k : k + rows].tolist(), batch.stops[k : k + rows].tolist()):
            digests.append(hashlib.sha256(raw[a:b]).hexdigest())
            kept.append(raw[a:b] if removed[a] == removed[b] else batch.data[a:b][~gone[a:b]].tobytes())
        part = slice(k, k + rows)
        of = lambda sums: sums[batch.stops[part]] - sums[begins[part]]
        columns = [
            pa.array([None if i == NO_ID else i for i in batch.ids[part].tolist()], pa.int64()),
            pa.array(batch.sizes[part]),
            pa.array(of(removed)),
            pa.array(of(spans)),
            pa.array(kept, pa.binary()),
            pa.array(digests),
        ]
        yield pa.record_batch(columns, [part.split()[0] for part in RESULT.split(", ")])


def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes in the last column as UTF-8 text; a character that a removed passage cut in
    two goes with it."""
    for batch in batches:
        texts = [data.decode("utf-8", "ignore") for data in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_digest", "_left"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` with all their columns, their text without repeated passages.

    A column n_chars, where there is one, follows the text. Texts from which nothing goes
    stay as they are; a text that goes entirely is left empty. ``parameters`` are those of
    ``remove_repeats``.
    """
    found = remove_repeats(docs, id_col=id_col, text_col=text_col, **parameters)
    # Equal rows have equal results, and one of them is enough for all.
    changed = written(
        found.where("n_removed > 0")
        .dropDuplicates(["doc_id", "text_sha256"])
        .select("doc_id", "text_sha256", "kept")
        .mapInArrow(_as_text, "_id long, _digest string, _left string"),
        "suffix-changed",
    )
    same = docs[id_col].cast("long").eqNullSafe(changed["_id"]) & (
        F.sha2(docs[text_col].cast("string"), 256) == changed["_digest"]
    )
    joined = docs.join(changed, same, "left")
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(F.coalesce(changed["_left"], docs[name]).alias(name))
        elif name == "n_chars":
            size = F.length(changed["_left"]).cast(docs.schema[name].dataType)
            columns.append(F.coalesce(size, docs[name]).alias(name))
        else:
            columns.append(docs[name])
    return joined.select(*columns)
