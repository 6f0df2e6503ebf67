"""Fill-in-the-middle over texts stored as seekable compressed frames.

A text is cut into frames of equal length, each compressed on its own. An index beside them
holds how many units and code points end before each frame. Where a text is to be cut is
found in the index, and only the frame that holds the cut is decompressed for it. Rearranged
texts are then streamed, frame after frame, in the order of the output: nothing whole is
decompressed, however long a text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import prepare, texts_of

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Bytes of a frame before compression, and how hard it is compressed.
FRAME, LEVEL = 1 << 16, 1
# Rows of an Arrow batch.
ROWS = 256

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FIRST = np.ones(256, dtype=bool)  # bytes that begin a code point
_FIRST[0x80:0xC0] = False

FRAME_TYPE = "array<struct<units:bigint,chars:bigint,data:binary>>"
_ARROW = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


def unit_ends(data: bytes | memoryview) -> np.ndarray:
    """Where units end inside a piece of text: after each byte that is not blank and is
    followed by a blank one. The last byte of the piece has no follower yet."""
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    return np.flatnonzero(~blank[:-1] & blank[1:]) + 1


@dataclass(frozen=True)
class Frames:
    """A text as frames; ``units`` and ``chars`` count what ends before each one, with the
    totals of the text at the end."""

    data: list[bytes]
    units: list[int]
    chars: list[int]
    size: int  # bytes of text in every frame but the last

    @classmethod
    def of(cls, text: bytes, size: int = FRAME) -> Frames:
        """A unit is a run of blanks and the run of other characters after it, or the
        blanks at the end of a text. It counts for the frame after which it is complete."""
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        view, data, units, chars = memoryview(text), [], [0], [0]
        for start in range(0, len(view), size):
            piece = view[start : start + size]
            # One more byte tells whether the last one ends a unit.
            ends = len(unit_ends(view[start : start + size + 1]))
            if start + size >= len(view):
                ends += 1  # the text's end
            data.append(pack(piece))
            units.append(units[-1] + ends)
            chars.append(chars[-1] + int(_FIRST[np.frombuffer(piece, dtype=np.uint8)].sum()))
        return cls(data, units, chars, size)

    @property
    def total(self) -> int:
        return self.units[-1]

    def frame(self, number: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[number])

    def cut(self, units: int) -> tuple[int, int]:
        """Where so many units end, in bytes and code points; opens one frame."""
        if units <= 0:
            return 0, 0
        number = int(np.searchsorted(self.units, units)) - 1
        piece = self.frame(number)
        ends = unit_ends(piece)
        place = units - self.units[number] - 1
        # Beyond the ends inside, the unit ends with the frame.
        end = int(ends[place]) if place < len(ends) else len(piece)
        first = _FIRST[np.frombuffer(piece[:end], dtype=np.uint8)].sum()
        return number * self.size + end, self.chars[number] + int(first)

    def stream(self, start: int, stop: int | None = None) -> Iterator[bytes]:
        """The bytes from start to stop, a frame at a time."""
        stop = len(self.data) * self.size if stop is None else stop
        for number in range(start // self.size, min(-(-stop // self.size), len(self.data))):
            base = number * self.size
            yield self.frame(number)[max(start - base, 0) : max(stop - base, 0)]


class FrameWriter:
    """Frames of a stream of bytes."""

    def __init__(self, size: int = FRAME):
        self.size, self.rest, self.data = size, bytearray(), []
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress

    def add(self, piece: bytes) -> None:
        self.rest += piece
        while len(self.rest) >= self.size:
            self.data.append(self.pack(bytes(self.rest[: self.size])))
            del self.rest[: self.size]

    def frames(self) -> Frames:
        if self.rest:
            self.data.append(self.pack(bytes(self.rest)))
            self.rest = bytearray()
        return Frames(self.data, [], [], self.size)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four groups of eight digits of the digest of seed and id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


@dataclass(frozen=True)
class Plan:
    """What becomes of a text: its form and, unless plain, the two cuts in bytes and code
    points."""

    form: str
    cuts: tuple[tuple[int, int], tuple[int, int]] | None = None


def plan(frames: Frames, marked: bool, seed: int, doc_id: int | None, rate: int, spm_rate: int) -> Plan:
    one, two, three, four = draws(seed, doc_id)
    if not frames.total or marked or three % 100 >= rate:
        return Plan("plain")
    ends = sorted((one % (frames.total + 1), two % (frames.total + 1)))
    return Plan("spm" if four % 100 < spm_rate else "psm", (frames.cut(ends[0]), frames.cut(ends[1])))


def has_marks(frames: Frames) -> bool:
    """Whether one of the marks is in the text, also over the border of two frames."""
    before = b""
    for piece in frames.stream(0):
        seen = before + piece
        if PREFIX in seen or SUFFIX in seen or MIDDLE in seen:
            return True
        before = seen[-2:]
    return False


def rearranged(frames: Frames, how: Plan) -> Iterator[bytes]:
    """The output of a text, in order."""
    if how.cuts is None:
        yield from frames.stream(0)
        return
    (one, _), (two, _) = how.cuts
    parts = {PREFIX: (0, one), SUFFIX: (two, None), MIDDLE: (one, two)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if how.form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield mark
        yield from frames.stream(*parts[mark])


def _find(frames: Frames, mark: bytes, start: int) -> int:
    """The first place of a mark from a byte on."""
    before, place = b"", start
    for piece in frames.stream(start):
        seen = before + piece
        found = seen.find(mark)
        if found >= 0:
            return place - len(before) + found
        place += len(piece)
        before = seen[-2:]
    raise ValueError(f"{mark!r} is not in the output")


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output was made of, from output and form alone.

    Parts hold no marks, and no mark begins in a part and ends in another mark, so the
    first place of each mark is where it was put.
    """
    if form == "plain":
        yield from output.stream(0)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    places, at = {}, 0
    for mark in order:
        places[mark] = _find(output, mark, at)
        at = places[mark] + len(mark)
    ends = {mark: places[after] for mark, after in zip(order, order[1:])}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(places[mark] + len(mark), ends.get(mark))


def digest(pieces: Iterable[bytes]) -> str:
    state = hashlib.sha256()
    for piece in pieces:
        state.update(piece)
    return state.hexdigest()


def _list_of(stored: list[Frames]) -> pa.Array:
    rows = [
        [{"units": u, "chars": c, "data": d} for u, c, d in zip(f.units[1:] or [None] * len(f.data), f.chars[1:] or [None] * len(f.data), f.data)]
        for f in stored
    ]
    return pa.array(rows, _ARROW)


def frame_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """doc_id, frames: every text as compressed frames with its index.

    ``units`` and ``chars`` of a frame count to its end. A null text is empty and has no
    frames, repeated rows stay, a null id stays null, an empty table gives no rows. Other
    columns are not read, whatever their names. A text of any length gives one row; only it
    and one frame are in memory beside its compressed frames.
    """
    prepare(docs.sparkSession, ROWS)
    rows = texts_of(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [Frames.of(memoryview(t.as_buffer()), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _list_of(frames)], ["doc_id", "frames"])

    return rows.mapInArrow(stored, f"doc_id bigint, frames {FRAME_TYPE}")


def _read(cell: pa.ListScalar, size: int) -> Frames:
    parts = cell.as_py() or []
    return Frames(
        [p["data"] for p in parts],
        [0, *[p["units"] for p in parts]],
        [0, *[p["chars"] for p in parts]],
        size,
    )


def transform(
    store: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, size: int = FRAME
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: every stored text rearranged.

    A text of n units is cut after two numbers of units drawn from seed and id; ``rate`` of a
    hundred texts are rearranged, ``spm_rate`` of a hundred of these with the suffix first.
    A text that is empty or holds a mark stays plain; then the two lengths are null. ``output``
    is a list of frames again. A null id draws like an empty one. Equal rows give equal rows;
    an empty store gives no rows. ``size`` must be that of the store.
    """
    fields = f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output {FRAME_TYPE}"

    def arranged(frames: Frames, how: Plan) -> dict:
        writer = FrameWriter(size)
        for piece in rearranged(frames, how):
            writer.add(piece)
        return {"output": writer.frames()}

    return _each(store, fields, arranged, seed, rate, spm_rate, size)


def _each(store: DataFrame, fields: str, work: Callable[[Frames, Plan], dict], seed: int, rate: int, spm_rate: int, size: int) -> DataFrame:
    """One row for each stored text: how it is cut, and what ``work`` adds."""
    prepare(store.sparkSession, ROWS)
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result: dict[str, list] = {name: [] for name in names}
            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("frames")):
                frames = _read(cell, size)
                how = plan(frames, has_marks(frames), seed, doc, rate, spm_rate)
                (_, one), (_, two) = how.cuts or ((0, None), (0, None))
                row = {
                    "doc_id": doc,
                    "n": frames.total,
                    "form": how.form,
                    "prefix_chars": one,
                    "middle_chars": None if one is None else two - one,
                    **work(frames, how),
                }
                for name in names:
                    result[name].append(row[name])
            columns = []
            for name in names:
                if name == "output":
                    columns.append(_list_of(result[name]))
                else:
                    columns.append(pa.array(result[name], pa.string() if name in ("form",) or name.endswith("sha256") else pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return store.mapInArrow(rows, fields)


def digests(store: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, size: int = FRAME) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    As ``transform``, but an output is streamed into its digest and into frames, from which
    the text is rebuilt and streamed into the other digest; neither is kept.
    """
    fields = (
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
        "output_sha256 string, restored_sha256 string"
    )

    def work(frames: Frames, how: Plan) -> dict:
        writer, state = FrameWriter(size), hashlib.sha256()
        for piece in rearranged(frames, how):
            state.update(piece)
            writer.add(piece)
        return {"output_sha256": state.hexdigest(), "restored_sha256": digest(restored(writer.frames(), how.form))}

    return _each(store, fields, work, seed, rate, spm_rate, size)
