"""Packing by concatenating and cutting.

All documents' token ids form one row of tokens, cut every ``size``; only the last
sequence needs padding. The place of a document in that row comes from two passes of
prefix sums: each partition numbers its own tokens while it encodes, and a prefix sum over
the partitions' totals, one number each, gives where a partition begins. A document that a
cut falls into leaves one record per piece.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import prepare, texts_of, written

# Short words whose ids a worker remembers, twice as many at most: when full, those that
# were not met since the last time are forgotten. Stems are forgotten all at once.
REMEMBERED, SHORT = 700_000, 64
REMEMBERED_STEMS = 300_000
# Characters besides the blank that end a word for every step of the tokenizer, and that no
# step joins to what stands beside them: what lies between two of them is encoded by itself.
BLANKS = "\t\n\r\x0b\x0c"
# Marks that the tokenizer keeps apart from a letter before them, together.
CLOSING = string.punctuation
# The last character of which lower case and composed form are taken as known.
LATIN = "\u00ff"
# How the vocabulary marks a token that ends a word.
WORD_END = "</w>"
# Words that are encoded together, texts that are handed over, and texts whose words are
# looked up together: few, so that what was found is still near when they are joined.
TOGETHER = 1000
TEXTS = 100
NEAR = 10

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _letters_only(part: str) -> bool:
    """Whether it is so for the tokenizer, after its normalizing and lower-casing."""
    if part.isascii():
        return part.isalpha()
    return part.isalpha() and unicodedata.is_normalized("NFC", part) and part.lower().isalpha()


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never looks across it, so each word is encoded
    once and remembered; so is its stem, without closing marks and in lower case, which
    is what the tokenizer makes of it anyway. A word with the string of a special token in
    it, in whatever case, is encoded as it is: the library gives that token's id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # The library looks for their strings in the text as it was before lower-casing.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)
        self.lettered = any(map(str.isalpha, special))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.model = self.tokenizer.model
        self.packed = [number.to_bytes(4, "little") for number in range(len(self.ends))]
        # Bytes as the model writes them.
        shown = sorted(ByteLevel.alphabet())  # a byte's own character, or one above them
        moved = sorted(set(range(256)).difference(map(ord, shown)))
        self.symbols = dict(zip(moved, shown[256 - len(moved) :]))
        self.known: dict[str, bytes] = {"": b""}
        self.aged: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _direct(self, part: str) -> bytes:
        """By the merges alone: letters up to U+00FF are one word, whatever the steps before."""
        if part.isascii():
            symbols = part.lower()
        else:
            symbols = part.lower().encode().decode("latin-1").translate(self.symbols)
        return b"".join([self.packed[token.id] for token in self.model.tokenize(symbols)])

    def _learn_stems(self, parts: set[str]) -> None:
        """Words of letters only are single words for the tokenizer, too. Its model takes those
        of the first letters of Unicode as they are; of others, each ends with the one token
        that is marked so, and many are encoded together. What is left goes one by one."""
        stems = self.stems
        plain = [part for part in parts if _letters_only(part)]
        others = []
        for part in plain:
            if part.isascii() or max(part) <= LATIN:
                stems[part] = self._direct(part)
            else:
                others.append(part)
        for k in range(0, len(others), TOGETHER):
            some = others[k : k + TOGETHER]
            ids = self._encode(" ".join(some))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the vocabulary does not mark the ends of words")
            packed, start = ids.tobytes(), 0
            for part, stop in zip(some, (4 * stops).tolist()):
                stems[part] = packed[start:stop]
                start = stop
        for part in parts.difference(plain):
            stems[part] = self._encode(part).tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that are not known; short ones are from now on."""
        aged = self.aged
        found = {word: aged[word] for word in words if word in aged}
        parts: dict[str, tuple[str, str]] = {}
        direct = self._direct
        for word in words.difference(found):
            if word.isalpha() and (word.isascii() or max(word) <= LATIN) and not self.lettered:
                found[word] = direct(word)  # seldom met as a stem again: not worth the memory
                continue
            stem = word.rstrip(CLOSING)
            last = stem[-1:]
            if not last.isascii():
                # A letter for the tokenizer: some decompose into a letter and a mark.
                last = unicodedata.normalize("NFC", last).lower()[-1:]
            tail = word[len(stem) :] if last.isalpha() else ""
            stem = stem if last.isalpha() else word
            if self.special.search(word):
                parts[word] = word, ""
            else:
                parts[word] = (stem.lower() if stem.isascii() else stem), tail
        stems = self.stems
        self._learn_stems({part for pair in parts.values() for part in pair if part and part not in stems})
        stems[""] = b""
        for word, (stem, tail) in parts.items():
            found[word] = stems[stem] + stems[tail]
        if len(self.known) > REMEMBERED:
            self.known, self.aged = {"": b""}, self.known
        if len(stems) > REMEMBERED_STEMS:
            self.stems = {}
        self.known.update(found if max(map(len, found)) <= SHORT else {w: i for w, i in found.items() if len(w) <= SHORT})
        return found

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        return [ids for k in range(0, len(texts), NEAR) for ids in self._encode_near(texts[k : k + NEAR])]

    def _encode_near(self, texts: list[str]) -> list[bytes]:
        rows = []
        for text in texts:
            for blank in BLANKS:
                text = text.replace(blank, " ")
            rows.append(text.split(" "))
        # What is remembered is large and slow to look into: once for each different word.
        words = list(set().union(*rows))
        found = dict(zip(words, map(self.known.get, words)))
        missing = {word for word, ids in found.items() if ids is None}
        if missing:
            found.update(self._learn(missing))
        ids = found.__getitem__
        return [b"".join(map(ids, row)) for row in rows]


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    """The tokenizer, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def token_rows(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, part, before, n_tokens, ids: the ids with ``end_id`` after them, and how
    many tokens the same partition holds before them."""
    prepare(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = loaded(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [
                ids + end
                for k in range(0, len(texts), TEXTS)
                for ids in encoder.encode_packed(texts[k : k + TEXTS])
            ]
            sizes = np.array([len(ids) // 4 for ids in rows], dtype=np.int64)
            before = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            columns = [
                batch.column(0),
                pa.array(np.full(len(rows), part, dtype=np.int32)),
                pa.array(before),
                pa.array(sizes),
                pa.array(rows, pa.binary()),
            ]
            yield pa.record_batch(columns, ["doc_id", "part", "before", "n_tokens", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, part int, before long, n_tokens long, ids binary"
    )


def with_positions(rows: DataFrame) -> DataFrame:
    """Adds ``position``, the number of tokens of all documents before this one.

    The window runs over one row per partition; the join's other side is that small.
    """
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part", F.coalesce(F.sum("total").over(earlier), F.lit(0).cast("long")).alias("base")
    )
    bases = written(bases, "packing-bases")
    return rows.join(bases, "part").withColumn("position", F.col("base") + F.col("before"))


def cut(rows: DataFrame, size: int) -> DataFrame:
    """Pieces of rows with doc_id, position, n_tokens and ids; see ``pack``."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, positions, tokens, ids = (batch.column(k) for k in range(4))
            position, count = positions.to_numpy(), tokens.to_numpy()
            pieces = (position + count - 1) // size - position // size + 1
            row = np.repeat(np.arange(len(count)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = position[row] // size + nth
            begin = np.maximum(position[row], sequence * size)
            stop = np.minimum((position + count)[row], (sequence + 1) * size)
            start = begin - position[row]
            length = stop - begin
            packed = ids.to_pylist()
            sums = [
                zlib.crc32(memoryview(packed[r])[4 * a : 4 * (a + n)])
                for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())
            ]
            columns = [docs.take(pa.array(row))] + [
                pa.array(np.asarray(values, dtype=np.int64))
                for values in (start, length, sums, count[row], sequence, begin - sequence * size)
            ]
            names = [part.split()[0] for part in PIECES.split(", ")]
            yield pa.record_batch(columns, names)

    return rows.select("doc_id", "position", "n_tokens", "ids").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame,
    path: str,
    size: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: doc_id, start (the document's ids before it),
    length, ids_crc32, doc_tokens, sequence_id, offset in the sequence.

    Sequences hold ``size`` tokens without gaps, the last one what is left. A null or
    empty text is its end id alone. Rows that repeat an id, or have none, are packed each.
    Documents keep the order of the table's partitions. No rows give no pieces. Other
    columns are ignored. The ids are written once to the shared folder, with the
    partition's number beside them, so that the second pass does not depend on how a
    second scan would be divided.
    """
    rows = written(token_rows(docs, path, end_id, id_col, text_col), "token-ids")
    return cut(with_positions(rows), size)
