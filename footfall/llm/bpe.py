"""Byte-level BPE: encoding with a queue of merge ranks, and decoding.

Merges of one pre-token are taken from a queue that is a bitmap over all ranks, with a
second bitmap over the words of the first: the lowest set bit of the upper one and then of
the word it points to is the smallest rank with work.
Every rank has a bucket of places in a linked list of tokens; places that a neighbour's
merge has overtaken are skipped when they come up. A merge costs the same however long
the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from footfall.llm.common import prepare, texts_of

# A word of the lower bitmap has 2^8 bits, so that the upper one is a single word of
# some 200 bits for 50,000 ranks; it widens with the vocabulary.
BITS = 8
MASK = (1 << BITS) - 1
# Short pre-tokens whose ids a worker remembers, twice as many at most: when full, those
# that were not met since the last time are forgotten.
REMEMBERED, SHORT = 800_000, 48
# Tokens that are decoded at a time.
TOGETHER = 1 << 16
# A pattern whose pieces hold no white space but a blank they begin with, or nothing else:
# each word with the blank before it can be looked up before it is cut any further.
BLANK_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space as Unicode has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class ByteBPE:
    """A vocabulary of byte strings with ranks, and the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # White space as Unicode defines it; the module's own class differs by engine.
        self.pattern = regex.compile(pattern)
        words = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        self.chunks = re.compile(words) if pattern == BLANK_FIRST else self.pattern
        self.words = [0] * ((max(ranks.values()) >> BITS) + 1)
        self.packed_of = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}
        self.known: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        # All tokens' bytes in a row, where each begins, and how long it is.
        self.lengths, self.starts = np.zeros((2, max(ranks.values()) + 1), dtype=np.int64)
        tokens = sorted(ranks, key=ranks.get)
        known_ranks = [ranks[token] for token in tokens]
        self.lengths[known_ranks] = [len(token) for token in tokens]
        self.starts[known_ranks] = np.cumsum(self.lengths[known_ranks]) - self.lengths[known_ranks]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        """Reads lines of ``base64-token rank``."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        ``words`` and ``top`` are the two bitmaps, ``buckets`` the places by rank, the
        leftmost first. All are empty again at the end.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        end, words, top = len(piece), self.words, 0
        buckets: dict[int, list[int]] = {}
        after = list(range(1, end + 2))  # where the token at a place ends
        before = list(range(-1, end))
        pair = [-1] * (end + 1)  # rank of the token at a place joined with its neighbour
        for place in range(end - 1):
            rank = get(piece[place : place + 2])
            if rank is not None:
                pair[place] = rank
                if rank in buckets:
                    buckets[rank].append(place)
                else:
                    buckets[rank] = [place]
                    words[rank >> BITS] |= 1 << (rank & MASK)
                    top |= 1 << (rank >> BITS)
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            rank = (at << BITS) | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                place = heapq.heappop(bucket)
            else:
                place = bucket[0]
                del buckets[rank]
                words[at] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[place] != rank:
                continue  # stale
            gone = after[place]
            after[place] = stop = after[gone]
            pair[gone] = -1
            if stop < end:
                before[stop] = place
            for left in (before[place], place) if place else (0,):
                middle = after[left]
                joined = get(piece[left : after[middle]]) if middle < end else None
                if joined is None:
                    pair[left] = -1
                    continue
                pair[left] = joined
                if joined in buckets:
                    heapq.heappush(buckets[joined], left)
                else:
                    buckets[joined] = [left]
                    words[joined >> BITS] |= 1 << (joined & MASK)
                    top |= 1 << (joined >> BITS)
        ids, place = [], 0
        while place < end:
            ids.append(self.ranks[piece[place : after[place]]])
            place = after[place]
        return ids

    def packed(self, chunk: str) -> bytes:
        """The ids of a chunk that is not known as little-endian unsigned 32-bit integers."""
        packed = self.aged.get(chunk)
        if packed is None:
            pieces = self.pattern.findall(chunk)
            if len(pieces) > 1:
                known = self.known
                packed = b"".join([known.get(piece) or self.packed(piece) for piece in pieces])
            else:
                ids = self.merge(chunk.encode("utf-8", "surrogatepass"))
                packed = b"".join(map(self.packed_of.__getitem__, ids))
        if len(chunk) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known, self.aged = {}, self.known
            self.known[chunk] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        known, packed = self.known.get, self.packed
        return b"".join([known(chunk) or packed(chunk) for chunk in self.chunks.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_parts(self, packed: bytes) -> Iterator[bytes]:
        """The bytes of packed ids, some tokens at a time."""
        every = np.frombuffer(packed, dtype="<u4")
        for k in range(0, len(every), TOGETHER):
            ids = every[k : k + TOGETHER]
            lengths = self.lengths[ids]
            if not lengths.all():
                raise KeyError("an id that the vocabulary does not have")
            shift = self.starts[ids] - np.cumsum(lengths) + lengths
            yield self.flat[np.arange(lengths.sum()) + np.repeat(shift, lengths)].tobytes()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(self.decode_parts(np.array(ids, dtype="<u4").tobytes()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """The vocabulary, read once per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.from_file(path, pattern)
    return _LOADED[path, pattern]


def encode_texts(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int).

    Null and empty texts have no ids. Rows are independent, so ties, repeated and null
    ids need no rule; other columns are ignored. ``path`` is read by each worker.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode_packed(t), dtype="<u4") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows of doc_id, ids; null ids decode to nothing."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = [bpe.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both.

    Columns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers)
    and decoded_sha256. Rows as in ``encode_texts``; encoding and decoding share a task,
    so ids travel nowhere.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                packed = bpe.encode_packed(text)
                counts.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                decoded = hashlib.sha256()
                for part in bpe.decode_parts(packed):
                    decoded.update(part)
                of_bytes.append(decoded.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
