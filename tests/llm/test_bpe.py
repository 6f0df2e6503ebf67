from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from footfall.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBPE.from_file(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def test_same_ids_as_the_library(ours, theirs):
    draw = random.Random(4)
    letters = "ab  \n\t\x1c\x85\xa0's'reDéß日本१²!?.—\u0301🙂<|endoftext|>"
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        assert ours.encode(text) == theirs.encode_ordinary(text), text
        assert ours.decode_bytes(ours.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 60_000, "xyz" * 20_000, "日本" * 8_000, " " * 5_000, "aab" * 9_000])
def test_very_long_pre_tokens(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_leftmost_of_equal_ranks_and_ranks_that_fall():
    # "aa" ties with itself; joining b and c gives a smaller rank than its parts had.
    ranks = {bytes([k]): k for k in range(256)} | {b"aa": 300, b"bc": 400, b"abc": 299, b"aaaa": 301}
    own = bpe.ByteBPE(ranks, r"\S+")
    assert own.encode("aaa") == [300, 97]
    assert own.encode("aaaaa") == [301, 97]
    assert own.encode("abcabc") == [299, 299]
    assert own.words == [0] * len(own.words)


def test_forgetting_changes_nothing(ours, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = "one two three four five six one two three"
    first = ours.encode(text)
    assert ours.encode(text) == first and len(ours.known) <= 3


def test_round_trip_of_a_table(make_docs, theirs):
    texts = {1: "Hello world!!", 2: "", 3: None, 4: "é" * 3000, 5: "a\x00b \n\n c"}
    docs = make_docs(*texts.items(), (5, texts[5]), (None, "x"))
    got = bpe.round_trip_digests(docs, PATH, P.PATTERN).collect()
    assert len(got) == 7
    for row in got:
        text = texts.get(row.doc_id, "x") or ""
        ids = np.array(theirs.encode_ordinary(text), dtype="<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_and_decode_tables(make_docs):
    docs = make_docs((1, "Hello, world"), (2, None))
    encoded = bpe.encode_texts(docs, PATH, P.PATTERN)
    decoded = {r.doc_id: bytes(r.bytes) for r in bpe.decode_ids(encoded, PATH, P.PATTERN).collect()}
    assert decoded == {1: b"Hello, world", 2: b""}
    assert bpe.round_trip_digests(make_docs(), PATH, P.PATTERN).count() == 0
