from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from footfall.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_same_ids_as_the_library(tokenizer):
    draw = random.Random(6)
    letters = "ab  \n\t\x1c\x85\xa0's'tDlréRÉΣςş日本１²!?.,—\u0327\u0301각İ🙂<|endoftext|>\x00`"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    for text, ids in zip(texts, packing.WordEncoder(PATH).encode_packed(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text


def test_special_strings_as_by_default():
    default = Tokenizer.from_file(PATH)
    draw = random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endof", "text|>"]
    parts += ["A", "bé", "É", "̧", " ", "\n", ".", "!", "'s", "7", "日", "\x85"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(3000)]
    for text, ids in zip(texts, packing.WordEncoder(PATH).encode_packed(texts)):
        want = default.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["The cat, the dog. The end!", "Some other words here"] * 3
    want = packing.WordEncoder(PATH).encode_packed(texts)
    monkeypatch.setattr(packing, "REMEMBERED", 1)
    monkeypatch.setattr(packing, "REMEMBERED_STEMS", 1)
    encoder = packing.WordEncoder(PATH)
    assert [encoder.encode_packed([text])[0] for text in texts] == want


def test_pieces_cover_everything_once(make_docs, tokenizer):
    draw = random.Random(1)
    texts = {k: " ".join(draw.choice("alpha beta gamma delta".split()) for _ in range(draw.randint(0, 40))) for k in range(40)}
    texts |= {100: None, 101: "", 102: "word " * 500}
    docs = make_docs(*texts.items()).repartition(5)
    pieces = packing.pack(docs, PATH, size=64, end_id=2).collect()
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    total = sum(map(len, ids.values()))
    sequences: dict[int, dict[int, int]] = {}
    for doc, whole in ids.items():
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) == len(whole) == own[0].doc_tokens
        for p in own:
            part = np.array(whole[p.start : p.start + p.length], dtype="<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            sequences.setdefault(p.sequence_id, {})[p.offset] = p.length
    assert sorted(sequences) == list(range(-(-total // 64)))
    for number, parts in sequences.items():
        at = 0
        for offset in sorted(parts):
            assert offset == at
            at += parts[offset]
        assert at == (64 if (number + 1) * 64 <= total else total % 64)


def test_repeated_and_missing_ids_and_no_rows(make_docs):
    docs = make_docs((7, "same"), (7, "same"), (None, "other"))
    pieces = packing.pack(docs, PATH, size=4096).collect()
    assert sorted((p.doc_id or -1, p.start, p.sequence_id) for p in pieces) == [(-1, 0, 0), (7, 0, 0), (7, 0, 0)]
    assert len({p.offset for p in pieces}) == 3
    assert packing.pack(make_docs(), PATH).count() == 0


def test_words_of_letters_take_no_call_of_the_library(monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choice("aeinrstéñßöÄÉª") for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    texts = [" ".join(w + draw.choice(["", ",", "$$$", "'s", "!?'", "<|>", "***."]) for w in words[k::30]) for k in range(30)]
    encoder, calls = packing.WordEncoder(PATH), []
    want = [encoder._encode(text).tobytes() for text in texts]
    monkeypatch.setattr(encoder, "_encode", lambda text, encode=encoder._encode: calls.append(text) or encode(text))
    assert encoder.encode_packed(texts) == want
    # Closing marks, and words that do not end with letters and marks only.
    assert all(not c.isalpha() for c in calls) and all("'" in c for c in calls if any(map(str.isalpha, c)))
