from __future__ import annotations

import hashlib
import random
import re

import pytest

from footfall.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc, text, seed=42, rate=50, spm_rate=80):
    """(n, form, prefix characters, middle characters, output) as told."""
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    draw = random.Random(3)
    letters = "ab <PSM>\n\t é漢😀 \u0085"
    rows = [(k, "".join(draw.choice(letters) for _ in range(draw.randrange(90)))) for k in range(300)]
    rows += [(k, draw.choice(["", " ", "\n\n", "word", " word", "word ", "<P>", "a <M> b", "<P", "P>", "<S"])) for k in range(300, 360)]
    rows += [(360, None), (None, "no id at all, but words"), (7, rows[7][1]), (-5, "minus five is an id")]
    # Longer than many frames: one word, only blanks, and much of both.
    rows += [(400, "x" * 300_000), (401, " " * 200_000), (402, "漢字 " * 60_000), (403, "<" * 150_000)]
    return rows


@pytest.mark.parametrize("size", [5, 64, 1 << 16])
def test_against_brute_force(make_docs, rows_of, size):
    rows = [r for r in texts() if size > 5 or len(r[1] or "") < 1000]
    store = fill_middle.frame_store(make_docs(*rows), size=size)
    got = rows_of(fill_middle.digests(store, size=size, rate=80))
    want = []
    for doc, text in rows:
        n, form, prefix, middle, output = expected(doc, text, rate=80)
        want.append((doc, n, form, prefix, middle, sha(output), sha(text or "")))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_outputs_are_frames_again(make_docs):
    rows = texts()
    store = fill_middle.frame_store(make_docs(*rows), size=64)
    for r in fill_middle.transform(store, size=64).collect():
        frames = fill_middle.Frames([f.data for f in r.output], [], [], 64)
        output = b"".join(frames.stream(0)).decode()
        assert output in {expected(doc, text)[4] for doc, text in rows if doc == r.doc_id}
        assert b"".join(fill_middle.restored(frames, r.form)).decode() in {text or "" for doc, text in rows if doc == r.doc_id}


def test_a_cut_opens_one_frame():
    text = ("some words of a long text " * 5000).encode()
    frames = fill_middle.Frames.of(text, 1000)
    opened = []

    class Counted(fill_middle.Frames):
        def frame(self, number):
            opened.append(number)
            return super().frame(number)

    counted = Counted(frames.data, frames.units, frames.chars, frames.size)
    units = UNIT.findall(text.decode())
    for k in (0, 1, 77, 12345, len(units) - 1, len(units)):
        opened.clear()
        assert counted.cut(k) == (len("".join(units[:k])),) * 2 and len(opened) <= 1
    # A part reads its own frames only.
    opened.clear()
    assert b"".join(counted.stream(4500, 6200)) == text[4500:6200] and opened == [4, 5, 6]


def test_blanks_at_borders():
    for text in ("a b", "a ", " a", "ab cd  ", "  ", "é é", "a\x85b c", ""):
        for size in (1, 2, 3, 10):
            frames = fill_middle.Frames.of(text.encode(), size)
            units = UNIT.findall(text)
            assert frames.total == len(units)
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert frames.cut(k) == (len(before.encode()), len(before))


def test_empty_table(make_docs):
    store = fill_middle.frame_store(make_docs())
    assert fill_middle.digests(store).count() == 0 and fill_middle.transform(store).count() == 0
