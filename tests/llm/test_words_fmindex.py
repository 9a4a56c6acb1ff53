import numpy as np
import pyarrow as pa
import pytest

from patternloom.llm import words as W
from patternloom.llm.fmindex import FMIndex, suffix_order

TEXTS = ["", None, "Ab-c 12\x00é", "x" * 70, "É à\tB\n\x0bc", "…a", "A", "ab"]


def test_words_are_those_of_split(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 16)  # words longer than a chunk too
    buf, offsets = W.utf8(pa.array(TEXTS))
    for table in (W.NOT_SPACE, W.WORD_CHARS):
        starts, ends, hashed = W.words(buf, offsets, table)
        want = [w for t in TEXTS for w in W.text_words(t, table)]
        got = [bytes(W.LOWER[buf[a:b]]) for a, b in zip(starts, ends)]
        assert got == want
        assert list(hashed) == list(W.hash_words(want))
    assert [w for t in TEXTS for w in W.text_words(t, W.NOT_SPACE)] == [
        w for t in TEXTS for w in "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    ]


def test_slices_of_an_offset_column():
    column = pa.array(TEXTS).slice(2, 4)
    buf, offsets = W.utf8(column)
    assert bytes(buf) == "".join(TEXTS[2:6]).encode() and offsets[0] == 0
    assert [r for r in W.slices(np.array([0, 3, 3, 10, 11]), 4)] == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("n, k", [(1, 1), (5, 2), (60, 2), (300, 3), (900, 5), (700, 0)])
def test_index_finds_all_occurrences(n, k):
    rng = np.random.default_rng(n)
    text = rng.integers(0, k + 1, n)
    assert list(suffix_order(text)) == sorted(range(n), key=lambda i: tuple(text[i:]))
    index = FMIndex(text, 4)
    patterns, lengths = rng.integers(1, k + 2, (30, 3)), rng.integers(1, 4, 30)
    low, high = index.search(patterns, lengths)
    for p, m, a, b in zip(patterns, lengths, low, high):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n - m + 1) if list(text[i : i + m]) == list(p[:m])]
