"""Words of op9 by batch against words text by text."""

import random

import numpy as np
import pyarrow as pa

from tessella.llm import substrings as S

TEXTS = ["", " lead", "trail \n", None, "a\t\x0bb\x0c\rc", "no\xa0break \x1c sep", "日本 Été a a", "w " * 50, "   "]


def test_words_and_hashes(monkeypatch):
    asked = []
    monkeypatch.setattr(S, "word_hashes", lambda words, plain=S.word_hashes: asked.extend(words) or plain(words))
    text = pa.array(["skipped", *TEXTS])[1:]
    words = S._Words(text)
    one, other = words.hashes()
    assert len(asked) == len(set(asked)) < len(one)  # each different word once
    for i, t in enumerate(TEXTS):
        own, to = S.split_words(t), slice(words.offs[i], words.offs[i + 1])
        assert one[to].tolist() == S.word_hashes(own).tolist() and other[to].tolist() == S.other_hashes(own).tolist()
    some = np.array([3, 1, 9])
    assert words.hashes(some)[0].tolist() == one[some].tolist()
    same = S._wholes(words.offs, one, other)
    assert len(set(map(tuple, same.tolist()))) == len({tuple(S.split_words(t)) for t in TEXTS})


def test_pieces_and_marks(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 12)
    text = pa.array(["x" * 5, "x" * 7, "x", None, "x" * 40, "", "x" * 12, "x"])
    assert list(S._pieces(text)) == [(0, 2), (2, 4), (4, 5), (5, 7), (7, 8)]
    rng = random.Random(1)
    texts = ["w " * n for n in (0, 30, 7, 90)]
    packed = [[(rng.randrange(100) << S.BITS) + rng.randrange(1, 1 << S.BITS) for _ in range(k)] for k in (2, 3, 0, 4)]
    words = S._Words(pa.array(texts))
    got = words.marked(pa.array(packed, pa.list_(pa.int64())), 10)
    for i, p in enumerate(packed):
        n = max(0, int(words.n[i]) - 9)
        own = got[words.offs[i] : words.offs[i + 1]]
        assert own[:n].tolist() == S._marked(p, n).tolist() and not own[n:].any()


def test_minimisers():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 11, 21, 64, 100):
        h = rng.integers(0, 9, 300).astype(np.uint64)
        assert S.minimisers(h, n).tolist() == [i + int(h[i : i + n].argmin()) for i in range(301 - n)]
        assert not len(S.minimisers(h[: n - 1], n))
