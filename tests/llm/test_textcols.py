import random

import numpy as np
import pyarrow as pa

from braidgraph.llm import textcols as t

TEXTS = ["a bb ccc é", None, "", "x" * 70_000 + " " + "y" * 70_000, " z ", "w1 w2 w3 " * 2000, "x" * 70_000, "\x1cq\x0br"]


def test_hashes_depend_on_nothing_but_the_range(monkeypatch):
    _, data, offsets = next(t.blocks(pa.array(TEXTS), 1 << 40))
    starts, ends, rows = t.words(data, offsets)
    whole = t.hashes(data, starts, ends)
    alone = [t.hashes(data, starts[i : i + 1], ends[i : i + 1])[0] for i in range(20)]
    assert whole[:20].tolist() == alone
    monkeypatch.setattr(t, "HASHED_BYTES", 1000)
    assert (t.hashes(data, starts, ends) == whole).all()
    text = data.tobytes()
    held = {}
    for s, e, h in zip(starts, ends, whole, strict=True):
        assert held.setdefault(text[s:e], h) == h
    assert len(set(held.values())) == len(held)


def test_words_and_counts():
    import re

    draw = random.Random(2)
    texts = TEXTS + ["".join(draw.choice("ab \n\té\x0b") for _ in range(draw.randint(0, 30))) for _ in range(300)]
    for limit in (1, 50, 1 << 40):
        got, ink = [], []
        for at, data, offsets in t.blocks(pa.array(texts), limit):
            starts, ends, rows = t.words(data, offsets)
            got += [(at + r, data[s:e].tobytes().decode()) for s, e, r in zip(starts, ends, rows, strict=True)]
            ink += t.count_true(~t.IS_SPACE[data], offsets).tolist()
        assert got == [(i, w) for i, x in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")]
        assert ink == [sum(len(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in texts]


def test_windows():
    hashed, rows = np.arange(10, dtype=np.uint64), np.array([0] * 4 + [1] * 2 + [2] * 4)
    key, at = t.windows(hashed, rows, 3)
    assert at.tolist() == [0, 1, 6, 7] and len(set(key.tolist())) == 4
    assert len(t.windows(hashed[:2], rows[:2], 3)[0]) == 0
