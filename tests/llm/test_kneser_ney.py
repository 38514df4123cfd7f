import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

from braidgraph.llm import kneser_ney as kn


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Slow:
    def __init__(self, texts):
        self.c, pairs = Counter(), Counter()
        for t in texts:
            self.c.update(t)
            pairs.update(zip(["<s>", *t], t))
        self.pairs, self.n, self.v = pairs, sum(self.c.values()), len(self.c)
        of = lambda q: [sum(1 for x in q.values() if x == k) for k in (1, 2, 3, 4)]
        self.cc = Counter(w for _, w in pairs)
        self.high, self.low = kn.discounts(*of(pairs)), kn.discounts(*of(self.cc))
        self.rest = sum(d * x for d, x in zip(self.low, [*of(self.cc)[:2], sum(1 for x in self.cc.values() if x >= 3)])) / len(pairs) if pairs else 1
        self.total, self.kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for (p, _), k in pairs.items():
            self.total[p] += k
            self.kinds[p][min(k, 3) - 1] += 1

    def word(self, w):
        k = self.cc.get(w, 0)
        return max(k - [0, *self.low][min(k, 3)], 0) / max(1, len(self.pairs)) + self.rest / (self.v + 1)

    def p(self, before, w):
        if before not in self.total:
            return self.word(w)
        k = self.pairs.get((before, w), 0)
        gamma = sum(a * b for a, b in zip(self.high, self.kinds[before])) / self.total[before]
        return max(k - [0, *self.high][min(k, 3)], 0) / self.total[before] + gamma * self.word(w)

    def score(self, t):
        return sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *t], t))

    def base(self, t):
        return sum(math.log10((self.c.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)


def check(docs):
    rows = kn.train_and_score(docs).collect()
    texts = [(r["doc_id"], tokens(r["text"])) for r in docs.collect()]
    in_training = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    slow = Slow([t for i, t in texts if in_training(i)])
    want = sorted((str(i), len(t), sum(w in slow.c for w in t), round(slow.base(t), 5), round(slow.score(t), 5), not in_training(i), slow.n) for i, t in texts)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5), r["held_out"], r["train_tokens"]) for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[5:] == b[5:]
        assert a[3] == pytest.approx(b[3], rel=1e-6, abs=1e-4) and a[4] == pytest.approx(b[4], rel=1e-6, abs=1e-4)
    return rows, slow


def test_equals_brute_force_and_beats_the_base(spark):
    rows, slow = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    for before in ("<s>", "the", "never-seen"):
        assert sum(slow.p(before, w) for w in slow.c) + slow.p(before, "unknown") == pytest.approx(1)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert kn.train_and_score(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows, _ = check(spark.createDataFrame([(held, "a b c")], "doc_id long, text string"))
    assert rows[0]["train_tokens"] == 0


def test_hot_contexts_are_split(spark, monkeypatch):
    monkeypatch.setattr(kn, "HOT_SHARE", 50)
    monkeypatch.setattr(kn, "GATHERED", 500)
    docs = spark.createDataFrame([(i, " ".join(f"the w{(i * 7 + j) % 97}" for j in range(50))) for i in range(60)], "doc_id long, text string")
    model = kn.train(docs.select("text"))
    assert len(model["hot"]) > 3
    check(docs)


def test_buckets_follow_the_size_of_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"v{(i * 13 + j * j) % 211}" for j in range(80))) for i in range(80)], "doc_id long, text string")
    monkeypatch.setattr(kn, "BUCKET_BYTES", 1000)
    model = kn.train(docs.select("text"))
    assert model["buckets"] > 20 and len(model["sizes"]) == model["buckets"]
    check(docs)
    assert os.listdir(model["folder"])
    kn.delete_model(spark, model)
    assert not os.path.exists(model["folder"])
