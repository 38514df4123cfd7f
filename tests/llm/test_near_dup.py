import glob
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from braidgraph.llm import near_dup, storage
from braidgraph.llm.components import components
from braidgraph.llm.darts import shingles, signatures, similarity
from braidgraph.llm.textcols import blocks

from llm_helpers import prose


def bags(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs):
    """class_id by comparing all pairs that share a run of words."""
    sets, parent = [bags(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for k in s:
            where.setdefault(k, []).append(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r[0]: r[1] for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies whose likeness to each other is about 0.8: most links go through few members."""
    draw = random.Random(9)
    origin = prose(draw, 120).split()
    docs = []
    for i in range(150):
        words = list(origin)
        for _ in range(draw.choice([1, 2, 3])):
            words[draw.randrange(len(words))] = f"z{draw.random()}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(i, prose(draw, 80)) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert {r[0]: r[1] for r in near_dup.near_duplicates(frame).collect()} == want
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0)  # all joins by shuffle
    small = near_dup.Plan(block=16)
    assert {r[0]: r[1] for r in near_dup.near_duplicates(frame, plan=small).collect()} == want


def test_odd_rows(odd_docs, no_docs):
    got = sorted(((r[0], r[1]) for r in near_dup.near_duplicates(odd_docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 2), (3, 3), (None, 1), (4, 4), (5, 5), (6, 6), (7, 1), (8, 8)], key=str)
    assert near_dup.near_duplicates(no_docs).count() == 0
    kept = near_dup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 4, 5, 6, 8], key=str)
    assert near_dup.deduplicated(no_docs).count() == 0


def test_signatures_estimate_weighted_jaccard():
    draw = random.Random(1)
    a, b = [], []
    for _ in range(200):
        x = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(30, 300))] * draw.choice([1, 1, 3])
        y = list(x)
        for _ in range(int(len(y) * draw.choice([0.01, 0.03, 0.1]))):
            y[draw.randrange(len(y))] = f"z{draw.random()}"
        a.append(" ".join(x))
        b.append(" ".join(y))
    (_, da, oa), (_, db, ob) = (next(blocks(pa.array(x), 1 << 40)) for x in (a, b))
    true = similarity(da, oa, db, ob)
    for i in range(0, 200, 20):
        s, t = bags(a[i]), bags(b[i])
        assert true[i] == pytest.approx(sum((s & t).values()) / sum((s | t).values()))
    agree = (signatures(*shingles(da, oa), 200, 144) == signatures(*shingles(db, ob), 200, 144)).mean(axis=1)
    assert abs((agree - true).mean()) < 0.01 and (agree - true).std() < 0.05


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_blocks_agree_with_one_block():
    texts = pa.array(["a b c d e f", None, "", "x y", "a b c d e f", "long " * 5000])
    whole = next(blocks(texts, 1 << 40))
    n = len(whole[2]) - 1
    one = signatures(*shingles(whole[1], whole[2]), n, 12)
    many = np.concatenate([signatures(*shingles(d, o), len(o) - 1, 12) for _, d, o in blocks(texts, 4)])
    assert (one == many).all() and not one[1].any() and (one[0] == one[4]).all()


def test_a_bucket_of_unlike_texts_sends_no_texts(spark):
    """Members that share a bucket but no likely partner are told apart by signature; no text leaves its table."""
    plan = near_dup.Plan(block=8)
    draw = np.random.Generator(np.random.PCG64(3))
    sigs = spark.createDataFrame([(bytes([i, 1]), draw.integers(0, 2**32, plan.bands * plan.rows, dtype=np.uint32).tobytes()) for i in range(60)], "node binary, sig binary")
    members = sigs.selectExpr("7L AS bucket", "node")
    labels = spark.createDataFrame([], "node binary, label binary")

    def texts_of(some):
        raise AssertionError("texts are asked for")

    assert near_dup._rest(members, labels, sigs, texts_of, plan).count() == 0


def test_small_tables_are_few_files(spark, monkeypatch):
    """With 40 shuffle partitions that nothing merges, tables of few rows are not 40 files each; but for block pairs no
    table is written through Hadoop, which starts programs for each file and leaves check sums."""
    draw = random.Random(4)
    docs = []
    for i in range(40):
        base = prose(draw, 60).split()
        docs += [(10 * i + j, " ".join([*base[:j], f"z{draw.random()}", *base[j + 1 :]])) for j in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    files: dict[str, list[int]] = {}

    sums: set[str] = set()

    def counted(write):
        def run(df, name, *more):
            out = write(df, name, *more)
            files.setdefault(name, []).append(len(out.inputFiles()))
            if glob.glob(f"{storage._local(out.braid_path)}/.*.crc"):
                sums.add(name)
            return out

        return run

    for module in (near_dup, sys.modules[components.__module__]):
        for name in {"written", "stored"} & set(vars(module)):
            monkeypatch.setattr(module, name, counted(getattr(storage, name)))
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = {r[0]: r[1] for r in near_dup.near_duplicates(frame).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(docs)
    files.pop("dup-rows"), files.pop("dup-members")  # as many as the input's, or the nodes', partitions
    assert {"dup-nodes", "dup-likely", "dup-links", "cc-links", "cc-least", "dup-classes"} <= set(files)
    assert {k: v for k, v in files.items() if max(v) > 4} == {}
    assert sums <= {"dup-able", "dup-rest"}


def test_null_ids_have_near_copies(spark):
    draw = random.Random(6)
    base = prose(draw, 100)
    rows = [(None, base), (None, base + " end"), (5, "first " + base), (9, base + " x y"), (None, "alone " * 9)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted([(None, 5), (None, 5), (5, 5), (9, 5), (None, None)], key=str)
