import random

from braidgraph.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, total = set(names), {}, sum(sizes.values())
    while True:
        rest, weight = total - sum(full.values()), sum(w[s] for s in left)
        share = {s: w[s] * rest / weight for s in left}
        over = [s for s in left if share[s] >= most * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = most * sizes[s]
            left.remove(s)
        if not left:
            return full


def test_targets(spark):
    draw = random.Random(4)
    for n in (1, 2, 7, 25):
        sizes = {(f"s{i}" if i else None): draw.choice([0, 1, 10, 1000, 100_000]) for i in range(n)}
        rows = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in got)


def test_mix_comes_near_and_agrees(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.copies(docs)
    taken = {r["source"]: r for r in rows.groupBy("source").agg({"mix_target": "max", "mix_copies": "max"}).collect()}
    words = {r["source"]: r["w"] for r in rows.selectExpr("source", "mix_size * mix_copies AS w").groupBy("source").sum("w").withColumnRenamed("sum(w)", "w").collect()}
    for s, r in taken.items():
        assert abs(words[s] - r["max(mix_target)"]) < 0.05 * r["max(mix_target)"] and r["max(mix_copies)"] <= 3
    first = sorted(map(tuple, mixing.mixed(docs).select("doc_id", "copy_no").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert first == sorted(map(tuple, mixing.mixed(docs.repartition(7)).select("doc_id", "copy_no").collect()))


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.copies(odd_docs).collect()
    assert len(rows) == 10 and all(r["mix_copies"] <= 3 for r in rows)
    assert sum(r["mix_size"] for r in rows) == 60 * 4 + 60_000 + 1
    assert mixing.mixed(odd_docs).where("text IS NOT NULL AND copy_no < 1").count() == 0
    assert mixing.copies(no_docs).count() == mixing.mixed(no_docs).count() == 0
