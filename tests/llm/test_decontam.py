import random
from itertools import combinations

from braidgraph.llm import decontam

from llm_helpers import prose


def brute(docs, items, seeds=decontam.Seeds()):
    """All diagonals of all pairs, without masks; n_matched is the most tokens that agree in a run of the window."""
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            t = (item or "").lower().split()
            need = len(t) if len(t) < seeds.span else -(-min(len(t), seeds.window) * 7 // 10)
            for k in range(-len(t) + 1, len(w)):
                at = [j for j in range(max(0, -k), min(len(t), len(w) - k)) if w[k + j] == t[j]]
                best = max((sum(x < y + seeds.window for x in at[n:]) for n, y in enumerate(at)), default=0) if len(at) >= need else 0
                if t and best >= need:
                    out[d, i] = max(out.get((d, i), 0), best)
    return {(d, i, n, len(dict(items)[i].split())) for (d, i), n in out.items()}


def test_equals_brute_force_with_substitutions(spark, monkeypatch):
    draw = random.Random(7)
    items = [(i, prose(draw, n, 300)) for i, n in enumerate([16, 25, 40, 59, 10, 9, 3, 1, 12])] + [(20, None), (21, ""), (22, "Same words as another item but not the same words in it"), (23, "same words AS another item but not the same words in it")]
    docs = []
    for d in range(60):
        words = prose(draw, draw.randint(0, 90), 300).split()
        if d % 2:
            passage = (draw.choice(items[:9])[1]).split()
            for _ in range(draw.choice([0, 0, 1, 2, 5, 8])):
                passage[draw.randrange(len(passage))] = "other"
            at = draw.randint(0, len(words))
            words[at:at] = [p.upper() for p in passage]
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "x " + items[10 + 2][1].replace(" ", "\t\n") + " y")]
    frames = [spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' AS words", "'z' AS seed"), spark.createDataFrame(items, "item_id long, text string")]
    want = brute(docs, items)
    assert len(want) > 10
    assert {tuple(r) for r in decontam.find_overlaps(*frames).collect()} == want
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_HITS", 0)
    assert {tuple(r) for r in decontam.find_overlaps(*frames).collect()} == want
    kept = decontam.clean(*frames)
    assert kept.columns == frames[0].columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_documents(spark, small):
    """Documents of up to 300 words against all pairs; longer ones are too slow there."""
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, bench = ([(r[0], r["text"]) for r in t.collect()] for t in (docs, items))
    short = [(d, t) for d, t in texts if len((t or "").split()) <= 300]
    ids = {d for d, _ in short}
    assert {tuple(r) for r in decontam.find_overlaps(docs, items).collect() if r["doc_id"] in ids} == brute(short, bench)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = items.where("false")
    assert decontam.find_overlaps(odd_docs, none).count() == decontam.find_overlaps(no_docs, items).count() == 0
    assert decontam.clean(odd_docs, none).count() == 10
    assert decontam.clean(odd_docs, spark.createDataFrame([(1, "one")], "item_id long, text string")).count() == 9


def test_every_run_that_meets_the_rule_holds_a_mask():
    """All choices of agreeing places, for every length of item up to the window."""
    seeds = decontam.Seeds()
    for n in range(seeds.span, seeds.window + 1):
        placed = [sum(1 << (j + m) for m in mask) for mask in seeds.masks for j in range(n - mask[-1])]
        for agree in combinations(range(n), -(-7 * n // 10)):
            bits = sum(1 << j for j in agree)
            assert any(bits & p == p for p in placed), (n, agree)


def test_no_overlap_is_missed_and_chance_counts_for_nothing(spark):
    """Substitutions at the limit on items of 10 to 60 words, and long items that share eight words and many common ones."""
    draw = random.Random(17)
    common = [f"c{i}" for i in range(20)]

    def text(n, name):
        return [draw.choice(common) if draw.random() < 0.5 else f"{name}{draw.randrange(10**6)}" for _ in range(n)]

    items, docs = [], []
    for n in range(10, 61, 3):
        words, run = text(n, "i"), min(n, 18)
        for _ in range(8):
            at = draw.randint(0, n - run)
            agree = {at + j for j in draw.sample(range(run), -(-7 * run // 10))}
            docs.append((len(docs), " ".join(text(30, "d") + [x if j in agree else f"o{draw.randrange(10**6)}" for j, x in enumerate(words)] + text(30, "e"))))
        items.append((len(items), " ".join(words)))
    near = len(docs)
    for n in (100, 600, 2000):
        words = text(n, "i")
        for _ in range(10):
            at = draw.randint(0, n - 8)
            docs.append((len(docs), " ".join(text(n // 2, "f") + words[at : at + 8] + text(n // 2, "g"))))
        items.append((len(items), " ".join(words)))
    got = {tuple(r) for r in decontam.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {r for r in got if r[0] < near} == brute(docs[:near], items)
    assert {r[0] for r in got} == set(range(near))


def test_null_and_repeated_ids(spark):
    passage = " ".join(f"p{j}" for j in range(15))
    docs = spark.createDataFrame([(None, f"a {passage}", 1), (None, "clean text", 2), (1, "nothing", 3), (1, f"{passage} b", 4), (1, " ".join(f"p{j}" for j in range(13)), 5), (2, None, 6)], "doc_id long, text string, bench_key int")
    items = spark.createDataFrame([(7, passage), (7, passage), (None, passage)], "item_id long, text string")
    assert sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in decontam.find_overlaps(docs, items).collect()) == [("1", "7", 15, 15), ("1", "None", 15, 15), ("None", "7", 15, 15), ("None", "None", 15, 15)]
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["bench_key"] for r in kept.collect()) == [2, 3, 6]
