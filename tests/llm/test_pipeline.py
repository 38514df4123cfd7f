import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from compare import assert_equal

from braidgraph.llm import pii, registry

from test_decontam import brute as overlaps
from test_mixing import slow_targets
from test_near_dup import brute as classes
from test_quality import brute_kept


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "pii", "mixing"]
    table, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in table.collect()}
        table = stage(spark, table, small).cache()
        after = {r["doc_id"]: r["text"] for r in table.collect()}
        if name == "quality_rules":
            assert set(after) == {d for d, t in before.items() if brute_kept(t)} and len(after) > 0.8 * len(before)
        elif name == "near_dedup":
            assert set(after) == {d for d, c in classes(list(before.items())).items() if d == c}
        elif name == "decontamination":
            short = [(d, t) for d, t in before.items() if len(t.split()) < 200]
            assert {d for d, _ in short} - set(after) == {x[0] for x in overlaps(short, bench)}
        elif name == "pii":
            found = pii.span_report(spark.createDataFrame(list(before.items()), "doc_id long, text string"))
            assert after == {r["doc_id"]: redacted(before[r["doc_id"]], r["spans"]) for r in found.collect()}
            assert any(t != before[d] for d, t in after.items())
        if name != "mixing":
            assert table.columns == columns
    owner = {r["doc_id"]: r["source"] for r in docs.collect()}
    sources, copies = {}, Counter()
    for d, t in before.items():
        sources[owner[d]] = sources.get(owner[d], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    targets = slow_targets(sources)
    for d in before:
        rate = targets[owner[d]] / sources[owner[d]]
        drawn = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) / 2**52
        copies[d] = int(rate) + (drawn < rate - int(rate))
    assert Counter(r["doc_id"] for r in table.collect()) == +copies
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in numbers_of(table).values())


def numbers_of(table):
    out = {}
    for r in table.collect():
        out.setdefault(r["doc_id"], []).append(r["copy_no"])
    return out


def redacted(text, spans):
    """Spans that overlap are one, named by the first."""
    joined = []
    for kind, a, b in sorted(((k, int(x), int(y)) for k, x, y in (p.split(":") for p in spans.split(",") if p)), key=lambda s: (s[1], pii.KINDS.index(s[0]))):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    for kind, a, b in reversed(joined):
        text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
    return text


def test_run_is_repeatable(spark, small):
    first = sorted(map(str, corpus_pipeline.run(spark, small).collect()))
    assert first and first == sorted(map(str, corpus_pipeline.run(spark, small).collect()))


def test_registered(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) | {"pipeline"} <= set(e.queries())
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert sorted(int(m[1]) for n in registry.QUERIES if (m := re.match("op([0-9]+)_", n))) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, small, name):
    assert_equal(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)


@pytest.mark.parametrize("name", ["op1_dart_minhash", "op9_spaced_seeds"])
def test_queries_carry_ids(spark, small, name):
    assert "doc_id" in registry.QUERIES[name](spark, small).columns
