import base64
import random
import re
from collections import Counter

import zstandard

from braidgraph.llm.quality import Bands, quality_filter, quality_report

from llm_helpers import prose


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def check(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_report(docs).collect():
        assert tuple(r)[1:7] == brute(texts[r["doc_id"]]), r
        assert not (r["base_failed"] and r["kept"])


def test_counts_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_counts_on_random_texts(spark):
    draw = random.Random(8)
    parts = ["a", "b", "é", "\n", "\n", " ", " ", "\x0b", "#", "日本", "x\r", "\x1c", "a b c d e f g h "]
    check(spark.createDataFrame([(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 120)))) for i in range(400)], "doc_id long, text string"))


def test_bands(spark):
    draw = random.Random(2)
    noise = base64.b64encode(draw.randbytes(6000)).decode()
    noise = " ".join(noise[i : i + 8] for i in range(0, len(noise), 8))
    same = "".join(f"buy now {draw.choice('ab')} " for _ in range(900))
    texts = [prose(draw, 30), prose(draw, 300), prose(draw, 5000), noise, same, prose(draw, 3000) + " " + same * 8]
    got = [r["kept"] for r in quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [True, True, True, False, False, False]
    wide = Bands(whole=((float("inf"), 0.0, 1e9),), chunks=((float("inf"), 0.0, 1e9),), most_repeat_percent=1000)
    assert quality_report(spark.createDataFrame([(0, same)], "doc_id long, text string"), bands=wide).first()["kept"]


def brute_kept(text, bands=Bands()):
    """The verdict by the stated limits, chunk by chunk."""
    raw = (text or "").encode()
    press = zstandard.ZstdCompressor(level=bands.level)

    def outside(part, limits):
        top = [x for x in limits if len(part) <= x[0]] or [limits[-1]]
        ratio = len(part) / len(press.compress(part))
        return ratio < top[0][1] or ratio > top[0][2]

    if brute(text)[5] or outside(raw, bands.whole):
        return False
    parts = [raw[i : i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)] if len(raw) > bands.chunk_bytes else []
    return sum(len(p) for p in parts if outside(p, bands.chunks)) <= bands.bad_share * len(raw)


def test_verdicts(spark):
    """All documents, and texts whose bad part is the last, shorter chunk or a shorter text's end."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    draw = random.Random(4)
    first = 10**9
    made = [prose(draw, 2600)[:16_384] + " z" * 2000, prose(draw, 1000)[:4096] + " z" * 1500, prose(draw, 1000)[:4096] + " end", prose(draw, 9000), prose(draw, 1300)[:8192] + base64.b64encode(draw.randbytes(3000)).decode()]
    docs += [(first + i, t) for i, t in enumerate(made)]
    got = {r["doc_id"]: r["kept"] for r in quality_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: brute_kept(t) for d, t in docs}
    assert [got[first + i] for i in range(len(made))] == [False, False, True, True, False]


def test_odd_rows(odd_docs, no_docs):
    assert quality_report(odd_docs).count() == 10
    kept = quality_filter(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 1, None, 4, 7], key=str)
    assert quality_report(no_docs).count() == quality_filter(no_docs).count() == 0
