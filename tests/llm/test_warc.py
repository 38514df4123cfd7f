import base64
import hashlib
import os
import zlib

from braidgraph.llm import warc


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


ROWS = [(3, "http://a.example.com/x", "<p>same</p>"), (1, "http://b.example.com/x?q=1 2\nX: y", "<p>same</p>"), (2, "http://a.example.com/x", "é日本\r\n\r\nWARC/1.1\r\n"), (9, None, None), (5, "", ""), (6, "http://A.Example.com/é", "long " * 50_000)]


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        shared = len(raw) >= least and first != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if shared else "response", first if shared else None))
    return sorted(out)


def test_records(spark):
    for least in (0, 5, 10**6):
        got = sorted(tuple(r)[:5] for r in warc.capture_records(frame(spark, ROWS), least_bytes=least).collect())
        assert got == brute(ROWS, least)


def test_documents(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = sorted(tuple(r)[:5] for r in warc.capture_records(pages).collect())
    assert got == brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_round_trip_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    archive = warc.write_archive(frame(spark, ROWS))
    payloads = {r["page"]: r["payload"] for r in warc.read_archive(archive).collect()}
    assert bytes(payloads["2"]).decode() == ROWS[2][2] and bytes(payloads["6"]).decode() == ROWS[5][2]
    find = warc.Lookup.of(archive)
    assert sorted(c["page"] for c in find.captures("http://a.example.com/x")) == ["2", "3"]
    assert [c["refers_to"] for c in find.captures("http://a.example.com/x") if c["page"] == "3"] == ["1"]
    assert find.captures("http://nowhere.example.com/") == []


def test_lookup_over_blocks(spark, monkeypatch):
    """Small blocks and files: a key with a third of all captures spans many of both."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "ROLL_BYTES", 600)
    rows = [(i, "http://hot.com/" if i % 3 == 0 else f"http://h{i % 7}.com/{i % 50}", f"page {i}") for i in range(300)]
    archive = warc.write_archive(frame(spark, rows))
    look = warc.Lookup.of(archive)
    assert len(look.files) > 8 and len(set(look.blocks(warc.surt("http://hot.com/")))) >= 14
    for url in {r[1] for r in rows}:
        assert sorted(int(c["page"]) for c in look.captures(url)) == sorted(i for i, u, _ in rows if u == url)
    asked = ["http://hot.com/", "http://h1.com/1", "http://h1.com/1", "http://nowhere.com/", None]
    got = warc.captures(archive, spark.createDataFrame([(u,) for u in asked], "url string"))
    assert sorted((int(r["page"]), bytes(r["payload"]).decode()) for r in got.collect()) == sorted((i, t) for i, u, t in rows if u in asked)
    assert sorted(int(r["page"]) for r in warc.read_archive(archive).collect()) == list(range(300))


def test_null_and_empty_ids(spark):
    rows = [(None, "http://a/1", "same"), ("", "http://a/2", "same"), ("b", "http://a/3", "same"), (None, "http://a/4", "alone"), (None, None, "alone"), ("\\", "http://a/5", ""), ("%5C\t\n", "http://a/6", None)]
    got = warc.capture_records(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    want = [("http://a/1", None, "revisit", ""), ("http://a/2", "", "response", None), ("http://a/3", "b", "revisit", ""), ("http://a/4", None, "response", None), ("None", None, "response", None), ("http://a/5", "\\", "revisit", "%5C\t\n"), ("http://a/6", "%5C\t\n", "response", None)]
    assert sorted((str(r["target_uri"]), str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == sorted((u, str(i), k, str(to)) for u, i, k, to in want)
    numbers = spark.createDataFrame([(None, "http://a/", "x"), (3, "http://a/", "x")], "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.capture_records(numbers).collect()) == [("3", "response", None), ("None", "revisit", 3)]


def test_adjoining_records_are_read_at_once():
    places = [("f", 0, 100), ("f", 100, 50), ("f", 150 + warc.GAP_BYTES, 10), ("f", 200_000_000, 5), ("g", 0, 9), ("g", 9, warc.READ_BYTES)]
    assert [(f, a, n, len(m)) for f, a, n, m in warc._ranges(iter(places))] == [("f", 0, 160 + warc.GAP_BYTES, 3), ("f", 200_000_000, 5, 1), ("g", 0, 9, 1), ("g", 9, warc.READ_BYTES, 1)]


def test_an_archive_can_be_deleted(spark):
    archive = warc.write_archive(frame(spark, ROWS))
    assert warc.read_archive(archive).count() == len(ROWS) and os.listdir(archive.folder)
    archive.delete()
    assert not os.path.exists(archive.folder)


def test_record_is_plain_warc():
    member = warc.record("7", "http://a/", b"body", None)
    text = zlib.decompress(member, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest[length:] == b"\r\n\r\n"
    assert warc.surt("http://www.Example.com/a?b") == "com,example,www)/a?b" and warc.surt(None) == ""


def test_odd_rows(spark):
    assert warc.capture_records(frame(spark, [])).count() == 0
    again = warc.capture_records(frame(spark, [ROWS[0], ROWS[0], ROWS[1]])).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in again) == [(1, "response"), (3, "revisit"), (3, "revisit")]
