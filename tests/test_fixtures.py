import dataclasses
import io
import random

import pytest
from pyspark.sql import functions as F

from braidgraph import cli
from braidgraph.functions import prefix
from braidgraph.functions.packing import PackedSeq, pack, unpack
from braidgraph.functions.sequences import format_number
from braidgraph.operators import accessors, depth, extract, links, positions, reads, transforms
from braidgraph.plans import script
from braidgraph.sources import gfa_text, json_graph, tables, text

TINY = """H\tVN:Z:1.0
S\t1\tCAAATAAG
S\t2\tAAATTTTCTGGAGTTCTAT
S\t3\tTTG
S\t4\tCCAACTCTCTG
P\tone\t1+,2+,4-\t*
P\ttwo\t1+,2+,3+,4-\t*
L\t1\t+\t2\t+\t0M
L\t2\t+\t4\t-\t0M
L\t2\t+\t3\t+\t0M
L\t3\t+\t4\t-\t0M
"""
GAF = """foo\t12\t0\t12\t+\t>1>2<4\t38\t5\t17\t12\t12\t0\tcg:Z:150M
bar\t20\t0\t20\t+\t>1>2>3\t30\t7\t27\t20\t20\t0\tcg:Z:150M
"""
EX1 = "S\t1\tA\nS\t2\tC\nL\t1\t+\t2\t+\t0M\nL\t2\t+\t2\t+\t0M\nP\tpath1\t1+,2+,2+\t*\n"
FLIP1 = "S\t1\tA\nS\t2\tTTT\nS\t3\tG\nL\t1\t+\t2\t+\t0M\nL\t2\t+\t3\t+\t0M\nP\tx\t1+,2-,3+\t*\n"
FLIP2 = FLIP1 + "P\ty\t1+,2-,3+\t*\n"


@pytest.fixture(scope="module")
def tiny(spark):
    return gfa_text.parse_gfa(spark, TINY).cached()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_round_trip(tiny):
    assert gfa_text.text_of(gfa_text.preserved_lines(tiny)) == TINY


def test_file_round_trip_and_bundle(spark, tmp_path, tiny):
    import gzip

    (tmp_path / "t.gfa.gz").write_bytes(gzip.compress(TINY.encode()))
    g = tables.load(spark, str(tmp_path / "t.gfa.gz"))
    assert gfa_text.text_of(gfa_text.preserved_lines(g)) == TINY
    tables.write_bundle(g, str(tmp_path / "t.bundle"))
    again = tables.load(spark, str(tmp_path / "t.gfa.gz"))
    assert gfa_text.text_of(gfa_text.preserved_lines(again)) == TINY
    assert gfa_text.text_of(gfa_text.preserved_lines(tables.load(spark, str(tmp_path / "t.bundle")))) == TINY
    with pytest.raises(ValueError):
        tables.load(spark, "x.og")


def test_unterminated_line_and_strict_errors(spark, tmp_path):
    (tmp_path / "a.gfa").write_text(EX1.rstrip("\n"))
    g = gfa_text.read_gfa(spark, str(tmp_path / "a.gfa"))
    assert g.paths.count() == 1
    assert text.line_count(spark, str(tmp_path / "a.gfa")) == 4
    with pytest.raises(Exception, match="no such segment"):
        gfa_text.parse_gfa(spark, "S\t1\tA\nP\tx\t1+,7+\t*\n").steps.collect()
    with pytest.raises(Exception, match="not a line"):
        gfa_text.parse_gfa(spark, "S\t1\tA\nX\tfoo\n").lines.collect()


def test_canonical(spark):
    g = gfa_text.parse_gfa(spark, "S\t10\tA\nS\t2\tC\nL\t2\t-\t10\t+\t1M\nL\t2\t-\t2\t+\t0M\nP\tx\t2+,10-\t*\n")
    assert gfa_text.text_of(gfa_text.canonical_lines(g)) == "S\t10\tA\nS\t2\tC\nP\tx\t2+,10-\t*\nL\t10\t-\t2\t+\t1M\nL\t2\t-\t2\t+\t0M\n"


def test_cigars(spark):
    g = gfa_text.parse_gfa(spark, "S\t1\tA\tLN:i:1\tXX:Z:a b\nS\t2\tC\nL\t1\t+\t2\t+\t3M2I300D\nP\tx\t1+,2+\t1M,2I4D\n", "strict")
    out = gfa_text.text_of(gfa_text.normalized_lines(g))
    assert "L\t1\t+\t2\t+\t3M2I300D\n" in out and "P\tx\t1+,2+\t1M,2I4D\n" in out and "S\t1\tA\tLN:i:1\tXX:Z:a b\n" in out


def test_accessors(tiny):
    assert tuple(accessors.graph_stats(tiny).first()) == (41, 4, 4, 2, 7)
    assert accessors.find_segment(tiny, 3).first()["seq"] == "TTG"
    assert accessors.find_segment(tiny, 9).count() == 0
    assert accessors.find_path(tiny, "two").first()["path_id"] == 1
    assert rows(depth.segment_depth(tiny), "seg_id") == [(0, 1, 2, 2), (1, 2, 2, 2), (2, 3, 1, 1), (3, 4, 2, 2)]
    assert [r[2] for r in rows(accessors.degree(tiny), "seg_id")] == [1, 3, 2, 2]
    found = rows(depth.path_depth(tiny), "path_id")
    assert [(r[1], r[2], format_number(r[4])) for r in found] == [("one", 38, "2"), ("two", 41, "1.93")]
    assert positions.path_sequences(tiny).where("name = 'one'").first()["seq"] == "CAAATAAGAAATTTTCTGGAGTTCTATCAGAGAGTTGG"


def test_subset_depth(spark):
    g = gfa_text.parse_gfa(spark, EX1)
    assert rows(depth.segment_depth(g), "seg_id") == [(0, 1, 1, 1), (1, 2, 2, 1)]
    assert rows(depth.segment_depth(g, ["none"]), "seg_id") == [(0, 1, 0, 0), (1, 2, 0, 0)]
    assert [r[2] for r in rows(accessors.degree(g), "seg_id")] == [1, 3]
    assert tuple(accessors.self_loops(g).first()) == (1, 1)
    assert format_number(depth.path_depth(g).first()["mean_depth"]) == "1.67"


def test_empty_path_and_missing_names(spark):
    g = gfa_text.parse_gfa(spark, "S\t1\tAC\nP\te\t\t*\nP\tf\t1+\t*\n", "strict")
    found = {r["name"]: r for r in depth.path_depth(g).collect()}
    assert found["e"]["length"] == 0 and format_number(found["e"]["mean_depth"]) == "NaN"
    assert depth.path_depth(g, ["zzz", "f", "f"]).count() == 2
    with pytest.raises(Exception, match="no such path"):
        depth.path_depth(g, ["zzz"], strict=True).collect()


def test_positions_and_windows(spark, tiny):
    asked = spark.createDataFrame([("two", 30), ("two", 41), ("one", 0)], "name string, offset long")
    assert rows(positions.positions(tiny, asked), "name") == [("one", 0, 0, 1, 0, True), ("two", 30, 3, 4, 0, False)]
    found = rows(positions.window_depth(tiny, "two", 10), "win")
    assert [format_number(r[-1]) for r in found] == ["2", "2", "1.7", "2", "2"]
    bed = tables.parse_bed(spark, "#c\na\t0\t10\textra\nb\t5\t5\n")
    assert rows(positions.make_windows(bed, 4).select("name", "start", "end"), "start") == [("a", 0, 4), ("a", 4, 8), ("a", 8, 10)]


def test_bins_lose_and_repeat_nothing(spark):
    draw = random.Random(1)
    made = lambda n: [(i, draw.choice("ab"), s := draw.randint(0, 300), s + draw.randint(0, 120)) for i in range(n)]
    a, b = made(60), made(60)
    want = sorted((x[0], y[0], x[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[1] == y[1] and min(x[3], y[3]) > max(x[2], y[2]))
    frame = lambda t: spark.createDataFrame(t, "ord long, name string, start long, end long")
    assert rows(positions.bed_intersect(frame(a), frame(b), width=16), "a_ord", "b_ord") == want


def test_reads(spark, tiny):
    found = tables.parse_gaf(spark, GAF)
    assert [r[3] for r in rows(reads.read_sequences(tiny, found), "read_ord")] == ["AAGAAATTTTCT", "GAAATTTTCTGGAGTTCTAT"]
    low, high = reads.closed_range(*(F.col(c) for c in ("kind", "start", "end", "len")))
    ranges = rows(reads.chunks(tiny, found).select("read_ord", "index", low.alias("low"), high.alias("high")), "read_ord", "index")
    assert [r[2:] for r in ranges] == [(5, 8), (0, 9), (1, 0), (7, 8), (0, 18), (0, 0)]
    assert rows(reads.read_descriptions(tiny, found), "read_ord")[0][3] == "0: 1+, 5-8bp1: 2+, 0-9bp2: (skipped)"
    both = found.withColumn("file", F.lit("a")).unionByName(found.where("name = 'foo'").withColumn("file", F.lit("b")))
    assert rows(reads.presence_rows(tiny, both), "file") == [("a", [True] * 4), ("b", [True, True, False, True])]
    with pytest.raises(Exception, match="no such segment"):
        reads.chunks(tiny, found.withColumn("path", F.lit(">9"))).collect()


def test_chop(spark, tiny):
    out = transforms.chop(tiny, 8, with_links=True)
    assert [r[2] for r in rows(out.segments, "seg_id")] == ["CAAATAAG", "AAATTTTC", "TGGAGTTC", "TAT", "TTG", "CCAACTCT", "CTG"]
    assert gfa_text.path_lines(out).where("name = 'one'").first()["text"] == "P\tone\t1+,2+,3+,4+,7-,6-\t*"
    assert positions.logically_le(tiny, out).count() == 0
    assert [r["text"] for r in gfa_text.link_lines(out).orderBy("link_id").collect()][:4] == ["L\t2\t+\t3\t+\t0M", "L\t3\t+\t4\t+\t0M", "L\t6\t+\t7\t+\t0M", "L\t1\t+\t2\t+\t0M"]
    assert links.missing_links(out).count() == links.missing_links(tiny).count() == 0
    with pytest.raises(ValueError):
        transforms.chop(tiny, 0)
    g = gfa_text.parse_gfa(spark, "S\t1\tACGT\n")
    g = g.with_tables(segments=g.segments.unionByName(g.segments.withColumns({"seg_id": F.lit(1).cast("long"), "name": F.lit(2).cast("long"), "seq": F.lit(""), "len": F.lit(0).cast("long")})))
    assert transforms.chop(g, 2).segments.count() == 3 and transforms.chop(g, 2, drop_empty=True).segments.count() == 2


def test_flip(spark):
    out = transforms.flip(gfa_text.parse_gfa(spark, FLIP1))
    assert gfa_text.path_lines(out).first()["text"] == "P\tx_inv\t3-,2+,1-\t*"
    assert [r["text"] for r in gfa_text.link_lines(out).orderBy("link_id").collect()] == ["L\t1\t+\t2\t+\t0M", "L\t2\t+\t3\t+\t0M", "L\t3\t-\t2\t+\t0M", "L\t2\t+\t1\t-\t0M"]
    assert links.missing_links(out).count() == 0
    assert transforms.flip(gfa_text.parse_gfa(spark, FLIP2)).links.count() == 4
    messages = [r["message"] for r in links.missing_link_messages(gfa_text.parse_gfa(spark, FLIP1)).orderBy("step_idx").collect()]
    assert [m.split("the link ")[1] for m in messages] == ["1+,2- is missing.", "2-,3+ is missing."]


def test_crush(spark):
    g = gfa_text.parse_gfa(spark, "S\t1\tCNNATNNNG\nS\t2\tNNNN\nS\t3\tACG\n")
    assert [(r["seq"], r["len"]) for r in transforms.crush(g).segments.orderBy("seg_id").collect()] == [("CNATNG", 6), ("N", 1), ("ACG", 3)]


def slow_inject(segments, paths, bed):
    """One row after the other, on lists: segments are strings, paths lists of (segment, forward)."""
    segments, paths = list(segments), {k: list(v) for k, v in paths.items()}
    for name, low, high, new in bed:
        if name not in paths:
            continue
        for point in (low, high):
            at = 0
            for seg, fwd in paths[name]:
                size = len(segments[seg])
                if at < point < at + size:
                    cut = point - at if fwd else size - (point - at)
                    segments[seg : seg + 1] = [segments[seg][:cut], segments[seg][cut:]]
                    grown = lambda s, f, seg=seg: [(s, f)] if s < seg else [(s + 1, f)] if s > seg else [(s, f), (s + 1, f)] if f else [(s + 1, f), (s, f)]
                    paths = {k: [x for s, f in v for x in grown(s, f)] for k, v in paths.items()}
                    break
                at += size
        at, walk = 0, []
        for seg, fwd in paths[name]:
            if low <= at and at + len(segments[seg]) <= high:
                walk.append((seg, fwd))
            at += len(segments[seg])
        paths[new] = walk
    return segments, paths


def test_inject_equals_one_row_after_the_other(spark):
    draw = random.Random(5)
    for _ in range(2):
        n = draw.randint(2, 5)
        segments = ["".join(draw.choice("ACGT") for _ in range(draw.randint(1, 6))) for _ in range(n)]
        paths = {f"p{i}": [(draw.randrange(n), draw.random() < 0.5) for _ in range(draw.randint(1, 6))] for i in range(2)}
        bed = []
        for i in range(3):
            name = draw.choice([*paths, "none"])
            size = sum(len(segments[s]) for s, _ in paths.get(name, [(0, True)]))
            low = draw.randint(0, size - 1)
            bed.append((name, low, draw.randint(low + 1, size), f"new{i}"))
        lines = "".join(f"S\t{i + 1}\t{s}\n" for i, s in enumerate(segments)) + "".join(f"P\t{k}\t{','.join(f'{s + 1}' + ('+' if f else '-') for s, f in v)}\t*\n" for k, v in paths.items())
        out = transforms.inject(gfa_text.parse_gfa(spark, lines).cached(), bed).cached()
        want_segments, want_paths = slow_inject(segments, paths, bed)
        assert [r["seq"] for r in out.segments.orderBy("seg_id").collect()] == want_segments
        got = {r["name"]: r["text"].split("\t")[2] for r in gfa_text.path_lines(out).collect()}
        assert got == {k: ",".join(f"{s + 1}" + ("+" if f else "-") for s, f in v) for k, v in want_paths.items()}


def test_inject_on_an_injected_path(spark, tiny):
    out = transforms.inject(tiny, [("two", 3, 30, "a"), ("a", 2, 9, "b")])
    seqs = {r["name"]: r["seq"] for r in positions.path_sequences(out).collect()}
    assert seqs["a"] == seqs["two"][3:30] and seqs["b"] == seqs["a"][2:9]
    assert positions.logically_le(tiny, out).count() == 0


def test_extract(spark, tiny):
    out = extract.extract(tiny, 3, 1, 0)
    assert [r["name"] for r in out.segments.orderBy("seg_id").collect()] == [2, 3, 4]
    assert sorted(r["name"] for r in out.paths.collect()) == ["one:8-38", "two:8-41"]
    assert out.links.count() == 3
    far = gfa_text.parse_gfa(spark, "".join(f"S\t{i}\tAA\n" for i in range(1, 7)) + "L\t1\t+\t6\t+\t0M\nP\tx\t1+,2+,3+,6+,5+\t*\n")
    assert [r["name"] for r in extract.extract(far, 1, 1, 100).segments.orderBy("seg_id").collect()] == [1, 2, 3, 6]
    assert [r["name"] for r in extract.extract(far, 1, 1, 5).segments.orderBy("seg_id").collect()] == [1, 6]
    with pytest.raises(ValueError):
        extract.extract(tiny, 99, 1)


def test_overlaps_and_matrix(tiny):
    assert rows(links.path_overlaps(tiny, ["one"]), "ord") == [(0, "one", 0, 38, 1, "two")]
    assert tuple(accessors.adjacency_matrix_header(tiny).first()) == (4, 4, 8)
    assert accessors.adjacency_matrix(tiny).count() == 8
    assert rows(transforms.fasta_lines(tiny, 16), "line_no") == [(0, "CAAATAAGAAATTTTC"), (1, "TGGAGTTCTATTTGCC"), (2, "AACTCTCTG")]


def test_json_round_trip(spark, tiny):
    dumped = json_graph.dump(tiny, max_n=6)
    again = json_graph.load(spark, dumped)
    assert gfa_text.text_of(gfa_text.canonical_lines(again)) == gfa_text.text_of(gfa_text.canonical_lines(tiny))
    import json

    d = json.loads(dumped)["depth"]
    assert d["path_ids3"]["data"] == [2, 0] and d["path_ids6"]["data"] == [0, 0] and d["paths_to_consider1"]["data"] == [0, 1, 1]
    with pytest.raises(json_graph.GraphTooBigError):
        json_graph.dimensions(tiny, max_n=2)


def test_packed(spark, tmp_path):
    draw = random.Random(2)
    for n in (0, 1, 2, 5, 64, 101):
        s = "".join(draw.choice("ACGT") for _ in range(n))
        p = PackedSeq(s)
        assert str(p) == s and str(PackedSeq.from_bytes(p.to_bytes())) == s and len(p) == n
        assert str(p[1:4]) == s[1:4]
        row = spark.createDataFrame([(s,)], "s string").select(pack(F.col("s")).alias("p"), F.length("s").alias("n")).select("p", unpack(F.col("p"), F.col("n")).alias("s")).first()
        assert row["s"] == s and bytes(row["p"]) == bytes(p.data)
    p = PackedSeq("ACGT")
    p[2] = "T"
    assert str(p) == "ACTT" and p[-1] == "T"
    (tmp_path / "t").write_text("AC TGG\n")
    tables.export_sequence(str(tmp_path / "t"), str(tmp_path / "p"))
    assert tables.import_sequence(str(tmp_path / "p")) == "ACTGG"
    with pytest.raises(KeyError):
        PackedSeq("N")


def test_number_format():
    values = [0.125, 0.375, 2.675, 1.005, 2.0, 0.1, 12.5, 100.0, 1.999]
    assert [format_number(v) for v in values] == ["0.12", "0.38", "2.67", "1", "2", "0.1", "12.5", "100", "2"]


def test_script(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(TINY)
    bed, code = tmp_path / "w.bed", ""
    code = f"odgi depth -i {tmp_path}/g.gfa -r two | bedtools makewindows -b /dev/stdin -w 20 > {bed} ; odgi depth -i {tmp_path}/g.gfa -b {bed}"
    assert len(script.run(spark, code, only_plan=True).split("\n")) == 3
    (shown,) = script.run(spark, code)
    assert script.table_text(shown) == "#path\tstart\tend\tmean.depth\ntwo\t0\t20\t2\ntwo\t20\t40\t1.85\ntwo\t40\t41\t2\n"
    assert "path-length" in script.run(spark, code, only_plan=True)
    graph = code.split("-i ")[1].split()[0]
    text = lambda c: "".join(map(script.table_text, script.run(spark, c)))
    whole = text(f"odgi depth -d -i {graph}").splitlines(keepends=True)
    assert whole[0] == "#node.id\tdepth\tdepth.uniq\n" and len(whole) == 5
    assert text(f"odgi depth -d -i {graph} | tail -n1") == whole[-1]
    table = script.run(spark, f"odgi depth -d -i {graph}")[0]
    table = script.Table(spark.createDataFrame(table.rows.collect(), table.rows.schema), table.header)
    for n in (0, 1, 4, 5, 9):
        cut = lambda op, count: script.table_text(script._cut_lines(table, op, count))
        assert (cut("head", str(n)), cut("tail", str(n)), cut("tail", f"+{n}")) == ("".join(whole[:n]), "".join(whole[len(whole) - min(n, 5) :]), "".join(whole[max(0, n - 1) :])), n
    assert text(f"odgi depth -r two -i {graph}") == "#path\tstart\tend\tmean.depth\n" + "two\t0\t41\t1.93\n"
    with pytest.raises(Exception, match="no such path"):
        text(f"odgi depth -r none -i {graph} | bedtools makewindows -b /dev/stdin -w 3")
    assert bed.read_text() == "two\t0\t20\ntwo\t20\t40\ntwo\t40\t41\n"
    for wrong in ("rm x", "odgi depth -i a && odgi depth -i b", "odgi depth -q"):
        with pytest.raises(script.ScriptError):
            script.parse(wrong)


def test_command_line(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(TINY)
    (tmp_path / "r.gaf").write_text(GAF)

    def say(*argv):
        out = io.StringIO()
        assert cli.main(["-I", str(tmp_path / "g.gfa"), *argv], spark, out) == 0
        return out.getvalue()

    assert say() == TINY
    assert say("paths") == "one\ntwo\n"
    assert say("stats") == "#length\tnodes\tedges\tpaths\tsteps\n41\t4\t4\t2\t7\n"
    assert say("position", "-p", "two,30,+") == "#source.path.pos\ttarget.graph.pos\ntwo,30,+\t4,0,-\n"
    assert say("depth", "-r", "two") == "#path\tstart\tend\tmean.depth\ntwo\t0\t41\t1.93\n"
    assert say("depth", "-d").splitlines()[1] == "1\t2\t2"
    assert say("gaf", str(tmp_path / "r.gaf"), "-s") == "foo\tAAGAAATTTTCT\nbar\tGAAATTTTCTGGAGTTCTAT\n"
    assert say("gaf", str(tmp_path / "r.gaf"), "-b") == "6\n"
    assert say("matrix", str(tmp_path / "r.gaf")) == "1111\n"
    assert say("toc").splitlines()[1] == "segs\t4"
    assert say("validate") == ""
    assert "S\t2\tAAATTTTC\n" in say("chop", "-c", "8", "-l")
    assert len(say("somepaths", "50").splitlines()) == 1


def test_random_helpers(tiny):
    assert transforms.random_bed(tiny) == transforms.random_bed(tiny)
    assert transforms.drop_some_links(tiny, 50).links.count() == 2
    assert transforms.some_paths(tiny, 50).paths.count() == 1
    assert transforms.hashed_paths(tiny, 100).paths.count() == 0
    assert transforms.drop_overlaps(tiny).paths.where("overlaps IS NOT NULL").count() == 0


@pytest.mark.parametrize("n, k", [(0, 0), (1, 1), (2, 1), (5, 5), (21, 4), (22, 4), (100, 50), (700, 700), (1000, 990), (3000, 900), (3000, 120)])
def test_samples_are_python_s(spark, n, k):
    want = random.Random(4).sample(range(n), k)
    assert [r["place"] for r in transforms.sampled_places(spark, n, k, 4).orderBy("ord").collect()] == want


def test_sampled_names_stay_off_the_driver(spark, monkeypatch):
    """The draw is that of Python's generator over the names by path_id, whose numbers may have gaps."""
    names = [f"p{i % 7}-{i}" for i in range(300)]
    g = gfa_text.parse_gfa(spark, "S\t1\tA\n" + "".join(f"P\t{n}\t1+\t*\n" for n in names))
    g = g.with_tables(paths=g.paths.withColumn("path_id", F.col("path_id") * 3))
    whole, collected = type(g.paths).collect, []
    monkeypatch.setattr(type(g.paths), "collect", lambda self: collected.append(out := whole(self)) or out)
    for percent in (0, 10, 50, 98):
        got = transforms.sampled_names(g, percent)
        assert sum(map(len, collected)) < 10
        want = random.Random(4).sample(names, int((100 - percent) / 100 * len(names))) if percent else names
        assert [tuple(r) for r in whole(got)] == list(enumerate(want))
    with pytest.raises(ValueError):
        transforms.sampled_names(g, 101)


def test_stream(spark, tmp_path, tiny):
    from braidgraph.streaming.reads import stream_reads, visits

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gaf").write_text(GAF)
    q = visits(tiny, stream_reads(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("visits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("visits"), "seg_id") == [(0, 2), (1, 2), (2, 1), (3, 1)]


@pytest.mark.parametrize("longest", [None, 12])
@pytest.mark.parametrize("carried", [0, 3, 32])
def test_overlaps_of_short_and_long_paths(spark, monkeypatch, carried, longest):
    """Pairs of paths that share many handles, visit them again, or are empty, against all pairs of sets."""
    draw = random.Random(5)
    walks = [[(draw.randint(1, 9), draw.choice("+-")) for _ in range(draw.choice([0, 1, 2, 3, 4, 8, 12]))] for _ in range(40)]
    text = "".join(f"S\t{i}\t{'A' * i}\n" for i in range(1, 10)) + "".join(f"P\tp{i}\t{','.join(f'{s}{o}' for s, o in w)}\t*\n" for i, w in enumerate(walks) if w)
    g = dataclasses.replace(gfa_text.parse_gfa(spark, text), longest=longest)
    names = [f"p{i}" for i, w in enumerate(walks) if w]
    walks = [w for w in walks if w]
    want = [(i, names[i], 0, sum(s for s, _ in a), j, names[j]) for i, a in enumerate(walks) for j, b in enumerate(walks) if i != j and set(a) & set(b)]
    monkeypatch.setattr(links, "CARRIED", carried)
    assert sorted(map(tuple, links.path_overlaps(g).collect())) == want


def test_strict_overlaps(spark):
    bad = "S\t1\tAC\nS\t2\tGT\nL\t1\t+\t2\t+\t3M?2XQQ\n"
    assert gfa_text.link_lines(gfa_text.parse_gfa(spark, bad)).first()["text"].endswith("\t3M")
    with pytest.raises(Exception, match="not an overlap"):
        gfa_text.link_lines(gfa_text.parse_gfa(spark, bad, "strict")).collect()
    for good in ("*", "0M", "3M2I1D4N"):
        assert gfa_text.link_lines(gfa_text.parse_gfa(spark, bad.replace("3M?2XQQ", good), "strict")).count() == 1


def test_canonical_order_of_names(spark):
    """Only a turned path keeps its old place; names that end in _inv by themselves sort as they are."""
    text = "S\t1\tACGT\nP\ta_inv\t1+\t*\nP\ta1\t1+\t*\nP\ta\t1-\t*\nP\taa\t1+\t*\n"
    names = lambda g: [t.split("\t")[1] for t in gfa_text.text_of(gfa_text.canonical_lines(g)).splitlines() if t.startswith("P")]
    g = gfa_text.parse_gfa(spark, text)
    assert names(g) == sorted(["a_inv", "a1", "a", "aa"])
    assert names(transforms.flip(g)) == ["a_inv", "a1", "a_inv", "aa"]


def test_short_lines_of_reads(spark):
    text = "r1\t0\t0\t0\t+\t>1>2\n# note\n\nr2\tx\nr3\t8\t0\t8\t+\t>2\t8\t1\t2\n"
    walks = rows(tables.parse_gaf(spark, text, walks_only=True).select("read_ord", "name", "path", "start"), "read_ord")
    assert walks == [(0, "r1", ">1>2", None), (4, "r3", ">2", 1)]
    with pytest.raises(Exception, match="nine fields"):
        tables.parse_gaf(spark, text).collect()


def test_line_counts(spark, tmp_path):
    for i, (data, n) in enumerate([(b"", 0), (b"a\nb\n", 2), (b"a\nb", 1), (b"\n", 1), (b"a\r\nb\rc\n", 2)]):
        (tmp_path / f"{i}.txt").write_bytes(data)
        assert text.line_count(spark, str(tmp_path / f"{i}.txt")) == n, data


def test_random_bed_of_empty_paths(spark):
    g = gfa_text.parse_gfa(spark, "S\t1\tACGT\nP\tnone\t\t*\nP\tsome\t1+\t*\n", "strict").cached()
    for seed in range(8):
        assert all(name == "some" and 0 <= low < high <= 4 for name, low, high, _ in transforms.random_bed(g, seed))


def test_paths_longer_than_a_bucket(spark, monkeypatch):
    """Sums, neighbours and gaps of paths over many buckets, one path with nine in ten of the steps."""
    draw = random.Random(8)
    n = {"long": 90, "short": 3, "other": 7}
    lines = "".join(f"S\t{i}\t{'A' * (i % 4)}\n" for i in range(1, 31))
    walks = {k: [(draw.randint(1, 30), draw.random() < 0.5) for _ in range(m)] for k, m in n.items()}
    lines += "".join(f"P\t{k}\t{','.join(f'{s}{"+" if f else "-"}' for s, f in w)}\t*\n" for k, w in walks.items())
    g = gfa_text.parse_gfa(spark, lines, "strict").cached()
    inside = spark.createDataFrame([(3,), (7,), (20,)], "seg_id long")
    asked = {
        "positions": lambda: rows(positions.positioned(g).select("path_id", "step_idx", "pos"), "path_id", "step_idx"),
        "pairs": lambda: rows(links.step_pairs(g.steps), "path_id", "step_idx"),
        "chop": lambda: rows(transforms.chop(g, 2).steps, "path_id", "step_idx"),
        "gaps": lambda: rows(extract.gap_segments(positions.positioned(g), inside, 60), "seg_id"),
        "subpaths": lambda: rows(extract.subpaths(g, inside)[0].select("path_id", "name", "n_steps"), "path_id"),
    }
    plain = {k: f() for k, f in asked.items()}
    for bucket in (7, 10):
        monkeypatch.setattr(prefix, "BUCKET", bucket)
        assert {k: f() for k, f in asked.items()} == plain
    pos = {(p, i): x for p, i, x in plain["positions"]}
    for p, (k, w) in enumerate(walks.items()):
        at = 0
        for i, (s, _) in enumerate(w):
            assert pos[p, i] == at
            at += s % 4
    assert [(r[2], r[4]) for r in plain["pairs"] if r[0] == 0] == [(a[0] - 1, b[0] - 1) for a, b in zip(walks["long"], walks["long"][1:])]


def in_turn(walks, lengths, found, most, times):
    """Gaps filled path after path, the slow way."""
    inside = set(found)
    for _ in range(times):
        for walk in walks:
            gap, visited, at = [], False, 0
            for s in walk:
                if s in inside:
                    if visited and at <= most:
                        inside.update(gap)
                    gap, visited = [], True
                else:
                    gap.append(s)
                at += lengths[s]
    return inside


def test_gaps_in_turn(spark):
    draw = random.Random(9)
    for trial in range(6):
        lengths = [draw.randint(0, 3) for _ in range(20)]
        walks = [[draw.randrange(20) for _ in range(draw.randint(2, 9))] for _ in range(5)]
        text_ = "".join(f"S\t{i + 1}\t{'A' * x}\n" for i, x in enumerate(lengths)) + "".join(f"P\tp{i}\t{','.join(f'{s + 1}+' for s in w)}\t*\n" for i, w in enumerate(walks))
        g = gfa_text.parse_gfa(spark, text_, "strict").cached()
        found, most, times = draw.sample(range(20), 3), draw.choice([2, 6, 100]), 1 + trial % 2
        got = extract.fill_gaps_in_turn(g, spark.createDataFrame([(s,) for s in found], "seg_id long"), most, times)
        assert {r[0] for r in got.collect()} == in_turn(walks, lengths, found, most, times), trial
