import random

import pytest
from test_fixtures import GAF, TINY

from braidgraph.facade import GraphView
from braidgraph.operators import extract, positions
from braidgraph.sources import gfa_text


@pytest.fixture(scope="module")
def view(spark):
    return GraphView(gfa_text.parse_gfa(spark, TINY).cached())


def test_lists(view):
    assert (len(view.segments), len(view.paths), len(view.links)) == (4, 2, 4)
    assert view.segments[2].sequence() == "TTG" and len(view.segments[1]) == 19
    assert [s.name for s in view.segments[1:3]] == [2, 3] and view.segments[-1].name == 4
    assert view.segments.find(3).id == 2 and view.segments.find(9) is None
    assert view.paths.find("two").id == 1 and len(view.paths.find("two")) == 4
    assert view.paths[0][2].segment.name == 4 and not view.paths[0][2].is_forward
    assert str(view.segments[2]) == "S\t3\tTTG" and str(view.links[1]) == "L\t2\t+\t4\t-\t0M" and str(view.paths[0]) == "P\tone\t1+,2+,4-\t*"
    assert view.segments[0] == view.segments[0] and view.segments[0] != view.segments[1]
    for wrong in (4, -5):
        with pytest.raises(IndexError):
            view.segments[wrong]
    with pytest.raises(IndexError):
        view.segments[0:4:2]
    assert str(view) == TINY and view.size > 0


def test_reads(view, tmp_path):
    (tmp_path / "a.gaf").write_text(GAF)
    found = list(view.all_reads(str(tmp_path / "a.gaf")))
    assert [r.name for r in found] == ["foo", "bar"]
    assert found[0].segment_ranges() == [(5, 8), (0, 9), (1, 0)] and found[1].sequence() == "GAAATTTTCTGGAGTTCTAT"
    assert list(view.gaf_lookup(str(tmp_path / "a.gaf")))[0] == ("foo", "AAGAAATTTTCT")
    assert view.pangenotype([str(tmp_path / "a.gaf")]) == [[True] * 4]


def test_plain_accessors(view):
    assert view.segment_count() == 4 and view.path_count() == 2
    assert view.segment_sequence(2) == "TTG" and view.segment_sequence(9) is None
    assert view.path_name(1) == "two" and view.path_name(7) is None
    assert view.path_step_count(0) == 3 and view.path_step_count(5) is None
    assert view.path_step(0, 2) == (3, False) and view.path_step(0, 3) is None
    assert view.path_sequence("one").startswith("CAAATAAG")


def test_gaps_in_turn_reach_the_same_set(spark):
    draw = random.Random(4)
    walks = [",".join(f"{draw.randint(1, 12)}+" for _ in range(8)) for _ in range(3)]
    g = gfa_text.parse_gfa(spark, "".join(f"S\t{i}\tAA\n" for i in range(1, 13)) + "".join(f"P\tp{i}\t{w}\t*\n" for i, w in enumerate(walks))).cached()
    start = spark.createDataFrame([(0,), (4,)], "seg_id long")
    for most in (0, 6, 100):
        once = {r[0] for r in extract.fill_gaps(g, start, most).collect()}
        assert once == {r[0] for r in extract.fill_gaps_in_turn(g, start, most, 20).collect()}
    assert positions.positioned(g).count() == 24
