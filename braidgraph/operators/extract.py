"""Neighbourhoods: the part of a graph around a segment.

The set of segments grows in rounds: one round for each link of distance, then rounds that fill gaps of
paths, path after path or all at once. A round is a few joins against the set; the sets are written to reliable
checkpoints, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import checkpointed, least_beside, numbered, sums_within
from ..plans.graph import Graph
from .accessors import find_segment, undirected
from .links import ENDS
from .positions import positioned


def neighborhood(g: Graph, start: DataFrame, distance: int) -> DataFrame:
    """seg_id of the segments at most `distance` links from the start set (one column, seg_id)."""
    edges = undirected(g)
    found = frontier = checkpointed(start.select("seg_id").distinct())
    for _ in range(distance):
        reached = edges.join(frontier.withColumnRenamed("seg_id", "seg"), "seg", "left_semi").select(F.col("other").alias("seg_id")).distinct()
        frontier = checkpointed(reached.join(found, "seg_id", "left_anti"))
        if frontier.isEmpty():
            break
        found = checkpointed(found.unionAll(frontier))
    return found


def gap_segments(spans: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Segments that paths visit between two visits of the set, where the path comes back at an offset of
    at most `most` from its beginning."""
    rows = spans.join(found.withColumn("inside", F.lit(True)), "seg_id", "left").select("path_id", "step_idx", "seg_id", "pos", F.coalesce("inside", F.lit(False)).alias("inside"))
    # Offsets grow along a path, so the least one among the later visits is that of the next.
    rows = least_beside(rows, "path_id", "step_idx", F.when(F.col("inside"), F.col("pos")), "visited", "back_at")
    return rows.where(f"NOT inside AND visited IS NOT NULL AND back_at <= {int(most)}").select("seg_id").distinct()


def fill_gaps(g: Graph, found: DataFrame, most: int, rounds: int | None = None) -> DataFrame:
    """The set with gaps filled until nothing changes, or for a number of rounds of all paths at once."""
    spans = positioned(g).select("path_id", "step_idx", "seg_id", "pos")
    done = 0
    while rounds is None or done < rounds:
        more = checkpointed(gap_segments(spans, found, most))
        if more.isEmpty():
            break
        found = checkpointed(found.unionAll(more))
        done += 1
    return found


def subpaths(g: Graph, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and steps of the runs of steps inside a set: path_id, name (name:start-end), and the runs' steps."""
    rows = g.steps.join(g.segments.select("seg_id", "len"), "seg_id").join(found.withColumn("inside", F.lit(True)), "seg_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    # Steps outside end a run: counting them numbers the runs.
    rows = sums_within(rows, "path_id", "step_idx", {"pos": F.col("len"), "run": (~F.col("inside")).cast("int")}, g.longest).where("inside")
    runs = rows.groupBy("path_id", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("end"), F.min("step_idx").alias("first"), F.count(F.lit(1)).alias("n_steps"))
    named = runs.join(g.paths.select("path_id", "name"), "path_id")
    named = numbered(named, "new_id", F.col("path_id"), F.col("first"))
    paths = named.select("new_id", F.concat("name", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("name"), "path_id", "start", "end", "n_steps")
    steps = rows.join(named.select("path_id", "run", "new_id", "first"), ["path_id", "run"]).select(F.col("new_id").alias("path_id"), (F.col("step_idx") - F.col("first")).alias("step_idx"), "seg_id", "fwd")
    return paths, steps


def extract(g: Graph, origin: int, link_distance: int, most_gap: int = 300_000, rounds: int | None = 6, at_once: bool = False) -> Graph:
    """The neighbourhood of the segment named `origin`: names, tags and overlaps of links are kept, paths become
    the sub-paths inside. Gaps are filled for a number of rounds, path after path, or at_once for all paths of a round;
    without a number until nothing changes, where the order of paths makes no difference."""
    start = find_segment(g, origin)
    if start.isEmpty():
        raise ValueError(f"no such segment: {origin}")
    fill = fill_gaps if at_once or rounds is None else fill_gaps_in_turn
    return induced(g, fill(g, neighborhood(g, start, link_distance), most_gap, rounds))


def induced(g: Graph, found: DataFrame) -> Graph:
    """The sub-graph of a set of segments, numbered anew in the old order."""
    kept = numbered(g.segments.join(found, "seg_id", "left_semi"), "new_id", F.col("seg_id"))
    ids = kept.select("seg_id", "new_id")
    segments = kept.select(F.col("new_id").alias("seg_id"), "name", "seq", "len", "optional")
    links = g.links.join(ids.withColumnsRenamed({"seg_id": "from_seg", "new_id": "a"}), "from_seg").join(ids.withColumnsRenamed({"seg_id": "to_seg", "new_id": "b"}), "to_seg")
    links = numbered(links.select("link_id", F.col("a").alias("from_seg"), "from_fwd", F.col("b").alias("to_seg"), "to_fwd", "overlap").withColumnRenamed("link_id", "old_id"), "link_id", F.col("old_id")).select("link_id", *ENDS, "overlap")
    paths, steps = subpaths(g, found)
    steps = steps.join(ids, "seg_id").select("path_id", "step_idx", F.col("new_id").alias("seg_id"), "fwd")
    paths = paths.select(F.col("new_id").alias("path_id"), "name", F.lit(None).cast("array<array<struct<len:int,op:string>>>").alias("overlaps"))
    return g.with_tables(segments=segments, links=links, paths=paths, steps=steps)


def fill_gaps_in_turn(g: Graph, found: DataFrame, most: int, rounds: int) -> DataFrame:
    """Gaps filled path after path, each seeing what those before it added, for a number of rounds.

    Within a round every segment that is added has a time: the path, and the step at which that comes back to the
    set. A step is inside if its segment's time is before the step's own. From no times at all, times are worked out
    again from the ones before until they stay; each pass settles at least the earliest time that was not yet right, so the
    passes are as many as additions depend on each other, not as there are paths.
    """
    spans = checkpointed(positioned(g).select("path_id", "step_idx", "seg_id", "pos"))
    for _ in range(rounds):
        before = found.select("seg_id", F.lit(None).cast("struct<path:bigint,step:bigint>").alias("since"))
        added, mark = None, None
        while True:
            known = before if added is None else before.unionAll(added)
            rows = spans.join(known.withColumn("known", F.lit(True)), "seg_id", "left")
            own = F.struct(F.col("path_id").alias("path"), F.col("step_idx").alias("step"))
            rows = rows.select("path_id", "step_idx", "seg_id", "pos", F.coalesce(F.col("known") & (F.col("since").isNull() | (F.col("since") < own)), F.lit(False)).alias("inside"))
            # The next step inside is the least one after; its offset comes along.
            rows = least_beside(rows, "path_id", "step_idx", F.when(F.col("inside"), F.struct("step_idx", "pos")), "visited", "back")
            closed = rows.where(f"NOT inside AND visited IS NOT NULL AND back.pos <= {int(most)}").select("seg_id", F.struct(F.col("path_id").alias("path"), F.col("back.step_idx").alias("step")).alias("since"))
            added = checkpointed(closed.groupBy("seg_id").agg(F.min("since").alias("since")))
            now = added.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("seg_id", "since")).alias("x")).first()
            if (now["n"], now["x"]) == mark:
                break
            mark = (now["n"], now["x"])
        if not mark[0]:
            break
        found = checkpointed(found.select("seg_id").unionAll(added.select("seg_id")))
    return found
