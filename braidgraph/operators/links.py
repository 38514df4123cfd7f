"""Queries on links and paths together: validation, shared handles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from .depth import path_length
from ..functions.prefix import BUCKET, with_next
from ..functions.sequences import handle_text

ENDS = ["from_seg", "from_fwd", "to_seg", "to_fwd"]
#: Most steps of a short path, whose handles travel with each other.
CARRIED = 32


def reversed_links(links: DataFrame) -> DataFrame:
    """The same links read from the other strand: ends swap, orientations flip."""
    return links.select(F.col("to_seg").alias("from_seg"), (~F.col("to_fwd")).alias("from_fwd"), F.col("from_seg").alias("to_seg"), (~F.col("from_fwd")).alias("to_fwd"))


def step_pairs(steps: DataFrame, longest: int | None = None) -> DataFrame:
    """path_id, step_idx (of the first), and the ends of each pair of consecutive steps."""
    rows = steps.select("path_id", "step_idx", F.col("seg_id").alias("from_seg"), F.col("fwd").alias("from_fwd"))
    return with_next(rows, "path_id", "step_idx", {"from_seg": "to_seg", "from_fwd": "to_fwd"}, longest).where("to_seg IS NOT NULL")


def missing_links(g: Graph) -> DataFrame:
    """path_id, name, step_idx, from_seg, from_fwd, to_seg, to_fwd of consecutive steps that no link joins,
    in either reading; one row for each time they occur."""
    ends = g.links.select(*ENDS)
    either = ends.unionAll(reversed_links(ends)).distinct()
    return step_pairs(g.steps, g.longest).join(either, ENDS, "left_anti").join(g.paths.select("path_id", "name"), "path_id").select("path_id", "name", "step_idx", *ENDS)


def missing_link_messages(g: Graph) -> DataFrame:
    """path_id, step_idx and a sentence for each missing link."""
    names = g.segments.select("seg_id", F.col("name").alias("seg_name"))
    rows = missing_links(g).join(names.withColumnsRenamed({"seg_id": "from_seg", "seg_name": "from_name"}), "from_seg").join(names.withColumnsRenamed({"seg_id": "to_seg", "seg_name": "to_name"}), "to_seg")
    text = F.concat(F.lit("[odgi::validate] error: the path "), F.col("name"), F.lit(" does not respect the graph topology: the link "), handle_text(F.col("from_name"), F.col("from_fwd")), F.lit(","), handle_text(F.col("to_name"), F.col("to_fwd")), F.lit(" is missing."))
    return rows.select("path_id", "step_idx", text.alias("message"))


def path_overlaps(g: Graph, names: list[str] | None = None) -> DataFrame:
    """ord, name, start, end, other_id, other: for each named path, the other paths with an oriented handle of it.

    start is 0 and end the path's length; rows come by ord, then other_id. An unknown name is an error. Without names
    every path is asked for, with its id as ord; pairs of short paths then need no shuffle of pairs.
    """
    from .depth import named_paths

    if names is None:
        return _all_overlaps(g)
    asked = named_paths(g, names, strict=True)
    handles = _handles(g).distinct()
    own = handles.join(asked.select("path_id").distinct(), "path_id", "left_semi").withColumnRenamed("path_id", "own_id")
    met = own.join(handles.withColumnRenamed("path_id", "other_id"), "handle").where("own_id <> other_id").select("own_id", "other_id").distinct()
    lengths = path_length(g, sorted(set(names))).select(F.col("path_id").alias("own_id"), "length")
    others = g.paths.select(F.col("path_id").alias("other_id"), F.col("name").alias("other"))
    rows = asked.select("ord", F.col("path_id").alias("own_id"), "name").join(met, "own_id").join(lengths, "own_id").join(others, "other_id")
    return rows.select("ord", "name", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), "other_id", "other")


def _handles(g: Graph) -> DataFrame:
    return g.steps.select("path_id", (F.col("seg_id") * 2 + F.col("fwd").cast("long")).alias("handle"))


def _all_overlaps(g: Graph) -> DataFrame:
    """Rows of path_overlaps for all paths: pairs of short paths, and those with a long one."""
    bound = g.longest is not None and g.longest <= BUCKET
    near = g if bound else g.with_tables(steps=g.steps.where(F.col("step_idx") <= CARRIED))
    # Of a long path these are perhaps not all steps, but more than CARRIED.
    walks = _handles(near).groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("handle")).alias("handles"))
    lengths = path_length(g)
    rows = _short_overlaps(walks.where(F.col("n") <= CARRIED).join(lengths, "path_id"))
    long = walks.where(F.col("n") > CARRIED).select("path_id")
    if (g.longest is not None and g.longest <= CARRIED) or long.isEmpty():
        return rows
    return rows.unionByName(_long_overlaps(_handles(g).distinct(), lengths, long))


def _short_overlaps(short: DataFrame) -> DataFrame:
    """Pairs of short paths. Paths meet at every handle that they share, with the lesser handles of each; a pair is kept
    where these have none in common, which is at the least handle of both, and so once."""
    rows = short.select("path_id", "name", "length", "handles", F.posexplode("handles").alias("place", "handle"))
    rows = rows.select("handle", "path_id", "name", "length", F.when(F.col("place") > 0, F.slice("handles", 1, F.col("place"))).alias("lesser"))
    # Both sides have the same columns, so they are one shuffle.
    met = _side(rows, "a").join(_side(rows, "b"), "handle").where("a_path_id < b_path_id")
    return _both_ways(met.where(~F.coalesce(F.arrays_overlap("a_lesser", "b_lesser"), F.lit(False))))


def _long_overlaps(handles: DataFrame, lengths: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs with a long path, found from that; they are made distinct by a shuffle, the only one of pairs."""
    rows = handles.join(long.withColumn("long", F.lit(True)), "path_id", "left").join(lengths, "path_id").select("handle", "path_id", "name", "length", F.coalesce("long", F.lit(False)).alias("long"))
    met = _side(rows.where("long"), "a").join(_side(rows, "b"), "handle").where("a_path_id < b_path_id OR NOT b_long")
    return _both_ways(met.select(*(f"{side}_{c}" for side in "ab" for c in ("path_id", "name", "length"))).distinct())


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("handle", *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "handle"))


def _both_ways(met: DataFrame) -> DataFrame:
    """The rows of pairs a, b that stand for b, a too."""
    def read(own: str, other: str):
        return F.struct(F.col(f"{own}_path_id").alias("ord"), F.col(f"{own}_name").alias("name"), F.lit(0).cast("long").alias("start"), F.col(f"{own}_length").alias("end"), F.col(f"{other}_path_id").alias("other_id"), F.col(f"{other}_name").alias("other"))

    return met.select(F.explode(F.array(read("a", "b"), read("b", "a"))).alias("x")).select("x.*")
