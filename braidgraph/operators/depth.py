"""Depth of segments and paths, path lengths, and crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import BROADCAST_ROWS
from ..plans.graph import Graph


def named_paths(g: Graph, names: list[str], strict: bool = False) -> DataFrame:
    """ord, path_id, name for each name that is a path, in the order of the arguments, duplicates kept.

    Unknown names are left out; with `strict` they are an error.
    """
    listed = g.spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    if strict:
        rows = listed.join(g.paths.select("path_id", "name"), "name", "left")
        missing = F.raise_error(F.concat(F.lit("no such path: "), F.col("name"))).cast("long")
        return rows.select("ord", F.coalesce("path_id", missing).alias("path_id"), "name")
    # The names come from the driver as arguments; beyond the bound they are joined like a table.
    return g.paths.select("path_id", "name").join(F.broadcast(listed) if len(names) <= BROADCAST_ROWS else listed, "name").select("ord", "path_id", "name")


def steps_on(g: Graph, names: list[str] | None) -> DataFrame:
    """The steps of the named paths; of all paths for None."""
    if names is None:
        return g.steps
    wanted = g.paths.where(F.col("name").isin(names)) if len(names) <= 1000 else g.paths.join(g.spark.createDataFrame([(n,) for n in names], "name string"), "name", "left_semi")
    return g.steps.join(wanted.select("path_id"), "path_id", "left_semi")


def segment_depth(g: Graph, names: list[str] | None = None) -> DataFrame:
    """seg_id, name, depth (steps on the segment), uniq (distinct paths); segments without steps have zeros.

    Steps are first counted by segment and path, so a segment that many paths cross often sends one row a path.
    """
    by_path = steps_on(g, names).groupBy("seg_id", "path_id").agg(F.count(F.lit(1)).alias("n"))
    counts = by_path.groupBy("seg_id").agg(F.sum("n").alias("depth"), F.count(F.lit(1)).alias("uniq"))
    return g.segments.select("seg_id", "name").join(counts, "seg_id", "left").na.fill(0, ["depth", "uniq"])


def step_counts_by_segment(g: Graph, only: DataFrame | None = None) -> DataFrame:
    """seg_id and depth of the segments that some step visits, of all or of those in `only`."""
    steps = g.steps if only is None else g.steps.join(only, "seg_id", "left_semi")
    return steps.groupBy("seg_id").agg(F.count(F.lit(1)).alias("depth"))


def segment_depth_only(g: Graph) -> DataFrame:
    """seg_id, name, depth; cheaper than segment_depth as paths need not be told apart."""
    return g.segments.select("seg_id", "name").join(step_counts_by_segment(g), "seg_id", "left").na.fill(0, ["depth"])


def mean(total: Column, length: Column) -> Column:
    """total / length; NaN where there is nothing to divide by."""
    return F.when(length > 0, total / length).otherwise(F.lit(float("nan")))


def path_depth(g: Graph, names: list[str] | None = None, strict: bool = False) -> DataFrame:
    """path_id, name, length, weighted, mean_depth: the mean depth of a path's base pairs.

    `names` picks the reported paths, in the order of `ord`; depth is always counted over all paths.
    """
    by_segment = g.segments.select("seg_id", "len").join(step_counts_by_segment(g), "seg_id")
    reported = g.paths.select("path_id", "name") if names is None else named_paths(g, names, strict)
    steps = g.steps if names is None else g.steps.join(reported.select("path_id").distinct(), "path_id", "left_semi")
    sums = steps.select("path_id", "seg_id").join(by_segment, "seg_id").groupBy("path_id").agg(F.sum("len").alias("length"), F.sum(F.col("len") * F.col("depth")).alias("weighted"))
    rows = reported.join(sums, "path_id", "left").na.fill(0, ["length", "weighted"])
    return rows.withColumn("mean_depth", mean(F.col("weighted"), F.col("length")))


def path_length(g: Graph, names: list[str] | None = None) -> DataFrame:
    """path_id, name, length in base pairs; paths without steps have length 0."""
    lengths = steps_on(g, names).select("path_id", "seg_id").join(g.segments.select("seg_id", "len"), "seg_id").groupBy("path_id").agg(F.sum("len").alias("length"))
    reported = g.paths.select("path_id", "name") if names is None else named_paths(g, names)
    return reported.join(lengths, "path_id", "left").na.fill(0, ["length"])


def as_bed(lengths: DataFrame) -> DataFrame:
    """Paths as intervals over their whole length: ord, name, start, end."""
    order = F.col("ord") if "ord" in lengths.columns else F.col("path_id")
    return lengths.select(order.alias("ord"), "name", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


def crossings(g: Graph) -> DataFrame:
    """seg_id and steps, an array of (path_id, step_idx, fwd) in order, empty where no step is.

    A segment's steps are one value by definition, so a segment with very many steps is one large row; depth and
    segment_depth don't need them.
    """
    lists = g.steps.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("path_id", "step_idx", "fwd"))).alias("steps"))
    rows = g.segments.select("seg_id", "name").join(lists, "seg_id", "left")
    none = F.array().cast("array<struct<path_id:bigint,step_idx:bigint,fwd:boolean>>")
    return rows.select("seg_id", "name", F.coalesce("steps", none).alias("steps"))
