"""Base-pair positions along paths: running offsets, look-ups, windows and interval depth.

Interval joins meet on the name and on bins of a fixed width, so a long path is spread over many tasks;
a pair that shares several bins is kept in the first of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import sums_within
from ..functions.sequences import oriented
from ..plans.graph import Graph
from .depth import step_counts_by_segment

#: Base pairs a bin of an interval join.
BIN = 1 << 12
#: Windows that one row of an interval lists at once.
WINDOWS = 1 << 12


def positioned(g: Graph, steps: DataFrame | None = None, *columns: str) -> DataFrame:
    """The steps with len, pos (offset where the step begins) and more columns of their segments."""
    steps = g.steps if steps is None else steps
    rows = steps.join(g.segments.select("seg_id", "len", *columns), "seg_id")
    return sums_within(rows, "path_id", "step_idx", {"pos": F.col("len")}, g.longest)


def path_sequences(g: Graph) -> DataFrame:
    """path_id, name, seq: the oriented sequences of the steps one after the other."""
    rows = g.steps.join(g.segments.select("seg_id", "seq"), "seg_id").select("path_id", "step_idx", oriented(F.col("seq"), F.col("fwd")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("step_idx", "part"))), lambda x: x["part"])
    spelled = rows.groupBy("path_id").agg(F.array_join(parts, "").alias("seq"))
    return g.paths.select("path_id", "name").join(spelled, "path_id", "left").select("path_id", "name", F.coalesce("seq", F.lit("")).alias("seq"))


def logically_le(a: Graph, b: Graph) -> DataFrame:
    """The paths of a that b doesn't have with the same sequence; none if a is logically below b."""
    return path_sequences(a).select("name", "seq").join(path_sequences(b).select("name", "seq"), ["name", "seq"], "left_anti")


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that a half-open range touches; none for an empty one."""
    each = F.sequence(F.floor(start / width), F.floor((end - 1) / width))
    return F.when(start < end, each).otherwise(F.array().cast("array<bigint>"))


def range_join(a: DataFrame, b: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Pairs of equal key whose ranges (a_start, a_end) and (b_start, b_end) overlap."""
    left = a.withColumn("bin", F.explode(bins(F.col("a_start"), F.col("a_end"), width)))
    right = b.withColumn("bin", F.explode(bins(F.col("b_start"), F.col("b_end"), width)))
    first = F.greatest(F.floor(F.col("a_start") / width), F.floor(F.col("b_start") / width))
    meet = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("bin") == first)
    return left.join(right, [key, "bin"]).where(meet).drop("bin")


def positions(g: Graph, queries: DataFrame) -> DataFrame:
    """For each row of `queries` (name, offset): name, offset, seg_id, seg_name, seg_offset, fwd.

    The step is the first that ends past the offset; offsets outside of a path have no row. Only the
    paths that are asked for are read.
    """
    asked = queries.join(g.paths.select("path_id", "name"), "name").select("path_id", "name", "offset")
    steps = g.steps.join(asked.select("path_id").distinct(), "path_id", "left_semi")
    rows = positioned(g, steps, "name").withColumnRenamed("name", "seg_name").withColumn("path_key", F.col("path_id"))
    points = asked.select(F.col("path_id").alias("path_key"), "name", "offset", F.col("offset").alias("a_start"), (F.col("offset") + 1).alias("a_end"))
    spans = rows.select("path_key", "seg_id", "seg_name", "fwd", "pos", F.col("pos").alias("b_start"), (F.col("pos") + F.col("len")).alias("b_end"))
    return range_join(points, spans, "path_key").select("name", "offset", "seg_id", "seg_name", (F.col("offset") - F.col("pos")).alias("seg_offset"), "fwd")


def make_windows(bed: DataFrame, size: int) -> DataFrame:
    """Each interval tiled from its start by windows of `size`, the last one clipped; empty intervals have none.

    Columns: ord (of the interval), win, name, start, end.
    """
    if size < 1:
        raise ValueError("windows need a positive size")
    # First stretches of many windows, then windows, so a long interval is no long array.
    none = F.array().cast("array<bigint>")
    stretches = F.when(F.col("start") < F.col("end"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1 - F.col("start")) / (size * WINDOWS)))).otherwise(none)
    rows = bed.select("ord", "name", F.col("start").alias("first"), F.col("end").alias("stop"), F.explode(stretches).alias("stretch"))
    last = F.least((F.col("stretch") + 1) * WINDOWS - 1, F.floor((F.col("stop") - 1 - F.col("first")) / size))
    rows = rows.select("ord", "name", "first", "stop", F.explode(F.sequence(F.col("stretch") * WINDOWS, last)).alias("win"))
    start = F.col("first") + F.col("win") * size
    return rows.select("ord", "win", "name", start.alias("start"), F.least(start + size, F.col("stop")).alias("end"))


def interval_depth(g: Graph, bed: DataFrame, key: tuple[str, ...] = ("ord",), width: int = BIN, only: DataFrame | None = None) -> DataFrame:
    """The key columns, name, start, end, covered, mean_depth: depth of a path's base pairs by interval.

    `bed` names a path in each row and is told apart by `key`. covered is the sum of depth times overlap, and
    the mean divides it by the interval's width. Intervals of unknown paths have no row; those past the end
    of their path have a mean of 0; empty ones NaN. `only` (one column, seg_id) may name the segments that the asked
    paths visit, so that others need not be counted.
    """
    asked = bed.join(g.paths.select(F.col("path_id").alias("path_key"), "name"), "name").withColumns({"a_start": F.col("start"), "a_end": F.col("end")})
    steps = g.steps.join(asked.select(F.col("path_key").alias("path_id")).distinct(), "path_id", "left_semi")
    rows = positioned(g, steps).join(step_counts_by_segment(g, only), "seg_id")
    spans = rows.select(F.col("path_id").alias("path_key"), "depth", F.col("pos").alias("b_start"), (F.col("pos") + F.col("len")).alias("b_end"))
    pairs = range_join(asked.select(*key, "path_key", "a_start", "a_end"), spans, "path_key", width)
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    sums = pairs.groupBy(*key, "path_key").agg(F.sum(shared * F.col("depth")).alias("covered"))
    out = asked.join(sums, [*key, "path_key"], "left").na.fill(0, ["covered"])
    span = F.col("end") - F.col("start")
    return out.select(*key, "name", "start", "end", "covered", F.when(span > 0, F.col("covered") / span).otherwise(F.lit(float("nan"))).alias("mean_depth"))


def window_depth(g: Graph, name: str, size: int) -> DataFrame:
    """Interval depth on the windows of one path, which must exist."""
    from .depth import as_bed, named_paths, path_length

    found = named_paths(g, [name], strict=True).select("path_id")
    whole = as_bed(path_length(g, [name]).join(found, "path_id", "left_semi"))
    own = g.steps.join(found, "path_id", "left_semi").select("seg_id").distinct()
    return interval_depth(g, make_windows(whole, size), ("ord", "win"), only=own)


def bed_intersect(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """a_ord, b_ord, name, start, end of the overlaps of intervals with equal names, duplicates kept.

    Sorted by a_ord, then b_ord, they come in the order of two nested loops.
    """
    left = a.select("name", F.col("ord").alias("a_ord"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = b.select("name", F.col("ord").alias("b_ord"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return range_join(left, right, "name", width).select("a_ord", "b_ord", "name", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))
