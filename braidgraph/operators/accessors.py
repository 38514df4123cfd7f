"""Lists, look-ups and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import sign
from ..plans.graph import Graph


def find_segment(g: Graph, name: int) -> DataFrame:
    """The first segment of a name, or no row."""
    return g.segments.where(F.col("name") == name).orderBy("seg_id").limit(1)


def find_path(g: Graph, name: str) -> DataFrame:
    """The first path of a name, or no row."""
    return g.paths.where(F.col("name") == name).orderBy("path_id").limit(1)


def at(table: DataFrame, id_col: str, index: int) -> DataFrame:
    return table.where(F.col(id_col) == index)


def between(table: DataFrame, id_col: str, start: int, stop: int) -> DataFrame:
    """The rows of a half-open range of ids, in order."""
    return table.where((F.col(id_col) >= start) & (F.col(id_col) < stop)).orderBy(id_col)


def path_names(g: Graph) -> DataFrame:
    """path_id and name; the order is that of path_id."""
    return g.paths.select("path_id", "name")


def path_steps(g: Graph, path_id: int) -> DataFrame:
    """The steps of a path with their segments' names, in order."""
    return g.steps.where(F.col("path_id") == path_id).join(g.segments.select("seg_id", F.col("name").alias("seg_name")), "seg_id").orderBy("step_idx")


def slice_path(g: Graph, path_id: int, start: int, stop: int) -> DataFrame:
    """A half-open range of a path's steps, numbered anew from 0: a path of its own."""
    kept = g.steps.where((F.col("path_id") == path_id) & (F.col("step_idx") >= start) & (F.col("step_idx") < stop))
    return kept.withColumn("step_idx", F.col("step_idx") - start)


def step_counts(g: Graph) -> DataFrame:
    """path_id, name, n_steps; 0 for empty paths."""
    counts = g.steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_steps"))
    return g.paths.select("path_id", "name").join(counts, "path_id", "left").na.fill(0, ["n_steps"])


def neighbors(g: Graph, seg_id: int) -> DataFrame:
    """The segment at the other end of each link that touches a segment; itself for a loop."""
    touching = g.links.where((F.col("from_seg") == seg_id) | (F.col("to_seg") == seg_id))
    return touching.select("link_id", F.when(F.col("from_seg") == seg_id, F.col("to_seg")).otherwise(F.col("from_seg")).alias("other_seg"))


def undirected(g: Graph) -> DataFrame:
    """seg, other: both directions of every link; a loop comes twice."""
    return g.links.select(F.col("from_seg").alias("seg"), F.col("to_seg").alias("other")).unionAll(g.links.select(F.col("to_seg").alias("seg"), F.col("from_seg").alias("other")))


def degree(g: Graph) -> DataFrame:
    """seg_id, name, degree: link ends on the segment, so a loop counts twice; zeros kept."""
    ends = undirected(g).groupBy(F.col("seg").alias("seg_id")).agg(F.count(F.lit(1)).alias("degree"))
    return g.segments.select("seg_id", "name").join(ends, "seg_id", "left").na.fill(0, ["degree"])


def adjacency(g: Graph) -> DataFrame:
    """seg_id, fwd, ins, outs: handles linked to and from each handle, duplicates kept, empty lists where none.

    Lists hold (seg, fwd) in the order of the links.
    """
    def listed(key_seg: str, key_fwd: str, seg: str, fwd: str, name: str) -> DataFrame:
        entry = F.struct("link_id", F.col(seg).alias("seg"), F.col(fwd).alias("fwd"))
        rows = g.links.groupBy(F.col(key_seg).alias("seg_id"), F.col(key_fwd).alias("fwd")).agg(F.array_sort(F.collect_list(entry)).alias("found"))
        return rows.select("seg_id", "fwd", F.transform("found", lambda x: F.struct(x["seg"].alias("seg"), x["fwd"].alias("fwd"))).alias(name))

    handles = g.segments.select("seg_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd"))
    none = F.array().cast("array<struct<seg:bigint,fwd:boolean>>")
    rows = handles.join(listed("to_seg", "to_fwd", "from_seg", "from_fwd", "ins"), ["seg_id", "fwd"], "left").join(listed("from_seg", "from_fwd", "to_seg", "to_fwd", "outs"), ["seg_id", "fwd"], "left")
    return rows.select("seg_id", "fwd", F.coalesce("ins", none).alias("ins"), F.coalesce("outs", none).alias("outs"))


def graph_stats(g: Graph) -> DataFrame:
    """One row: length, nodes, edges, paths, steps."""
    parts = g.segments.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("length"), F.count(F.lit(1)).alias("nodes"))
    for table, name in ((g.links, "edges"), (g.paths, "paths"), (g.steps, "steps")):
        parts = parts.join(table.agg(F.count(F.lit(1)).alias(name)))  # one row with one row
    return parts


def self_loops(g: Graph) -> DataFrame:
    """One row: links from a segment to itself, and segments with one."""
    return g.links.where("from_seg = to_seg").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("from_seg").alias("unique"))


def graph_maxes(g: Graph) -> DataFrame:
    """One row: max_n (segments), max_e (most steps on one segment), max_p (paths)."""
    most = g.steps.groupBy("seg_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_e"))
    return g.segments.agg(F.count(F.lit(1)).alias("max_n")).join(most).join(g.paths.agg(F.count(F.lit(1)).alias("max_p")))


#: Bytes of an element of each pool in the flat binary layout. Fixed values of that format.
ELEMENT_BYTES = {"header": 1, "segs": 24, "paths": 24, "links": 16, "steps": 4, "seq_data": 1, "overlaps": 8, "alignment": 4, "name_data": 1, "optional_data": 1, "line_order": 1}


def table_of_contents(g: Graph, in_bytes: bool = False) -> DataFrame:
    """pool, size: elements of each pool of the graph, or bytes of the flat binary layout."""
    def one(table: DataFrame | None, name: str, size) -> DataFrame:
        if table is None:
            return g.spark.createDataFrame([(name, 0)], "pool string, size long")
        return table.agg(F.coalesce(size, F.lit(0)).cast("long").alias("size")).select(F.lit(name).alias("pool"), "size")

    count = F.count(F.lit(1))
    operations = F.aggregate(F.coalesce("overlaps", F.array().cast("array<array<struct<len:int,op:string>>>")), F.lit(0), lambda a, x: a + F.size(x))
    rows = [
        one(g.headers, "header", F.sum(F.octet_length("text"))),
        one(g.segments, "segs", count),
        one(g.paths, "paths", count),
        one(g.links, "links", count),
        one(g.steps, "steps", count),
        one(g.segments, "seq_data", F.sum(F.octet_length("seq"))),
        one(g.paths, "overlaps", F.sum(F.coalesce(F.size("overlaps"), F.lit(0)))),
        one(g.paths.select(operations.alias("n")).unionAll(g.links.select(F.coalesce(F.size("overlap"), F.lit(0)).alias("n"))), "alignment", F.sum("n")),
        one(g.paths, "name_data", F.sum(F.octet_length("name"))),
        one(g.segments, "optional_data", F.sum(F.octet_length(F.coalesce("optional", F.lit(""))))),
        one(g.lines, "line_order", count),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    if in_bytes:
        weights = F.create_map(*(F.lit(x) for pair in ELEMENT_BYTES.items() for x in pair))
        out = out.select("pool", (F.col("size") * F.element_at(weights, F.col("pool"))).cast("long").alias("size"))
    return out


def total_bytes(g: Graph) -> DataFrame:
    """One row: bytes of all pools together."""
    return table_of_contents(g, in_bytes=True).agg(F.sum("size").alias("bytes"))


def adjacency_matrix(g: Graph) -> DataFrame:
    """from_name, to_name, value: both directions of every link, duplicates kept, orientation dropped."""
    names = g.segments.select("seg_id", "name")
    ends = undirected(g).join(names.select(F.col("seg_id").alias("seg"), F.col("name").alias("from_name")), "seg").join(names.select(F.col("seg_id").alias("other"), F.col("name").alias("to_name")), "other")
    return ends.select("from_name", "to_name", F.lit(1).cast("long").alias("value"))


def adjacency_matrix_header(g: Graph) -> DataFrame:
    """One row: rows, columns (the largest segment name) and entries of the sparse matrix."""
    top = g.segments.agg(F.coalesce(F.max("name"), F.lit(0)).alias("top"))
    return top.join(g.links.agg((F.count(F.lit(1)) * 2).alias("entries"))).select(F.col("top").alias("rows"), F.col("top").alias("columns"), "entries")


def handle_label(seg: str, fwd: str):
    return F.concat(F.col(seg).cast("string"), sign(F.col(fwd)))
