"""GFA text: reading into a graph, writing in three orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import sums_before
from ..functions.sequences import cigar_text, parse_cigar, parse_sign, sign
from ..plans.graph import Graph
from .text import lines_of, numbered_lines


def read_gfa(spark: SparkSession, path: str, mode: str = "lenient") -> Graph:
    """The graph of one text file; .gz files are decompressed.

    lenient: lines are trimmed, blank lines skipped, fields may be parted by spaces, link tags ignored.
    strict: fields are parted by tabs, and anything that doesn't fit, unknown operations of overlaps too, is an error. Segment tags and the last,
    unterminated line are kept in both. A name that no segment has is an error.
    """
    if path.endswith(".og"):
        raise ValueError("this binary format belongs to another tool; convert it to GFA text first")
    return graph_of(numbered_lines(spark, path), mode)


def parse_gfa(spark: SparkSession, text: str | bytes, mode: str = "lenient") -> Graph:
    """The graph of a text in memory."""
    return graph_of(lines_of(spark, text), mode)


def _fail(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), value))


def graph_of(lines: DataFrame, mode: str = "lenient") -> Graph:
    strict = mode == "strict"
    if not strict:
        lines = lines.withColumn("value", F.trim(F.regexp_replace("value", r"\s+$", ""))).where("value <> ''")
    kind = F.left("value", F.lit(1))
    known = kind.isin("H", "S", "P", "L") & (F.substr("value", F.lit(2), F.lit(1)).isin("\t", " ", "") if not strict else (F.substr("value", F.lit(2), F.lit(1)) == "\t"))
    lines = lines.withColumn("kind", F.when(known, kind).otherwise(_fail("not a line of a graph: ", F.col("value"))))
    lines = _numbered_by_kind(lines)
    sep = "\t" if strict else r"[\t ]+"

    def of(k: str, n: int) -> DataFrame:
        return lines.where(F.col("kind") == k).select("ord", F.split("value", sep, n).alias("f"), "value")

    def need(ok: Column, value: Column, message: str, kind: str) -> Column:
        return F.when(ok, value).otherwise(_fail(message, F.col("value")).cast(kind))

    headers = lines.where("kind = 'H'").select("ord", F.substr("value", F.lit(3)).alias("text"))
    s = of("S", 4)
    name = need(F.size("f") >= 3, F.get("f", F.lit(1)), "not a segment: ", "string").cast("long")
    seq = F.get("f", F.lit(2))
    segments = s.select(F.col("ord").alias("seg_id"), name.alias("name"), seq.alias("seq"), F.length(seq).cast("long").alias("len"), F.coalesce(F.get("f", F.lit(3)), F.lit("")).alias("optional"))

    names = segments.select(F.col("name").alias("key"), "seg_id").groupBy("key").agg(F.min("seg_id").alias("seg_id"))

    def resolved(rows: DataFrame, by: str, out: str) -> DataFrame:
        met = rows.join(names.withColumnsRenamed({"key": by, "seg_id": out}), by, "left")
        return met.withColumn(out, F.coalesce(out, _fail("no such segment: ", F.col(by).cast("string")).cast("long")))

    l = of("L", -1)  # noqa: E741
    shape = F.size("f") == 6 if strict else F.size("f") >= 6
    f1 = need(shape, F.get("f", F.lit(1)), "not a link: ", "string")
    links = l.select(F.col("ord").alias("link_id"), f1.cast("long").alias("from_name"), parse_sign(F.get("f", F.lit(2))).alias("from_fwd"), F.get("f", F.lit(3)).cast("long").alias("to_name"), parse_sign(F.get("f", F.lit(4))).alias("to_fwd"), parse_cigar(F.get("f", F.lit(5)), strict).alias("overlap"))
    links = resolved(resolved(links, "from_name", "from_seg"), "to_name", "to_seg").select("link_id", "from_seg", "from_fwd", "to_seg", "to_fwd", "overlap")

    p = of("P", -1).select("ord", need(F.size("f") >= 4, F.get("f", F.lit(1)), "not a path: ", "string").alias("name"), F.get("f", F.lit(2)).alias("walk"), F.get("f", F.lit(3)).alias("laps"))
    laps = F.when(F.col("laps") != "*", F.transform(F.split("laps", ","), lambda x: parse_cigar(x, strict)))
    n_steps = F.when(F.col("walk") == "", 0).otherwise(F.size(F.split("walk", ",")))
    fits = laps.isNull() | F.size(laps).isin(0) | (F.size(laps) == n_steps) | (F.size(laps) == n_steps - 1)
    checked = laps if not strict else F.when(F.coalesce(fits, F.lit(True)), laps).otherwise(_fail("a path needs as many overlaps as steps, or one less: ", F.col("name")).cast("array<array<struct<len:int,op:string>>>"))
    paths = p.select(F.col("ord").alias("path_id"), "name", checked.alias("overlaps"))
    steps = p.where("walk <> ''").select(F.col("ord").alias("path_id"), F.posexplode(F.split("walk", ",")).alias("step_idx", "step"))
    steps = steps.select("path_id", F.col("step_idx").cast("long").alias("step_idx"), F.expr("substr(step, 1, length(step) - 1)").cast("long").alias("seg_name"), parse_sign(F.right("step", F.lit(1))).alias("fwd"))
    steps = resolved(steps, "seg_name", "seg_id").select("path_id", "step_idx", "seg_id", "fwd")
    return Graph(headers, segments, paths, steps, links, lines.select("line_no", "kind", "ord"))


def _numbered_by_kind(lines: DataFrame) -> DataFrame:
    """Adds ord, the number of each line among those of its kind, by running sums over the line numbers."""
    rows = sums_before(lines, "line_no", {f"before_{k}": (F.col("kind") == k).cast("int") for k in "HSPL"})
    found = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"before_{k}")) for k in "HSPL"))
    return rows.withColumn("ord", found).drop(*(f"before_{k}" for k in "HSPL"))


def path_key(paths: DataFrame) -> Column:
    """What canonical text sorts paths by: the name, or where a path was renamed its sort_name."""
    return F.coalesce("sort_name", "name") if "sort_name" in paths.columns else F.col("name")


def header_lines(g: Graph) -> DataFrame:
    return g.headers.select("ord", F.concat(F.lit("H\t"), F.col("text")).alias("text"))


def segment_lines(g: Graph, tags: bool = True) -> DataFrame:
    """seg_id, name and text of each segment's line."""
    text = F.concat(F.lit("S\t"), F.col("name").cast("string"), F.lit("\t"), F.col("seq"))
    if tags:
        text = F.concat(text, F.when(F.coalesce(F.length("optional"), F.lit(0)) > 0, F.concat(F.lit("\t"), F.col("optional"))).otherwise(""))
    return g.segments.select("seg_id", "name", text.alias("text"))


def path_lines(g: Graph) -> DataFrame:
    """path_id, name and text of each path's line."""
    steps = g.steps.join(g.segments.select("seg_id", F.col("name").alias("seg_name")), "seg_id")
    step = F.concat(F.col("seg_name").cast("string"), sign(F.col("fwd")))
    walks = steps.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_idx", step.alias("step")))), lambda x: x["step"]), ",").alias("walk"))
    laps = F.when(F.coalesce(F.size("overlaps"), F.lit(0)) > 0, F.array_join(F.transform("overlaps", cigar_text), ",")).otherwise("*")
    text = F.concat_ws("\t", F.lit("P"), F.col("name"), F.coalesce("walk", F.lit("")), laps)
    return g.paths.join(walks, "path_id", "left").select("path_id", "name", text.alias("text"))


def link_lines(g: Graph, canonical: bool = False) -> DataFrame:
    """link_id and text of each link's line.

    Canonical: a link whose second name sorts before its first as text, or a loop from the backward strand,
    is read from the other strand.
    """
    names = g.segments.select("seg_id", F.col("name").cast("string").alias("text_name"))
    rows = g.links.join(names.withColumnsRenamed({"seg_id": "from_seg", "text_name": "a"}), "from_seg").join(names.withColumnsRenamed({"seg_id": "to_seg", "text_name": "b"}), "to_seg")
    turn = ((F.col("b") < F.col("a")) | ((F.col("a") == F.col("b")) & ~F.col("from_fwd"))) if canonical else F.lit(False)
    a, b = F.when(turn, F.col("b")).otherwise(F.col("a")), F.when(turn, F.col("a")).otherwise(F.col("b"))
    fa, fb = F.when(turn, ~F.col("to_fwd")).otherwise(F.col("from_fwd")), F.when(turn, ~F.col("from_fwd")).otherwise(F.col("to_fwd"))
    return rows.select("link_id", F.concat_ws("\t", F.lit("L"), a, sign(fa), b, sign(fb), cigar_text(F.col("overlap"))).alias("text"))


def preserved_lines(g: Graph) -> DataFrame:
    """line_no and text in the order of the file that the graph was read from."""
    if g.lines is None:
        raise ValueError("a changed graph has no line order")
    kinds = [("H", header_lines(g).select("ord", "text")), ("S", segment_lines(g).select(F.col("seg_id").alias("ord"), "text")), ("P", path_lines(g).select(F.col("path_id").alias("ord"), "text")), ("L", link_lines(g).select(F.col("link_id").alias("ord"), "text"))]
    rows = None
    for k, table in kinds:
        table = table.select(F.lit(k).alias("kind"), F.col("ord").cast("long").alias("ord"), "text")
        rows = table if rows is None else rows.unionByName(table)
    return g.lines.join(rows, ["kind", "ord"]).select("line_no", "text")


def normalized_lines(g: Graph) -> DataFrame:
    """section, ord, text: headers, segments, paths, links, each in the order of ids."""
    parts = [header_lines(g).select("ord", "text"), segment_lines(g).select(F.col("seg_id").alias("ord"), "text"), path_lines(g).select(F.col("path_id").alias("ord"), "text"), link_lines(g).select(F.col("link_id").alias("ord"), "text")]
    rows = [t.select(F.lit(i).alias("section"), F.col("ord").cast("long").alias("ord"), "text") for i, t in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def canonical_lines(g: Graph, links: bool = True) -> DataFrame:
    """section, key, text: headers, then segments and paths by name as text, then links by their canonical line."""
    rows = header_lines(g).select(F.lit(0).alias("section"), F.format_string("%020d", "ord").alias("key"), "text")
    rows = rows.unionByName(segment_lines(g, tags=False).select(F.lit(1).alias("section"), F.col("name").cast("string").alias("key"), "text"))
    keys = g.paths.select("path_id", path_key(g.paths).alias("key"))
    rows = rows.unionByName(path_lines(g).join(keys, "path_id").select(F.lit(2).alias("section"), "key", "text"))
    if links:
        rows = rows.unionByName(link_lines(g, canonical=True).select(F.lit(3).alias("section"), F.col("text").alias("key"), "text"))
    return rows


def text_of(lines: DataFrame) -> str:
    """All lines in order as one text, through the driver a partition at a time."""
    order = [c for c in lines.columns if c != "text"]
    return "".join(r["text"] + "\n" for r in lines.orderBy(*order).toLocalIterator())


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order as a folder of text files, whose names sort like their lines."""
    order = [c for c in lines.columns if c != "text"]
    lines.orderBy(*order).select("text").write.text(path)


def write_gfa(g: Graph, path: str) -> None:
    """Write in the order of the source file if the graph has one, else normalised."""
    write_lines(preserved_lines(g) if g.lines is not None else normalized_lines(g), path)


def duplicate_names(g: Graph) -> DataFrame:
    """table, name, n of names that several segments or paths have; they are all kept."""
    def of(table: DataFrame, what: str) -> DataFrame:
        return table.groupBy(F.col("name").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(what).alias("table"), "name", "n")

    return of(g.segments, "segments").unionByName(of(g.paths, "paths"))

