"""Reads aligned to the graph (GAF): chunks, their sequences and descriptions, presence matrices.

A read is a row (file, read_ord, name, path, start, end); path is >12<34 ... and the range is relative to
its own walk. How the walk meets the range needs no loop: with s and e its ends, the start step is the
first whose end is past s, the end step the first from there on whose end is past e. Steps outside of
the two are skipped, those between are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import bounded
from ..functions.sequences import oriented, sign
from ..plans.graph import Graph

KEY = ["file", "read_ord"]


def read_handles(reads: DataFrame, *keep: Column) -> DataFrame:
    """file, read_ord, index, seg_name, fwd of a read's steps, up to the first character that doesn't fit."""
    valid = F.regexp_extract("path", r"^((?:[<>][0-9]+)*)", 1)
    found = F.regexp_extract_all(valid, F.lit("[<>][0-9]+"), F.lit(0))
    rows = reads.select(*KEY, *keep, F.posexplode(found).alias("index", "step"))
    return rows.select(*(c for c in rows.columns if c != "step"), F.substr("step", F.lit(2)).cast("long").alias("seg_name"), (F.left("step", F.lit(1)) == ">").alias("fwd"))


def _resolved(g: Graph, rows: DataFrame, strict: bool, *columns: str) -> DataFrame:
    names = g.segments.select(F.col("name").alias("seg_name"), "seg_id", *columns)
    if not strict:
        return rows.join(names, "seg_name")
    missing = F.raise_error(F.concat(F.lit("no such segment: "), F.col("seg_name").cast("string"))).cast("long")
    return rows.join(names, "seg_name", "left").withColumn("seg_id", F.coalesce("seg_id", missing))


def chunks(g: Graph, reads: DataFrame, strict: bool = True) -> DataFrame:
    """file, read_ord, read, index, seg_id, seg_name, fwd, kind, start, end, len of every step of every read.

    kind is none, all or partial; start and end are half-open within the step (null for none). An unknown
    segment is an error, or with strict=False its step is left out.
    """
    rows = _resolved(g, read_handles(reads, F.col("name").alias("read"), F.col("start").alias("s"), F.col("end").alias("e")), strict, "len")
    walk = Window.partitionBy(*KEY).orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*KEY)
    rows = rows.withColumn("b", F.sum("len").over(walk)).withColumn("a", F.col("b") - F.col("len"))
    rows = rows.withColumn("first", F.min(F.when(F.col("s") < F.col("b"), F.col("index"))).over(whole))
    rows = rows.withColumn("last", F.min(F.when((F.col("index") >= F.col("first")) & (F.col("e") < F.col("b")), F.col("index"))).over(whole))
    i, first, last = F.col("index"), F.col("first"), F.col("last")
    skipped = first.isNull() | (i < first) | (last.isNotNull() & (i > last))
    is_first, is_last = i == first, last.isNotNull() & (i == last)
    kind = F.when(skipped, "none").when(is_first | is_last, "partial").otherwise("all")
    start = F.when(skipped, None).when(is_first, F.col("s") - F.col("a")).otherwise(0)
    end = F.when(skipped, None).when(is_last, F.col("e") - F.col("a")).otherwise(F.col("len"))
    return rows.select(*KEY, "read", F.col("index").cast("long").alias("index"), "seg_id", "seg_name", "fwd", kind.alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), "len")


def with_sequences(g: Graph, rows: DataFrame) -> DataFrame:
    """Chunks with seq, the segment's sequence; chunks of kind none are left out, as they have none."""
    return rows.where("kind <> 'none'").join(g.segments.select("seg_id", "seq"), "seg_id")


def closed_range(kind: Column, start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """The range as the list interface shows it: (1, 0) for none, (0, len - 1) for all, (start, end) for partial."""
    return F.when(kind == "none", 1).when(kind == "all", 0).otherwise(start).cast("long"), F.when(kind == "none", 0).when(kind == "all", length - 1).otherwise(end).cast("long")


def chunk_sequence(kind: Column, seq: Column, fwd: Column, start: Column, end: Column) -> Column:
    """The oriented sequence of a chunk; empty for none."""
    strand = oriented(seq, fwd)
    cut = F.substr(strand, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    return F.when(kind == "all", strand).when(kind == "partial", cut).otherwise("")


def chunk_description(index: Column, name: Column, fwd: Column, kind: Column, start: Column, end: Column, length: Column) -> Column:
    head = F.concat(index.cast("string"), F.lit(": "))
    handle = F.concat(name.cast("string"), sign(fwd), F.lit(", "))
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit("bp"))
    return F.when(kind == "none", F.concat(head, F.lit("(skipped)"))).when(kind == "all", F.concat(head, handle, length.cast("string"), F.lit("bp"))).otherwise(F.concat(head, handle, span))


def _per_read(reads: DataFrame, rows: DataFrame, part: Column, between: str, name: str) -> DataFrame:
    each = rows.select(*KEY, F.struct("index", part.alias("part")).alias("x")).groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    joined = F.array_join(F.transform("xs", lambda x: x["part"]), between)
    return reads.select(*KEY, "name").join(each.select(*KEY, joined.alias(name)), KEY, "left").select(*KEY, "name", F.coalesce(name, F.lit("")).alias(name))


def read_sequences(g: Graph, reads: DataFrame, strict: bool = True) -> DataFrame:
    """file, read_ord, name, seq: the oriented sequences of a read's chunks one after the other."""
    rows = with_sequences(g, chunks(g, reads, strict))
    return _per_read(reads, rows, chunk_sequence(*(F.col(c) for c in ("kind", "seq", "fwd", "start", "end"))), "", "seq")


def read_descriptions(g: Graph, reads: DataFrame, strict: bool = True) -> DataFrame:
    """file, read_ord, name, text: the descriptions of a read's chunks, without anything between them."""
    rows = chunks(g, reads, strict)
    return _per_read(reads, rows, chunk_description(*(F.col(c) for c in ("index", "seg_name", "fwd", "kind", "start", "end", "len"))), "", "text")


def chunk_count(g: Graph, reads: DataFrame, strict: bool = False) -> DataFrame:
    """One row: the chunks of all reads, skipped ones included."""
    return chunks(g, reads, strict).agg(F.count(F.lit(1)).alias("chunks"))


def presence(g: Graph, reads: DataFrame, files: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """file, seg_id, present for every file and segment: whether a read of the file visits the segment.

    `files` (one column, file) may name files without reads. Blank and # lines have no path and count for nothing.
    """
    seen = _resolved(g, read_handles(reads).select("file", "seg_name").distinct(), strict).select("file", "seg_id").distinct().withColumn("present", F.lit(True))
    files = (files if files is not None else reads.select("file")).select("file").distinct()
    # Every file with every segment is the result itself; the files are the few of the two.
    grid = g.segments.select("seg_id").crossJoin(bounded(files))
    return grid.join(seen, ["file", "seg_id"], "left").na.fill(False, ["present"])


def presence_rows(g: Graph, reads: DataFrame, files: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """file and cells, an array of booleans by seg_id."""
    rows = presence(g, reads, files, strict).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seg_id", "present"))).alias("xs"))
    return rows.select("file", F.transform("xs", lambda x: x["present"]).alias("cells"))
