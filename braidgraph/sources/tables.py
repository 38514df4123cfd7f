"""BED, GAF and name lists; the Parquet bundle; packed sequences."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import PackedSeq
from ..plans.graph import SCHEMAS, Graph
from .gfa_text import read_gfa
from .text import lines_of, numbered_lines


def _bed(lines: DataFrame, fields: int | None) -> DataFrame:
    rows = lines.where("NOT startswith(value, '#') AND trim(value) <> ''").select("line_no", F.split("value", "\t").alias("f"), "value")
    if fields is not None:
        wrong = F.raise_error(F.concat(F.lit(f"not an interval of {fields} fields: "), F.col("value")))
        rows = rows.withColumn("f", F.when(F.size("f") == fields, F.col("f")).otherwise(wrong.cast("array<string>")))
    out = [F.col("line_no").alias("ord"), F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("end")]
    if fields == 4:
        out.append(F.get("f", F.lit(3)).alias("new_name"))
    return rows.select(*out)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, start, end; lines with # are skipped, more columns ignored."""
    return _bed(numbered_lines(spark, path), None)


def parse_bed(spark: SparkSession, text: str) -> DataFrame:
    return _bed(lines_of(spark, text), None)


def read_injections(spark: SparkSession, path: str) -> list[tuple[str, int, int, str]]:
    """Rows (path, low, high, new name) for inject, in order; exactly four fields a line."""
    rows = _bed(numbered_lines(spark, path), 4).orderBy("ord").collect()
    return [(r["name"], r["start"], r["end"], r["new_name"]) for r in rows]


def read_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a list, one a line, blank lines skipped, in order."""
    rows = numbered_lines(spark, path).select("line_no", F.trim("value").alias("name")).where("name <> ''")
    return [r["name"] for r in rows.orderBy("line_no").collect()]


def _gaf(lines: DataFrame, walks_only: bool = False) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines.where("trim(value) <> '' AND NOT startswith(value, '#')").select("file", F.col("line_no").alias("read_ord"), f.alias("f"), "value")
    if walks_only:
        rows = rows.where(F.size("f") >= 6)
    else:
        bad = F.raise_error(F.concat(F.lit("a read needs nine fields: "), F.col("value"))).cast("array<string>")
        rows = rows.withColumn("f", F.when(F.size("f") >= 9, F.col("f")).otherwise(bad))
    return rows.select("file", "read_ord", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(5)).alias("path"), F.get("f", F.lit(7)).cast("long").alias("start"), F.get("f", F.lit(8)).cast("long").alias("end"))


def read_gaf(spark: SparkSession, paths: str | list[str], walks_only: bool = False) -> DataFrame:
    """file, read_ord, name, path, start, end of the reads of one or more files.

    Blank and # lines are skipped; any other with fewer than nine fields is an error. walks_only: for the presence
    matrix, which reads the sixth field; six fields do (start and end are null then), lines with fewer are skipped.
    """
    return _gaf(numbered_lines(spark, paths), walks_only)


def parse_gaf(spark: SparkSession, text: str, file: str = "", walks_only: bool = False) -> DataFrame:
    return _gaf(lines_of(spark, text), walks_only).withColumn("file", F.lit(file))


def write_bundle(g: Graph, path: str) -> None:
    """The tables as Parquet folders; steps are clustered by path, as most queries walk paths."""
    n = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    for name in SCHEMAS:
        table = getattr(g, name)
        if table is not None:
            if name == "steps":
                table = table.repartitionByRange(n, "path_id", "step_idx").sortWithinPartitions("path_id", "step_idx")
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str) -> Graph:
    """The graph of a bundle; nothing is parsed, and queries read the columns they need."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    has_lines = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lines"))
    return Graph(**{k: spark.read.schema(s).parquet(f"{path}/{k}") for k, s in SCHEMAS.items() if k != "lines" or has_lines})


BUNDLE_SUFFIX = ".bundle"


def load(spark: SparkSession, path: str, mode: str = "lenient") -> Graph:
    """A bundle, or a text file, or the bundle beside a text file if that is there and not older."""
    if path.endswith(BUNDLE_SUFFIX):
        return read_bundle(spark, path)
    beside = path.removesuffix(".gz").removesuffix(".gfa") + BUNDLE_SUFFIX
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(beside)
    fs = where.getFileSystem(conf)
    if fs.exists(where) and fs.getFileStatus(where).getModificationTime() >= fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(path)).getModificationTime():
        return read_bundle(spark, beside)
    return read_gfa(spark, path, mode)


def export_sequence(text_path: str, packed_path: str) -> int:
    """Pack the nucleotides of a text file, white space aside; returns the number of bases."""
    with open(text_path) as f:
        seq = PackedSeq("".join(f.read().split()))
    with open(packed_path, "wb") as f:
        f.write(seq.to_bytes())
    return len(seq)


def import_sequence(packed_path: str) -> str:
    """The nucleotides of a packed file."""
    if os.path.getsize(packed_path) == 0:
        raise ValueError("not a packed sequence")
    with open(packed_path, "rb") as f:
        return str(PackedSeq.from_bytes(f.read()))
