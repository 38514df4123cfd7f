"""Numbered lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import BROADCAST_ROWS


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (dense, from 0 within each file) and value. Compressed files are read by their suffix.

    Each input split numbers its own lines; the splits' counts, one row a split, give the offsets. The last line
    counts whether or not it ends.
    """
    text = spark.read.text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # One row a split; the plan knows how many there can be before anything is read.
    if len(text.inputFiles()) + text._jdf.queryExecution().toRdd().getNumPartitions() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("id") - F.col("first")).alias("line_no"), "value")


def lines_of(spark: SparkSession, text: str | bytes) -> DataFrame:
    """The lines of a text in memory, with numbers."""
    text = text.decode("utf-8") if isinstance(text, bytes) else text
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return spark.createDataFrame([("", i, line.rstrip("\r")) for i, line in enumerate(lines)], "file string, line_no long, value string")


def line_count(spark: SparkSession, path: str, terminated_only: bool = True) -> int:
    """Lines of a file; as a byte count of line feeds, an unterminated last line doesn't count."""
    if not terminated_only:
        return spark.read.text(path).count()
    return spark.read.option("lineSep", "\n").text(path).count() - _open_ended(spark, path)


def _open_ended(spark: SparkSession, path: str) -> int:
    """1 if a file has bytes after its last line feed, read from its end; 0 for a compressed file, whose lines all count."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    size = fs.getFileStatus(where).getLen()
    if size == 0 or jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where) is not None:
        return 0
    stream = fs.open(where)
    try:
        stream.seek(size - 1)
        return int(stream.read() != 10)
    finally:
        stream.close()
