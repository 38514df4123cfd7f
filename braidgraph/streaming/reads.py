"""Extension: reads that arrive as files in a folder, as a stream.

The batch operators need no streaming; this counts read visits by segment while files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import Graph

LINE = T.StructType([T.StructField("value", T.StringType())])


def stream_reads(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """name, path, start, end of the reads of every GAF file that appears in a folder."""
    lines = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_a_batch).text(folder)
    f = F.split("value", "\t")
    rows = lines.where("trim(value) <> '' AND NOT startswith(value, '#')").select(f.alias("f")).where(F.size("f") >= 9)
    return rows.select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(5)).alias("path"), F.get("f", F.lit(7)).cast("long").alias("start"), F.get("f", F.lit(8)).cast("long").alias("end"))


def visits(g: Graph, stream: DataFrame) -> DataFrame:
    """seg_id and visits so far: the state is one count a segment, however many reads come."""
    steps = stream.select(F.explode(F.regexp_extract_all("path", F.lit("[<>]([0-9]+)"), F.lit(1))).alias("seg_name"))
    named = steps.select(F.col("seg_name").cast("long").alias("seg_name")).join(g.segments.select("seg_id", F.col("name").alias("seg_name")), "seg_name")
    return named.groupBy("seg_id").agg(F.count(F.lit(1)).alias("visits"))
