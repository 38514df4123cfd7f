"""The graph: a bundle of lazily evaluated tables with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CIGAR = T.ArrayType(T.StructType([T.StructField("len", T.IntegerType()), T.StructField("op", T.StringType())]))

HEADERS = T.StructType([T.StructField("ord", T.LongType()), T.StructField("text", T.StringType())])
SEGMENTS = T.StructType([T.StructField("seg_id", T.LongType()), T.StructField("name", T.LongType()), T.StructField("seq", T.StringType()), T.StructField("len", T.LongType()), T.StructField("optional", T.StringType())])
PATHS = T.StructType([T.StructField("path_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("overlaps", T.ArrayType(CIGAR))])
STEPS = T.StructType([T.StructField("path_id", T.LongType()), T.StructField("step_idx", T.LongType()), T.StructField("seg_id", T.LongType()), T.StructField("fwd", T.BooleanType())])
LINKS = T.StructType([T.StructField("link_id", T.LongType()), T.StructField("from_seg", T.LongType()), T.StructField("from_fwd", T.BooleanType()), T.StructField("to_seg", T.LongType()), T.StructField("to_fwd", T.BooleanType()), T.StructField("overlap", CIGAR)])
LINES = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ord", T.LongType())])

SCHEMAS = {"headers": HEADERS, "segments": SEGMENTS, "paths": PATHS, "steps": STEPS, "links": LINKS, "lines": LINES}


@dataclass(frozen=True)
class Graph:
    """Segments and links are the graph, paths and steps its walks; lines remembers the order of a text file.

    seg_id, path_id and link_id count from 0 in file order; step_idx counts from 0 along a path.
    A handle is the pair (seg_id, fwd). longest is a bound of the steps on a path, where one is known: walks along
    short paths need no second level of sums. Nothing depends on it but plans.
    """

    headers: DataFrame
    segments: DataFrame
    paths: DataFrame
    steps: DataFrame
    links: DataFrame
    lines: DataFrame | None = None
    longest: int | None = None

    @property
    def spark(self):
        return self.segments.sparkSession

    def with_tables(self, **tables) -> Graph:
        """The graph with some tables replaced; a changed graph has no line order."""
        return replace(self, **({"lines": None} | ({"longest": None} if "steps" in tables else {}) | tables))

    def cached(self) -> Graph:
        """Keep the tables in executor memory: for several operators on one graph."""
        tables = {k: getattr(self, k).cache() for k in SCHEMAS if getattr(self, k) is not None}
        return replace(self, **tables)


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
