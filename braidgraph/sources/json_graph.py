"""The JSON exchange form of a graph, with the padded tables that a depth accelerator reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import cigar_text, ints_to_nucleotides, ints_to_path, link_to_list, nucleotides_to_ints, path_to_ints
from ..operators.accessors import graph_maxes
from ..operators.depth import crossings
from ..plans.graph import Graph
from .gfa_text import parse_gfa


def segment_codes(g: Graph) -> DataFrame:
    """seg_id, name, codes."""
    return g.segments.select("seg_id", "name", nucleotides_to_ints(F.col("seq")).alias("codes"))


def path_codes(g: Graph) -> DataFrame:
    """path_id, name, codes, overlaps (as text)."""
    steps = g.steps.join(g.segments.select("seg_id", F.col("name").alias("seg_name")), "seg_id")
    walks = steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("step_idx", F.col("seg_name").alias("name"), "fwd"))).alias("walk"))
    laps = F.when(F.coalesce(F.size("overlaps"), F.lit(0)) > 0, F.array_join(F.transform("overlaps", cigar_text), ",")).otherwise("*")
    return g.paths.join(walks, "path_id", "left").select("path_id", "name", F.coalesce(path_to_ints(F.col("walk")), F.array().cast("array<bigint>")).alias("codes"), laps.alias("laps"))


def link_codes(g: Graph) -> DataFrame:
    """link_id and codes, five texts."""
    names = g.segments.select("seg_id", "name")
    rows = g.links.join(names.withColumnsRenamed({"seg_id": "from_seg", "name": "a"}), "from_seg").join(names.withColumnsRenamed({"seg_id": "to_seg", "name": "b"}), "to_seg")
    return rows.select("link_id", link_to_list(F.col("a"), F.col("from_fwd"), F.col("b"), F.col("to_fwd"), F.col("overlap")).alias("codes"))


def depth_tables(g: Graph, max_e: int) -> DataFrame:
    """seg_id, name, path_ids: the paths (from 1) of the steps on each segment, padded with zeros to max_e."""
    ids = F.transform("steps", lambda x: x["path_id"] + 1)
    pad = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(max_e) - F.size("steps"), F.lit(0)))
    return crossings(g).select("seg_id", "name", F.concat(ids, pad).alias("path_ids"))


class GraphTooBigError(ValueError):
    """A graph exceeds the dimensions that were asked for."""


#: Dimensions of the accelerator where none are given: nodes, steps a node, paths. Fixed values.
DEFAULT_DIMENSIONS = (16, 15, 15)


def dimensions(g: Graph, max_n: int | None = None, max_e: int | None = None, max_p: int | None = None, auto: bool = True) -> tuple[int, int, int]:
    """Explicit dimensions first, then the graph's own, or with auto=False the defaults; too small ones are an error."""
    own = graph_maxes(g).first()
    own = (own["max_n"], own["max_e"], own["max_p"])
    chosen = tuple(given or (o if auto else d) for given, o, d in zip((max_n, max_e, max_p), own, DEFAULT_DIMENSIONS, strict=True))
    if any(c < o for c, o in zip(chosen, own, strict=True)):
        raise GraphTooBigError(f"the graph needs {own}, given {chosen}")
    return chosen


def _format(width: int) -> dict:
    return {"is_signed": False, "numeric_type": "bitnum", "width": width}


def depth_object(g: Graph, max_n: int | None = None, max_e: int | None = None, max_p: int | None = None, subset: list[str] | None = None) -> dict:
    """The depth part of the JSON form, on the driver: meant for graphs that fit an accelerator."""
    n, e, p = dimensions(g, max_n, max_e, max_p)
    considered = [0] + [1] * p
    if subset:
        ids = {r["name"]: r["path_id"] + 1 for r in g.paths.where(F.col("name").isin(subset)).collect()}
        considered = [0] * (p + 1)
        for name in subset:
            considered[ids[name]] = 1
    out = {"depth_output": {"data": [0] * n, "format": _format(e.bit_length())}, "uniq_output": {"data": [0] * n, "format": _format(p.bit_length())}}
    rows = depth_tables(g, e).collect()
    for r in rows:
        out[f"path_ids{r['name']}"] = {"data": list(r["path_ids"]), "format": _format(p.bit_length())}
    for i in range(len(rows) + 1, n + 1):
        out[f"path_ids{i}"] = {"data": [0] * e, "format": _format(p.bit_length())}
    for i in range(1, n + 1):
        out[f"paths_to_consider{i}"] = {"data": considered, "format": _format(1)}
    return out


def graph_object(g: Graph) -> dict:
    """The basic part of the JSON form, on the driver."""
    out: dict = {"headers": [f"H\t{r['text']}" for r in g.headers.orderBy("ord").collect()]}
    out |= {f"seg_to_seq_{r['name']}": list(r["codes"]) for r in segment_codes(g).orderBy("seg_id").toLocalIterator()}
    out["links"] = [[*map(int, r["codes"][:4]), r["codes"][4]] for r in link_codes(g).orderBy("link_id").toLocalIterator()]
    out |= {f"path_details_{r['name']}": {"segments": list(r["codes"]), "overlaps": r["laps"]} for r in path_codes(g).orderBy("path_id").toLocalIterator()}
    return out


def dump(g: Graph, **sizes) -> str:
    return json.dumps({"basic": graph_object(g), "depth": depth_object(g, **sizes)}, indent=2, sort_keys=True)


def load(spark: SparkSession, text: str) -> Graph:
    """The graph of the basic part; names may hold any character."""
    basic = json.loads(text)["basic"]
    segments = [(k.removeprefix("seg_to_seq_"), v) for k, v in basic.items() if k.startswith("seg_to_seq_")]
    paths = [(k.removeprefix("path_details_"), v["segments"], v["overlaps"]) for k, v in basic.items() if k.startswith("path_details_")]
    lines = list(basic["headers"])
    decoded = spark.createDataFrame(segments, "name string, codes array<int>").select("name", ints_to_nucleotides(F.col("codes")).alias("seq")) if segments else None
    lines += [f"S\t{r['name']}\t{r['seq']}" for r in decoded.toLocalIterator()] if segments else []
    walks = spark.createDataFrame(paths, "name string, codes array<long>, laps string").select("name", ints_to_path(F.col("codes")).alias("walk"), "laps") if paths else None
    lines += [f"P\t{r['name']}\t{r['walk']}\t{r['laps']}" for r in walks.toLocalIterator()] if paths else []
    lines += [f"L\t{a}\t{'-' if fa else '+'}\t{b}\t{'-' if fb else '+'}\t{lap}" for a, fa, b, fb, lap in basic["links"]]
    return parse_gfa(spark, "\n".join(lines) + "\n")
