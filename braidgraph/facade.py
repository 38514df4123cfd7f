"""Objects for looking around in a graph: lists of segments, paths, links and steps, and iteration over reads.

Every look-up is a filtered query, so this is for inspection; bulk work belongs to the operators. Objects compare
by the view they come from and their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import accessors, positions, reads
from .plans.graph import Graph
from .sources import gfa_text, tables


@dataclass(frozen=True)
class Segment:
    view: GraphView = field(repr=False)
    id: int
    name: int = field(compare=False)

    def sequence(self) -> str:
        return accessors.at(self.view.graph.segments, "seg_id", self.id).first()["seq"]

    def __len__(self) -> int:
        return accessors.at(self.view.graph.segments, "seg_id", self.id).first()["len"]

    def __str__(self) -> str:
        return gfa_text.segment_lines(self.view.graph).where(F.col("seg_id") == self.id).first()["text"]


@dataclass(frozen=True)
class Handle:
    view: GraphView = field(repr=False)
    seg_id: int
    is_forward: bool

    @property
    def segment(self) -> Segment:
        return self.view.segments[self.seg_id]


@dataclass(frozen=True)
class Link:
    view: GraphView = field(repr=False)
    id: int
    from_: Handle = field(compare=False)
    to: Handle = field(compare=False)

    def __str__(self) -> str:
        return gfa_text.link_lines(self.view.graph).where(F.col("link_id") == self.id).first()["text"]


@dataclass(frozen=True)
class Path:
    view: GraphView = field(repr=False)
    id: int
    name: str = field(compare=False)

    @property
    def steps(self) -> Listed:
        rows = self.view.graph.steps.where(F.col("path_id") == self.id)
        return Listed(rows, "step_idx", lambda r: Handle(self.view, r["seg_id"], r["fwd"]))

    def __iter__(self) -> Iterator[Handle]:
        return iter(self.steps)

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, i):
        return self.steps[i]

    def __str__(self) -> str:
        return gfa_text.path_lines(self.view.graph).where(F.col("path_id") == self.id).first()["text"]


class Listed:
    """Rows numbered from `first`, as a list: len, iteration, index, and slices without a step."""

    def __init__(self, rows: DataFrame, number: str, make, first: int = 0, stop: int | None = None):
        self.rows, self.number, self.make, self.first, self.stop = rows, number, make, first, stop

    def _mine(self) -> DataFrame:
        rows = self.rows.where(F.col(self.number) >= self.first)
        return rows if self.stop is None else rows.where(F.col(self.number) < self.stop)

    def __len__(self) -> int:
        return self._mine().count()

    def __iter__(self):
        return map(self.make, self._mine().orderBy(self.number).toLocalIterator())

    def __getitem__(self, i):
        if isinstance(i, slice):
            start, stop, step = i.indices(len(self))
            if step != 1:
                raise IndexError("slices have no step")
            return Listed(self.rows, self.number, self.make, self.first + start, self.first + max(start, stop))
        row = accessors.at(self._mine(), self.number, self.first + i + (len(self) if i < 0 else 0)).first()
        if row is None:
            raise IndexError(i)
        return self.make(row)


class Segments(Listed):
    def find(self, name: int) -> Segment | None:
        row = self.rows.where(F.col("name") == name).orderBy("seg_id").first()
        return row and self.make(row)


class Paths(Listed):
    def find(self, name: str) -> Path | None:
        row = self.rows.where(F.col("name") == name).orderBy("path_id").first()
        return row and self.make(row)


@dataclass(frozen=True)
class ChunkEvent:
    """One step of a read: range is (first, last) as closed_range has it."""

    handle: Handle
    range: tuple[int, int]
    text: str

    def sequence(self) -> str:
        return self.text


@dataclass(frozen=True)
class Read:
    name: str
    chunks: tuple[ChunkEvent, ...]

    def segment_ranges(self) -> list[tuple[int, int]]:
        return [c.range for c in self.chunks]

    def sequence(self) -> str:
        return "".join(c.text for c in self.chunks)

    def __iter__(self) -> Iterator[ChunkEvent]:
        return iter(self.chunks)


class GraphView:
    def __init__(self, graph: Graph):
        self.graph = graph

    @property
    def segments(self) -> Segments:
        return Segments(self.graph.segments, "seg_id", lambda r: Segment(self, r["seg_id"], r["name"]))

    @property
    def paths(self) -> Paths:
        return Paths(self.graph.paths, "path_id", lambda r: Path(self, r["path_id"], r["name"]))

    @property
    def links(self) -> Listed:
        return Listed(self.graph.links, "link_id", lambda r: Link(self, r["link_id"], Handle(self, r["from_seg"], r["from_fwd"]), Handle(self, r["to_seg"], r["to_fwd"])))

    @property
    def size(self) -> int:
        """Bytes of the flat binary layout."""
        return accessors.total_bytes(self.graph).first()["bytes"]

    def all_reads(self, gaf: str | DataFrame) -> Iterator[Read]:
        """The reads of a GAF file in order, with their chunks; rows pass through the driver a partition at a time."""
        found = tables.read_gaf(self.graph.spark, gaf) if isinstance(gaf, str) else gaf
        low, high = reads.closed_range(*(F.col(c) for c in ("kind", "start", "end", "len")))
        part = reads.chunk_sequence(*(F.col(c) for c in ("kind", "seq", "fwd", "start", "end")))
        whole = reads.chunks(self.graph, found)
        each = whole.join(self.graph.segments.select("seg_id", "seq"), "seg_id").select("file", "read_ord", F.struct("index", "seg_id", "fwd", low.alias("low"), high.alias("high"), part.alias("part")).alias("c"))
        lists = each.groupBy("file", "read_ord").agg(F.array_sort(F.collect_list("c")).alias("cs"))
        for r in found.select("file", "read_ord", "name").join(lists, ["file", "read_ord"], "left").orderBy("file", "read_ord").toLocalIterator():
            yield Read(r["name"], tuple(ChunkEvent(Handle(self, c["seg_id"], c["fwd"]), (c["low"], c["high"]), c["part"]) for c in r["cs"] or ()))

    def gaf_lookup(self, gaf: str) -> Iterator[tuple[str, str]]:
        """Name and sequence of every read."""
        found = reads.read_sequences(self.graph, tables.read_gaf(self.graph.spark, gaf))
        return ((r["name"], r["seq"]) for r in found.orderBy("file", "read_ord").toLocalIterator())

    def pangenotype(self, files: list[str]) -> list[list[bool]]:
        """A row of booleans by segment for each file, in the order of the files."""
        out = []
        for file in files:
            found = tables.read_gaf(self.graph.spark, file, walks_only=True).withColumn("file", F.lit(file))
            row = reads.presence_rows(self.graph, found, self.graph.spark.createDataFrame([(file,)], "file string")).first()
            out.append(list(row["cells"]) if row else [])
        return out

    def write_bundle(self, path: str) -> None:
        tables.write_bundle(self.graph, path)

    def __str__(self) -> str:
        g = self.graph
        return gfa_text.text_of(gfa_text.preserved_lines(g) if g.lines is not None else gfa_text.normalized_lines(g))

    # Plain accessors that answer None instead of raising.

    def segment_count(self) -> int:
        return len(self.segments)

    def segment_sequence(self, i: int) -> str | None:
        row = accessors.at(self.graph.segments, "seg_id", i).first()
        return row and row["seq"]

    def path_count(self) -> int:
        return len(self.paths)

    def path_name(self, i: int) -> str | None:
        row = accessors.at(self.graph.paths, "path_id", i).first()
        return row and row["name"]

    def path_step_count(self, i: int) -> int | None:
        row = accessors.step_counts(self.graph).where(F.col("path_id") == i).first()
        return row and row["n_steps"]

    def path_step(self, i: int, j: int) -> tuple[int, bool] | None:
        row = self.graph.steps.where((F.col("path_id") == i) & (F.col("step_idx") == j)).first()
        return row and (row["seg_id"], row["fwd"])

    def path_sequence(self, name: str) -> str | None:
        row = positions.path_sequences(self.graph).where(F.col("name") == name).first()
        return row and row["seq"]
