"""Graphs from graphs: chop, crush, flip, inject, flatten, and small edits."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import bounded, checkpointed, numbered, sums_before, sums_within
from ..plans.graph import CIGAR, Graph, empty
from .links import ENDS, step_pairs
from .positions import positioned

#: Numbers that a sample draws at a time.
DRAWS = 1 << 16


def drop_overlaps(g: Graph) -> Graph:
    return g.with_tables(paths=g.paths.withColumn("overlaps", F.lit(None).cast(f"array<{CIGAR.simpleString()}>")))


def crush(g: Graph) -> Graph:
    """Runs of N become one N within each segment; path overlaps go, links stay."""
    seq = F.regexp_replace("seq", "N+", "N")
    return drop_overlaps(g).with_tables(segments=g.segments.withColumn("seq", seq).withColumn("len", F.length("seq").cast("long")))


def _cut(g: Graph, pieces: DataFrame) -> Graph:
    """The graph with every segment replaced by its pieces: seg_id, cuts (sorted inner offsets; null keeps it whole),
    and dropped (no piece at all). New names count from 1 in order."""
    n = F.when(F.col("dropped"), 0).otherwise(F.size("cuts") + 1)
    spans = sums_before(pieces.withColumn("n", n.cast("long")), "seg_id", F.col("n"), "first")
    rows = spans.join(g.segments.select("seg_id", "seq", "len"), "seg_id")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"), F.array(F.col("len")))
    rows = rows.where("n > 0").select("seg_id", "first", "n", "seq", edges.alias("edges"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("piece"))
    start, end = F.get("edges", F.col("piece")), F.get("edges", F.col("piece") + 1)
    new_id = F.col("first") + F.col("piece")
    segments = rows.select(new_id.alias("seg_id"), (new_id + 1).alias("name"), F.substr("seq", (start + 1).cast("int"), (end - start).cast("int")).alias("seq"), (end - start).alias("len"), F.lit("").alias("optional"))

    # A step on n pieces becomes n steps; where they begin on the path is a running sum.
    steps = g.steps.join(spans.select("seg_id", "first", "n"), "seg_id").where("n > 0")
    steps = sums_within(steps, "path_id", "step_idx", {"at": F.col("n")}, g.longest).select("path_id", "at", "first", "n", "fwd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("piece"))
    new_seg = F.when(F.col("fwd"), F.col("first") + F.col("piece")).otherwise(F.col("first") + F.col("n") - 1 - F.col("piece"))
    steps = steps.select("path_id", (F.col("at") + F.col("piece")).alias("step_idx"), new_seg.alias("seg_id"), "fwd")
    return drop_overlaps(g).with_tables(segments=segments, steps=steps, links=empty(g.spark, "links")), spans.select("seg_id", "first", "n")


def chop(g: Graph, size: int, with_links: bool = False, drop_empty: bool = False) -> Graph:
    """Segments cut into pieces of at most `size`, numbered anew from 1; tags and overlaps go.

    A segment of length 0 keeps one piece, or with drop_empty none. With links, the pieces of a segment are
    joined in order, and old links join the ends of their segments' pieces that they joined before.
    """
    if size < 1:
        raise ValueError("pieces need at least one base pair")
    inner = F.when(F.col("len") > size, F.sequence(F.lit(size).cast("long"), F.col("len") - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    pieces = g.segments.select("seg_id", inner.alias("cuts"), ((F.col("len") == 0) & F.lit(drop_empty)).alias("dropped"))
    out, spans = _cut(g, pieces)
    return out.with_tables(links=_chopped_links(g, spans)) if with_links else out


def _chopped_links(g: Graph, spans: DataFrame) -> DataFrame:
    none = F.array().cast(CIGAR.simpleString()).alias("overlap")
    # Links inside a segment come first, by piece; then the old ones.
    inside = spans.where("n > 1").select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2)).alias("piece"))
    inside = inside.select(F.lit(0).alias("part"), (F.col("first") + F.col("piece")).alias("ord"), (F.col("first") + F.col("piece")).alias("from_seg"), F.lit(True).alias("from_fwd"), (F.col("first") + F.col("piece") + 1).alias("to_seg"), F.lit(True).alias("to_fwd"))
    def side(end: str) -> DataFrame:
        return spans.select(F.col("seg_id").alias(f"{end}_seg"), F.col("first").alias(f"{end}_first"), (F.col("first") + F.col("n") - 1).alias(f"{end}_last"))

    old = g.links.join(side("from"), "from_seg").join(side("to"), "to_seg")
    old = old.select(F.lit(1).alias("part"), F.col("link_id").alias("ord"), F.when(F.col("from_fwd"), F.col("from_last")).otherwise(F.col("from_first")).alias("from_seg"), "from_fwd", F.when(F.col("to_fwd"), F.col("to_first")).otherwise(F.col("to_last")).alias("to_seg"), "to_fwd")
    rows = numbered(inside.unionByName(old), "link_id", F.col("part"), F.col("ord"))
    return rows.select("link_id", *ENDS, none)


def flipped_paths(g: Graph) -> DataFrame:
    """path_id, name, flips (whether a path has more base pairs backward than forward) and n_steps."""
    lead = F.sum(F.when(F.col("fwd"), F.col("len")).otherwise(-F.col("len")))
    sums = g.steps.join(g.segments.select("seg_id", "len"), "seg_id").groupBy("path_id").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n_steps"))
    return g.paths.select("path_id", "name").join(sums, "path_id", "left").select("path_id", "name", F.coalesce(F.col("lead") < 0, F.lit(False)).alias("flips"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def deduplicated_links(links: DataFrame, order: list[str]) -> DataFrame:
    """The first of links that are equal, read from either strand, overlap included."""
    own = F.struct("from_seg", "from_fwd", "to_seg", "to_fwd")
    other = F.struct(F.col("to_seg"), ~F.col("to_fwd"), F.col("from_seg"), ~F.col("from_fwd"))
    first = Window.partitionBy("link_key", "overlap").orderBy(*order)
    rows = links.withColumn("link_key", F.least(own, other.cast("struct<from_seg:bigint,from_fwd:boolean,to_seg:bigint,to_fwd:boolean>")))
    return rows.withColumn("link_place", F.row_number().over(first)).where("link_place = 1").drop("link_place", "link_key")


def flip(g: Graph) -> Graph:
    """Paths with more base pairs backward than forward are turned round and renamed with _inv; all paths
    lose their overlaps; the links that turned paths need are added after the old ones, duplicates dropped."""
    turned = flipped_paths(g)
    steps = g.steps.join(turned.select("path_id", "flips", "n_steps"), "path_id")
    steps = steps.select("path_id", F.when(F.col("flips"), F.col("n_steps") - 1 - F.col("step_idx")).otherwise(F.col("step_idx")).alias("step_idx"), "seg_id", (F.col("fwd") != F.col("flips")).alias("fwd"), "flips")
    from ..sources.gfa_text import path_key

    # Turned paths keep the place of their old names in canonical text.
    paths = drop_overlaps(g).paths.join(turned.select("path_id", "flips"), "path_id").withColumn("sort_name", path_key(g.paths)).withColumn("name", F.when(F.col("flips"), F.concat("name", F.lit("_inv"))).otherwise(F.col("name"))).drop("flips")
    needed = step_pairs(steps.where("flips"), g.longest).select(F.lit(1).alias("part"), F.col("path_id").alias("a"), F.col("step_idx").alias("b"), *ENDS, F.array(F.struct(F.lit(0).alias("len"), F.lit("M").alias("op"))).alias("overlap"))
    old = g.links.select(F.lit(0).alias("part"), F.col("link_id").alias("a"), F.lit(0).cast("long").alias("b"), *ENDS, same_overlap(F.col("overlap")).alias("overlap"))
    links = numbered(deduplicated_links(old.unionByName(needed), ["part", "a", "b"]), "link_id", F.col("part"), F.col("a"), F.col("b"))
    return g.with_tables(paths=paths, steps=steps.drop("flips"), links=links.select("link_id", *ENDS, "overlap"), longest=g.longest)


def same_overlap(overlap: Column) -> Column:
    """An overlap without operations is the one of no length, 0M."""
    return F.when(F.coalesce(F.size(overlap), F.lit(0)) == 0, F.array(F.struct(F.lit(0).alias("len"), F.lit("M").alias("op")))).otherwise(overlap)


def _source_rows(bed: list[tuple[str, int, int, str]], names: set[str]) -> list[tuple[int, str, int, int, str]]:
    """Rows with a known path, those on a path injected before rewritten to the path that it came from.

    A later row of the same new name replaces the earlier path, as does one named like an existing path.
    """
    origin: dict[str, tuple[str, int, int]] = {}
    out = []
    for i, (name, low, high, new) in enumerate(bed):
        if name in origin:
            source, offset, end = origin[name]
            row = (i, source, min(offset + low, end), min(offset + high, end), new)
        elif name in names:
            row = (i, name, low, high, new)
        else:
            continue
        out.append(row)
        origin[new] = (row[1], row[2], row[3])
    return out


def inject(g: Graph, bed: list[tuple[str, int, int, str]]) -> Graph:
    """For each row (path, low, high, new name) the segments of a path are cut at low and high, and a new path
    of the steps in between is added; rows of unknown paths do nothing; links are dropped.

    Places on a path don't change when segments are cut, so all cuts are made at once.
    """
    wanted = sorted({r[0] for r in bed})
    known = {r["name"] for r in g.paths.where(F.col("name").isin(wanted)).select("name").collect()} if wanted else set()
    rows = _source_rows(bed, known)
    asked = g.spark.createDataFrame(rows, "ord long, name string, low long, high long, new string").join(g.paths.select("path_id", "name"), "name")
    few = bounded(asked.select("path_id").distinct())
    touched = g.steps.join(few, "path_id", "left_semi")
    spans = positioned(g, touched)
    points = asked.select("path_id", F.explode(F.array("low", "high")).alias("point")).distinct()
    hit = spans.join(bounded(points), "path_id").where("pos < point AND point < pos + len")
    cuts = hit.select("seg_id", F.when(F.col("fwd"), F.col("point") - F.col("pos")).otherwise(F.col("len") - (F.col("point") - F.col("pos"))).alias("cut")).groupBy("seg_id").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    pieces = g.segments.select("seg_id").join(cuts, "seg_id", "left").select("seg_id", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"), F.lit(False).alias("dropped"))
    # The new steps are walked again: computed once.
    out, _ = _cut(g, checkpointed(pieces))
    out = out.with_tables(segments=checkpointed(out.segments), steps=checkpointed(out.steps))

    inside = positioned(out, out.steps.join(few, "path_id", "left_semi")).join(bounded(asked.select("path_id", "ord", "low", "high")), "path_id").where("low <= pos AND pos + len <= high")
    last = g.paths.agg(F.coalesce(F.max("path_id") + 1, F.lit(0)).alias("first_new"))
    order = Window.partitionBy("ord").orderBy("step_idx")
    new_steps = inside.join(F.broadcast(last)).select((F.col("first_new") + F.col("ord")).alias("path_id"), (F.row_number().over(order) - 1).cast("long").alias("step_idx"), "seg_id", "fwd")
    new_paths = asked.join(F.broadcast(last)).select((F.col("first_new") + F.col("ord")).alias("path_id"), F.col("new").alias("name"), F.lit(None).cast(f"array<{CIGAR.simpleString()}>").alias("overlaps"))
    return out.with_tables(paths=out.paths.unionByName(new_paths, allowMissingColumns=True), steps=out.steps.unionByName(new_steps))


def fasta_places(g: Graph) -> DataFrame:
    """seg_id, start, end of each segment in the concatenation of all segments."""
    rows = sums_before(g.segments.select("seg_id", "len"), "seg_id", F.col("len"), "start")
    return rows.select("seg_id", "start", (F.col("start") + F.col("len")).alias("end"))


def flatten_bed(g: Graph, name: str) -> DataFrame:
    """name, start, end, path_name, strand, rank (and path_id): the steps as intervals of the concatenation."""
    rows = g.steps.join(fasta_places(g), "seg_id").join(g.paths.select("path_id", F.col("name").alias("path_name")), "path_id")
    return rows.select("path_id", F.lit(name).alias("name"), "start", "end", "path_name", F.when(F.col("fwd"), "+").otherwise("-").alias("strand"), F.col("step_idx").alias("rank"))


def fasta_lines(g: Graph, width: int = 80) -> DataFrame:
    """line_no and text of the concatenation cut into lines: each segment sends its parts to the lines they are in."""
    rows = g.segments.select("seg_id", "seq").join(fasta_places(g), "seg_id").where("end > start")
    rows = rows.select("seq", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("line_no"))
    low, high = F.greatest("start", F.col("line_no") * width), F.least(F.col("end"), (F.col("line_no") + 1) * width)
    part = F.substr("seq", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    parts = rows.select("line_no", F.struct("start", part.alias("part")).alias("x")).groupBy("line_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select("line_no", F.array_join(F.transform("xs", lambda x: x["part"]), "").alias("text"))


def some_paths(g: Graph, drop_percent: int, seed: int = 4) -> Graph:
    """The graph without a share of its paths, drawn like Python's generator draws from the names in order."""
    wanted = sampled_names(g, drop_percent, seed).select("name")
    paths = g.paths.join(wanted, "name", "left_semi").select(*g.paths.columns)
    return g.with_tables(paths=paths, steps=g.steps.join(paths.select("path_id"), "path_id", "left_semi"))


def sampled_names(g: Graph, drop_percent: int, seed: int = 4) -> DataFrame:
    """ord, name: the names that some_paths keeps, in the order of the draw; all of them in order if nothing is dropped."""
    names = numbered(g.paths.select("path_id", "name"), "place", F.col("path_id")).select("place", "name")
    if drop_percent <= 0:
        return names.select(F.col("place").alias("ord"), "name").orderBy("ord")
    n = names.count()
    drawn = sampled_places(g.spark, n, int((100 - drop_percent) / 100 * n), seed)
    return drawn.join(names, "place").select("ord", "name").orderBy("ord")


def sampled_places(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """ord, place: what random.Random(seed).sample(range(n), k) returns, without a list of n or k anywhere.

    One task draws the numbers, which follow from each other, and passes them on in blocks; where they lead is worked out
    by joins. For a large share, Python keeps a pool of the places: draw i takes what is at its number and puts the pool's
    last one, of n - 1 - i, there. So a draw takes its own number, or what the last draw of that number before it put
    there; and that is n - 1 - i, or what the last draw of that number had put there.
    """
    if not 0 <= k <= n:
        raise ValueError("sample larger than the paths, or negative")
    pooled = n <= 21 + (4 ** math.ceil(math.log(k * 3, 4)) if k > 5 else 0)

    def numbers():
        below = random.Random(seed).randrange
        if pooled:
            yield from (below(n - i) for i in range(k))
            return
        seen, left = bytearray(n // 8 + 1), k
        while left:
            j = below(n)
            if not seen[j >> 3] >> (j & 7) & 1:
                seen[j >> 3] |= 1 << (j & 7)
                left -= 1
                yield j

    def draws(batches):
        import pyarrow as pa

        for _ in batches:
            found, first = numbers(), 0
            while block := list(itertools.islice(found, DRAWS)):
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(block)), pa.int64()), pa.array(block, pa.int64())], names=["ord", "place"])
                first += len(block)

    drawn = spark.range(0, 1, 1, 1).mapInArrow(draws, "ord long, place long")
    if not pooled:
        return drawn
    same = Window.partitionBy("place")
    put = n - 1 - F.col("ord")
    drawn = drawn.withColumns({"before": F.lag("ord").over(same.orderBy("ord")), "last": F.max(F.when(F.col("place") < put, F.col("ord"))).over(same)})
    drawn = checkpointed(drawn)
    # Of draws that put something else than n - 1 - ord: the draw that had put that there. Each round doubles the way.
    ways = checkpointed(drawn.where("before IS NULL AND last IS NOT NULL").select((n - 1 - F.col("place")).alias("by"), F.col("last").alias("origin")).where(F.col("by") < k))
    while True:
        further = ways.select(F.col("by").alias("origin"), F.col("origin").alias("further"))
        ways = checkpointed(ways.select("by", "origin").join(further, "origin", "left").select("by", F.coalesce("further", "origin").alias("origin"), F.col("further").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            break
    ways = ways.select(F.col("by").alias("before"), "origin")
    # A null joins nothing and would gather the first draws of all numbers in one task.
    first = drawn.where("before IS NULL").select("ord", "place")
    later = drawn.where("before IS NOT NULL").join(ways, "before", "left").select("ord", (n - 1 - F.coalesce("origin", "before")).alias("place"))
    return first.unionByName(later)


def hashed_paths(g: Graph, drop_percent: int, seed: int = 4) -> Graph:
    """Like some_paths, with each path kept or dropped by a hash of its name: other paths, but no draws that follow from each other."""
    paths = g.paths.where(F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(100)) >= drop_percent)
    return g.with_tables(paths=paths, steps=g.steps.join(paths.select("path_id"), "path_id", "left_semi"))


def drop_some_links(g: Graph, keep_percent: int = 10, seed: int = 4) -> Graph:
    """The graph with a share of its links, drawn by Python's generator over the links in the order of their text.

    The links' ends pass through the driver: a helper that prepares broken graphs for tests.
    """
    from ..sources.gfa_text import link_lines

    texts = sorted((r["text"], r["link_id"]) for r in link_lines(g, canonical=True).select("text", "link_id").collect())
    kept = random.Random(seed).sample(texts, int(keep_percent / 100 * len(texts)))
    wanted = g.spark.createDataFrame([(i,) for _, i in kept], "link_id long")
    return g.with_tables(links=g.links.join(wanted, "link_id", "left_semi"))


def random_bed(g: Graph, seed: int = 4) -> list[tuple[str, int, int, str]]:
    """Up to five random sub-intervals of each path, none of an empty one: rows for inject."""
    from .depth import path_length

    draw, out = random.Random(seed), []
    for r in path_length(g).orderBy("path_id").collect():
        for i in range(draw.randint(0, 5)):
            if r["length"] < 1:
                continue  # an empty path has no sub-interval
            low = draw.randint(0, r["length"] - 1)
            out.append((r["name"], low, draw.randint(low + 1, r["length"]), f"{r['name']}_{i}"))
    return out
