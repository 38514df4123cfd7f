"""The registered queries over the graph derived from the star-schema tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packing, sequences
from ..functions.prefix import numbered, sums_before
from ..operators import accessors, depth, extract, links, positions, reads, transforms
from ..sources import gfa_text, json_graph
from .graph import Graph
from .star_graph import SQL, handle_names, star_graph, star_intervals, star_reads, star_stays

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a graph under its name, with SQL over the tables of star_graph.SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(star_graph(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[f.__name__] = "WITH " + SQL.strip().rstrip(",") + "\n" + sql
        return f

    return add


#: Paths that are asked for by name, and the one whose neighbourhood is extracted.
SOME = ["o3", "o1", "no-such-path", "o20", "o3"]
SOME_SQL = "(VALUES (0, 'o3'), (1, 'o1'), (2, 'no-such-path'), (3, 'o20'), (4, 'o3')) AS a(ord, name)"


# Aggregations


@query("SELECT s.seg_id, s.name, coalesce(depth, 0) AS depth, coalesce(uniq, 0) AS uniq FROM segments s LEFT JOIN depths USING (seg_id)")
def segment_depth(g: Graph, spark, sf_dir):
    return depth.segment_depth(g)


@query("SELECT s.seg_id, s.name, coalesce(depth, 0) AS depth FROM segments s LEFT JOIN depths USING (seg_id)")
def segment_depth_only(g: Graph, spark, sf_dir):
    return depth.segment_depth_only(g)


@query("SELECT s.seg_id, s.name, count(t.path_id) AS depth, count(DISTINCT t.path_id) AS uniq FROM segments s LEFT JOIN (SELECT * FROM steps JOIN paths USING (path_id) WHERE paths.name IN ('o3', 'o1', 'o20')) t ON t.seg_id = s.seg_id GROUP BY ALL")
def segment_depth_subset(g: Graph, spark, sf_dir):
    return depth.segment_depth(g, SOME)


_PATH_DEPTH = "SELECT p.path_id, p.name, CAST(coalesce(sum(x.len), 0) AS BIGINT) AS length, CAST(coalesce(sum(x.len * d.depth), 0) AS BIGINT) AS weighted, CAST(coalesce(sum(x.len * d.depth), 0) AS DOUBLE) / nullif(CAST(sum(x.len) AS DOUBLE), 0) AS mean_depth"


def _nan_to_null(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.when(~F.isnan(name), F.col(name)))


@query(f"{_PATH_DEPTH} FROM paths p LEFT JOIN spans x USING (path_id) LEFT JOIN depths d USING (seg_id) GROUP BY ALL")
def path_depth(g: Graph, spark, sf_dir):
    return _nan_to_null(depth.path_depth(g), "mean_depth")


@query(f"{_PATH_DEPTH}, CAST(a.ord AS BIGINT) AS ord FROM {SOME_SQL} JOIN paths p USING (name) LEFT JOIN spans x USING (path_id) LEFT JOIN depths d USING (seg_id) GROUP BY a.ord, p.path_id, p.name")
def path_depth_named(g: Graph, spark, sf_dir):
    return _nan_to_null(depth.path_depth(g, SOME), "mean_depth")


@query("SELECT path_id, name, length FROM lengths")
def path_length(g: Graph, spark, sf_dir):
    return depth.path_length(g)


@query("SELECT path_id AS ord, name, CAST(0 AS BIGINT) AS start, length AS \"end\" FROM lengths")
def paths_as_bed(g: Graph, spark, sf_dir):
    return depth.as_bed(depth.path_length(g))


@query("SELECT (SELECT CAST(sum(len) AS BIGINT) FROM segments) AS length, (SELECT count(*) FROM segments) AS nodes, (SELECT count(*) FROM links) AS edges, (SELECT count(*) FROM paths) AS paths, (SELECT count(*) FROM steps) AS steps")
def graph_stats(g: Graph, spark, sf_dir):
    return accessors.graph_stats(g)


@query('SELECT count(*) AS total, count(DISTINCT from_seg) AS "unique" FROM links WHERE from_seg = to_seg')
def self_loops(g: Graph, spark, sf_dir):
    return accessors.self_loops(g)


@query("SELECT s.seg_id, s.name, count(e.seg) AS degree FROM segments s LEFT JOIN (SELECT from_seg AS seg FROM links UNION ALL SELECT to_seg FROM links) e ON e.seg = s.seg_id GROUP BY ALL")
def degree(g: Graph, spark, sf_dir):
    return accessors.degree(g)


@query("SELECT (SELECT count(*) FROM segments) AS max_n, (SELECT max(depth) FROM depths) AS max_e, (SELECT count(*) FROM paths) AS max_p")
def graph_maxes(g: Graph, spark, sf_dir):
    return accessors.graph_maxes(g)


_TOC = "SELECT 'header' AS pool, CAST(8 AS BIGINT) AS size UNION ALL SELECT 'segs', count(*) FROM segments UNION ALL SELECT 'paths', count(*) FROM paths UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'steps', count(*) FROM steps UNION ALL SELECT 'seq_data', CAST(sum(len) AS BIGINT) FROM segments UNION ALL SELECT 'overlaps', 0 UNION ALL SELECT 'alignment', 0 UNION ALL SELECT 'name_data', CAST(sum(length(name)) AS BIGINT) FROM paths UNION ALL SELECT 'optional_data', 0 UNION ALL SELECT 'line_order', 0"


@query(_TOC)
def toc_counts(g: Graph, spark, sf_dir):
    return accessors.table_of_contents(g)


@query(f"SELECT pool, CAST(size * CASE pool WHEN 'segs' THEN 24 WHEN 'paths' THEN 24 WHEN 'links' THEN 16 WHEN 'steps' THEN 4 WHEN 'overlaps' THEN 8 WHEN 'alignment' THEN 4 ELSE 1 END AS BIGINT) AS size FROM ({_TOC})")
def toc_bytes(g: Graph, spark, sf_dir):
    return accessors.table_of_contents(g, in_bytes=True)


@query("SELECT seg_id, name, seq, len FROM segments WHERE name = 42")
def find_segment(g: Graph, spark, sf_dir):
    return accessors.find_segment(g, 42).select("seg_id", "name", "seq", "len")


@query("SELECT path_id, name FROM paths WHERE name = 'o17'")
def find_path(g: Graph, spark, sf_dir):
    return accessors.find_path(g, "o17").select("path_id", "name")


@query("SELECT seg_id, name, len FROM segments WHERE seg_id >= 10 AND seg_id < 30")
def segment_slice(g: Graph, spark, sf_dir):
    return accessors.between(g.segments, "seg_id", 10, 30).select("seg_id", "name", "len")


@query("SELECT path_id, name FROM paths")
def path_names(g: Graph, spark, sf_dir):
    return accessors.path_names(g)


@query("SELECT seg_id, path_id, step_idx, fwd, seg_name FROM spans WHERE path_id = 7")
def path_steps(g: Graph, spark, sf_dir):
    return accessors.path_steps(g, 7)


@query("SELECT path_id, step_idx - 1 AS step_idx, seg_id, fwd FROM steps WHERE path_id = 7 AND step_idx >= 1 AND step_idx < 4")
def path_slice(g: Graph, spark, sf_dir):
    return accessors.slice_path(g, 7, 1, 4)


@query("SELECT p.path_id, p.name, count(t.seg_id) AS n_steps FROM paths p LEFT JOIN steps t USING (path_id) GROUP BY ALL")
def step_counts(g: Graph, spark, sf_dir):
    return accessors.step_counts(g)


@query("SELECT CASE WHEN from_seg = 5 THEN to_seg ELSE from_seg END AS other_seg FROM links WHERE from_seg = 5 OR to_seg = 5")
def neighbors(g: Graph, spark, sf_dir):
    return accessors.neighbors(g, 5).select("other_seg")


_ADJ = "string_agg(CAST({s} AS VARCHAR) || CASE WHEN {f} THEN '+' ELSE '-' END, ',' ORDER BY {s} * 2 + CAST({f} AS INT))"


@query(f"SELECT h.seg_id, h.fwd, coalesce(i.ins, '') AS ins, coalesce(o.outs, '') AS outs FROM strands h LEFT JOIN (SELECT to_seg, to_fwd, {_ADJ.format(s='from_seg', f='from_fwd')} AS ins FROM links GROUP BY ALL) i ON i.to_seg = h.seg_id AND i.to_fwd = h.fwd LEFT JOIN (SELECT from_seg, from_fwd, {_ADJ.format(s='to_seg', f='to_fwd')} AS outs FROM links GROUP BY ALL) o ON o.from_seg = h.seg_id AND o.from_fwd = h.fwd")
def adjacency(g: Graph, spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda x: sequences.handle_text(x["seg"], x["fwd"])), ",").alias(c)
    return accessors.adjacency(g).select("seg_id", "fwd", text("ins"), text("outs"))


@query("SELECT s.seg_id, s.name, coalesce(string_agg(t.path_id || ':' || t.step_idx || CASE WHEN t.fwd THEN '+' ELSE '-' END, ',' ORDER BY t.path_id, t.step_idx), '') AS crossings FROM segments s LEFT JOIN steps t USING (seg_id) GROUP BY ALL")
def crossings(g: Graph, spark, sf_dir):
    text = F.transform("steps", lambda x: F.concat(x["path_id"].cast("string"), F.lit(":"), x["step_idx"].cast("string"), sequences.sign(x["fwd"])))
    return depth.crossings(g).select("seg_id", "name", F.array_join(text, ",").alias("crossings"))


# Sequences


@query("SELECT seg_id, name, fwd, oseq FROM strands")
def oriented_sequences(g: Graph, spark, sf_dir):
    both = g.segments.select("seg_id", "name", "seq", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd"))
    return both.select("seg_id", "name", "fwd", sequences.oriented(F.col("seq"), F.col("fwd")).alias("oseq"))


@query("SELECT p.path_id, p.name, coalesce(string_agg(o.oseq, '' ORDER BY t.step_idx), '') AS seq FROM paths p LEFT JOIN steps t USING (path_id) LEFT JOIN strands o ON o.seg_id = t.seg_id AND o.fwd = t.fwd GROUP BY p.path_id, p.name")
def path_sequences(g: Graph, spark, sf_dir):
    return positions.path_sequences(g)


@query("SELECT seg_id, fwd, substr(oseq, 3, 5) AS part FROM strands")
def oriented_slices(g: Graph, spark, sf_dir):
    both = g.segments.select("seg_id", "seq", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd"))
    return both.select("seg_id", "fwd", sequences.oriented_slice(F.col("seq"), F.col("fwd"), F.lit(2), F.lit(7)).alias("part"))


@query("SELECT seg_id, i AS piece, substr(seq, CAST(i * 7 + 1 AS INT), 7) AS part FROM segments, unnest(range(CAST(ceil(len / 7.0) AS BIGINT))) AS u(i)")
def strand_pieces(g: Graph, spark, sf_dir):
    return g.segments.select("seg_id", F.posexplode(sequences.strand_pieces(F.col("seq"), 7)).alias("piece", "part")).withColumn("piece", F.col("piece").cast("long"))


@query("SELECT seg_id, list_aggregate(list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN '1' WHEN 'T' THEN '2' WHEN 'G' THEN '3' WHEN 'C' THEN '4' ELSE '5' END), 'string_agg', ',') AS codes, seq FROM segments")
def nucleotide_codes(g: Graph, spark, sf_dir):
    codes = g.segments.select("seg_id", sequences.nucleotides_to_ints(F.col("seq")).alias("codes"))
    return codes.select("seg_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), sequences.ints_to_nucleotides(F.col("codes")).alias("seq"))


@query("SELECT seg_id, replace(seq, 'N', 'A') AS bases, CAST(ceil(len / 2.0) AS BIGINT) AS n_bytes, substr(replace(seq, 'N', 'A'), 1, 1) AS first_base, substr(replace(seq, 'N', 'A'), 2, 3) AS part FROM segments")
def pack_unpack(g: Graph, spark, sf_dir):
    packed = g.segments.select("seg_id", "len", packing.pack(F.translate("seq", "N", "A")).alias("packed"))
    return packed.select("seg_id", packing.unpack(F.col("packed"), F.col("len")).alias("bases"), F.octet_length("packed").cast("long").alias("n_bytes"), packing.base_at(F.col("packed"), F.lit(0)).alias("first_base"), packing.packed_slice(F.col("packed"), F.lit(1), F.least(F.lit(4).cast("long"), F.col("len"))).alias("part"))


# Positions, windows, intervals


@query("SELECT p.name, CAST(p.path_id % 37 AS BIGINT) AS \"offset\", x.seg_id, x.seg_name, p.path_id % 37 - x.pos AS seg_offset, x.fwd FROM paths p JOIN spans x USING (path_id) WHERE x.pos <= p.path_id % 37 AND p.path_id % 37 < x.pos + x.len")
def positions_batch(g: Graph, spark, sf_dir):
    return positions.positions(g, g.paths.select("name", (F.col("path_id") % 37).alias("offset")))


_WINDOWS = "(SELECT path_id AS ord, name, i // 40 AS win, i AS start, least(i + 40, length) AS stop FROM lengths, unnest(range(0, length, 40)) AS u(i))"


@query(f'SELECT ord, win, name, start, stop AS "end" FROM {_WINDOWS}')
def make_windows(g: Graph, spark, sf_dir):
    return positions.make_windows(depth.as_bed(depth.path_length(g)), 40)


_COVERED = 'CAST(coalesce(sum((least(w.stop, x.pos + x.len) - greatest(w.start, x.pos)) * d.depth), 0) AS BIGINT) AS covered'


def _interval_sql(windows: str, where: str = "TRUE") -> str:
    return f'SELECT ord, win, name, start, "end", covered, CAST(covered AS DOUBLE) / ("end" - start) AS mean_depth FROM (SELECT w.ord, w.win, w.name, w.start, w.stop AS "end", {_COVERED} FROM {windows} w LEFT JOIN spans x ON x.path_id = w.ord AND x.pos < w.stop AND w.start < x.pos + x.len LEFT JOIN depths d ON d.seg_id = x.seg_id WHERE {where} GROUP BY ALL)'


@query(_interval_sql(_WINDOWS))
def interval_depth(g: Graph, spark, sf_dir):
    windows = positions.make_windows(depth.as_bed(depth.path_length(g)), 40)
    return positions.interval_depth(g, windows, ("ord", "win"))


@query(_interval_sql(_WINDOWS, "w.name = 'o3'").replace("SELECT ord, win", "SELECT CAST(0 AS BIGINT) AS ord, win", 1))
def window_depth(g: Graph, spark, sf_dir):
    return positions.window_depth(g, "o3", 40)


@query("SELECT a.ord AS a_ord, b.ord AS b_ord, a.name, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS \"end\" FROM intervals a JOIN stays b ON a.name = b.name AND a.start < b.stop AND b.start < a.stop WHERE a.start < a.stop AND b.start < b.stop")
def bed_intersect(g: Graph, spark, sf_dir):
    return positions.bed_intersect(star_intervals(spark, sf_dir), star_stays(spark, sf_dir))


# Links and paths


@query("SELECT p.path_id AS ord, p.name, CAST(0 AS BIGINT) AS start, l.length AS \"end\", q.path_id AS other_id, q.name AS other FROM (SELECT DISTINCT a.path_id AS own, b.path_id AS other FROM steps a JOIN steps b ON a.seg_id = b.seg_id AND a.fwd = b.fwd AND a.path_id <> b.path_id) m JOIN paths p ON p.path_id = m.own JOIN lengths l ON l.path_id = m.own JOIN paths q ON q.path_id = m.other")
def path_overlaps(g: Graph, spark, sf_dir):
    return links.path_overlaps(g)


_MISSING = "SELECT m.path_id, p.name, m.step_idx, m.from_seg, m.from_fwd, m.to_seg, m.to_fwd FROM pairs m JOIN paths p USING (path_id) WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.from_seg = m.from_seg AND l.from_fwd = m.from_fwd AND l.to_seg = m.to_seg AND l.to_fwd = m.to_fwd) AND NOT EXISTS (SELECT 1 FROM links l WHERE l.from_seg = m.to_seg AND l.from_fwd = NOT m.to_fwd AND l.to_seg = m.from_seg AND l.to_fwd = NOT m.from_fwd)"


@query(_MISSING)
def validate_links(g: Graph, spark, sf_dir):
    return links.missing_links(g)


@query(f"SELECT path_id, step_idx, '[odgi::validate] error: the path ' || name || ' does not respect the graph topology: the link ' || (from_seg + 1) || CASE WHEN from_fwd THEN '+' ELSE '-' END || ',' || (to_seg + 1) || CASE WHEN to_fwd THEN '+' ELSE '-' END || ' is missing.' AS message FROM ({_MISSING})")
def validate_messages(g: Graph, spark, sf_dir):
    return links.missing_link_messages(g)


@query("SELECT f.name AS from_name, t.name AS to_name, CAST(1 AS BIGINT) AS value FROM (SELECT from_seg AS a, to_seg AS b FROM links UNION ALL SELECT to_seg, from_seg FROM links) e JOIN segments f ON f.seg_id = e.a JOIN segments t ON t.seg_id = e.b")
def adjacency_matrix(g: Graph, spark, sf_dir):
    return accessors.adjacency_matrix(g)


@query("SELECT max(name) AS rows, max(name) AS columns, 2 * (SELECT count(*) FROM links) AS entries FROM segments")
def adjacency_matrix_header(g: Graph, spark, sf_dir):
    return accessors.adjacency_matrix_header(g)


_PLACES = "(SELECT seg_id, CAST(coalesce(sum(len) OVER (ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len FROM segments)"


@query(f"SELECT t.path_id, 'g' AS name, f.start, f.start + f.len AS \"end\", p.name AS path_name, CASE WHEN t.fwd THEN '+' ELSE '-' END AS strand, t.step_idx AS rank FROM steps t JOIN {_PLACES} f USING (seg_id) JOIN paths p USING (path_id)")
def flatten_bed(g: Graph, spark, sf_dir):
    return transforms.flatten_bed(g, "g")


@query("SELECT CAST(i AS BIGINT) AS line_no, substr(whole, CAST(i * 80 + 1 AS INT), 80) AS text FROM (SELECT string_agg(seq, '' ORDER BY seg_id) AS whole FROM segments), unnest(range(CAST(ceil(length(whole) / 80.0) AS BIGINT))) AS u(i)")
def flatten_fasta(g: Graph, spark, sf_dir):
    return transforms.fasta_lines(g)


@query(f"SELECT seg_id, start, start + len AS \"end\" FROM {_PLACES}")
def segment_places(g: Graph, spark, sf_dir):
    return transforms.fasta_places(g)


@query("SELECT p.name, string_agg(o.oseq, '' ORDER BY t.step_idx) AS seq FROM paths p JOIN steps t USING (path_id) JOIN strands o ON o.seg_id = t.seg_id AND o.fwd = t.fwd JOIN segments s ON s.seg_id = t.seg_id GROUP BY p.name HAVING sum(CASE WHEN t.fwd THEN s.len ELSE -s.len END) < 0")
def paths_le(g: Graph, spark, sf_dir):
    """Cutting segments changes no path, turning paths renames some."""
    return positions.logically_le(g, transforms.flip(transforms.chop(g, 9)))


# Reads

_CHUNKS = """
rsteps AS (SELECT r.file, r.read_ord, r.name AS read, r.s, r.e, CAST(x.step_idx AS BIGINT) AS idx, x.seg_id, x.seg_name, x.fwd, x.pos AS a, x.pos + x.len AS b, x.len, o.oseq FROM reads r JOIN spans x ON x.path_id = r.read_ord JOIN strands o ON o.seg_id = x.seg_id AND o.fwd = x.fwd),
marked AS (SELECT *, min(CASE WHEN s < b THEN idx END) OVER (PARTITION BY read_ord) AS first_idx FROM rsteps),
ended AS (SELECT *, min(CASE WHEN idx >= first_idx AND e < b THEN idx END) OVER (PARTITION BY read_ord) AS last_idx FROM marked),
chunks AS (SELECT *, CASE WHEN first_idx IS NULL OR idx < first_idx OR (last_idx IS NOT NULL AND idx > last_idx) THEN 'none' WHEN idx = first_idx OR idx = coalesce(last_idx, -1) THEN 'partial' ELSE 'all' END AS kind,
  CASE WHEN first_idx IS NULL OR idx < first_idx OR (last_idx IS NOT NULL AND idx > last_idx) THEN NULL WHEN idx = first_idx THEN s - a ELSE 0 END AS c0,
  CASE WHEN first_idx IS NULL OR idx < first_idx OR (last_idx IS NOT NULL AND idx > last_idx) THEN NULL WHEN idx = coalesce(last_idx, -1) THEN e - a ELSE len END AS c1 FROM ended)
"""


@query("SELECT r.file, r.read_ord, r.name, CAST(t.step_idx AS BIGINT) AS idx, t.seg_name, t.fwd FROM reads r JOIN spans t ON t.path_id = r.read_ord")
def read_handles(g: Graph, spark, sf_dir):
    rows = reads.read_handles(star_reads(g, spark, sf_dir), F.col("name"))
    return rows.select("file", "read_ord", "name", F.col("index").cast("long").alias("idx"), "seg_name", "fwd")


def _chunk_sql(sql: str) -> str:
    return "WITH " + SQL.strip() + _CHUNKS + sql


def _chunks(g: Graph, spark, sf_dir) -> DataFrame:
    return reads.chunks(g, star_reads(g, spark, sf_dir))


@query()
def gaf_chunks(g: Graph, spark, sf_dir):
    return _chunks(g, spark, sf_dir).select("file", "read_ord", "read", F.col("index").alias("idx"), "seg_id", "fwd", "kind", F.col("start").alias("c0"), F.col("end").alias("c1"))


ORACLES["gaf_chunks"] = _chunk_sql("SELECT file, read_ord, read, idx, seg_id, fwd, kind, c0, c1 FROM chunks")


@query()
def gaf_ranges(g: Graph, spark, sf_dir):
    low, high = reads.closed_range(*(F.col(c) for c in ("kind", "start", "end", "len")))
    return _chunks(g, spark, sf_dir).select("read_ord", F.col("index").alias("idx"), low.alias("low"), high.alias("high"))


ORACLES["gaf_ranges"] = _chunk_sql("SELECT read_ord, idx, CASE kind WHEN 'none' THEN 1 WHEN 'all' THEN 0 ELSE c0 END AS low, CASE kind WHEN 'none' THEN 0 WHEN 'all' THEN len - 1 ELSE c1 END AS high FROM chunks")


@query()
def gaf_sequences(g: Graph, spark, sf_dir):
    return reads.read_sequences(g, star_reads(g, spark, sf_dir))


ORACLES["gaf_sequences"] = _chunk_sql("SELECT file, read_ord, read AS name, string_agg(CASE kind WHEN 'all' THEN oseq WHEN 'partial' THEN substr(oseq, CAST(c0 + 1 AS INT), CAST(greatest(c1 - c0, 0) AS INT)) ELSE '' END, '' ORDER BY idx) AS seq FROM chunks GROUP BY ALL")


@query()
def gaf_descriptions(g: Graph, spark, sf_dir):
    return reads.read_descriptions(g, star_reads(g, spark, sf_dir))


ORACLES["gaf_descriptions"] = _chunk_sql("SELECT file, read_ord, read AS name, string_agg(idx || ': ' || CASE kind WHEN 'none' THEN '(skipped)' WHEN 'all' THEN seg_name || CASE WHEN fwd THEN '+' ELSE '-' END || ', ' || len || 'bp' ELSE seg_name || CASE WHEN fwd THEN '+' ELSE '-' END || ', ' || c0 || '-' || c1 || 'bp' END, '' ORDER BY idx) AS text FROM chunks GROUP BY ALL")


@query()
def gaf_chunk_count(g: Graph, spark, sf_dir):
    return reads.chunk_count(g, star_reads(g, spark, sf_dir))


ORACLES["gaf_chunk_count"] = _chunk_sql("SELECT count(*) AS chunks FROM chunks")


@query("SELECT f.file, s.seg_id, x.seg_id IS NOT NULL AS present FROM segments s CROSS JOIN (SELECT DISTINCT file FROM reads) f LEFT JOIN (SELECT DISTINCT r.file, t.seg_id FROM reads r JOIN steps t ON t.path_id = r.read_ord) x ON x.file = f.file AND x.seg_id = s.seg_id")
def pangenotype(g: Graph, spark, sf_dir):
    return reads.presence(g, star_reads(g, spark, sf_dir))


@query("SELECT f.file, string_agg(CASE WHEN x.seg_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY s.seg_id) AS cells FROM segments s CROSS JOIN (SELECT DISTINCT file FROM reads) f LEFT JOIN (SELECT DISTINCT r.file, t.seg_id FROM reads r JOIN steps t ON t.path_id = r.read_ord) x ON x.file = f.file AND x.seg_id = s.seg_id GROUP BY f.file")
def pangenotype_rows(g: Graph, spark, sf_dir):
    return reads.presence_rows(g, star_reads(g, spark, sf_dir)).select("file", F.array_join(F.transform("cells", lambda c: F.when(c, "1").otherwise("0")), "").alias("cells"))


# Transforms

_CHOP = """
pieces AS (SELECT seg_id, seq, len, CAST(greatest(ceil(len / 9.0), 1) AS BIGINT) AS n FROM segments),
cut AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM pieces)
"""


def _chop_sql(sql: str) -> str:
    return "WITH " + SQL.strip() + _CHOP + sql


@query()
def chop_segments(g: Graph, spark, sf_dir):
    return transforms.chop(g, 9).segments.select("seg_id", "name", "seq", "len")


ORACLES["chop_segments"] = _chop_sql("SELECT first + i AS seg_id, first + i + 1 AS name, substr(seq, CAST(i * 9 + 1 AS INT), 9) AS seq, least(CAST(9 AS BIGINT), len - i * 9) AS len FROM cut, unnest(range(n)) AS u(i)")


@query()
def chop_steps(g: Graph, spark, sf_dir):
    return transforms.chop(g, 9).steps


ORACLES["chop_steps"] = _chop_sql("SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY step_idx, i) - 1 AS BIGINT) AS step_idx, CASE WHEN fwd THEN first + i ELSE first + n - 1 - i END AS seg_id, fwd FROM steps JOIN cut USING (seg_id), unnest(range(n)) AS u(i)")


@query()
def chop_without_empty(g: Graph, spark, sf_dir):
    """Segments of less than nine base pairs are empty here, and have no piece."""
    emptied = g.segments.withColumn("seq", F.when(F.col("len") < 9, "").otherwise(F.col("seq"))).withColumn("len", F.length("seq").cast("long"))
    out = transforms.chop(g.with_tables(segments=emptied), 9, drop_empty=True)
    return out.steps.join(out.segments.select("seg_id", "seq"), "seg_id")


ORACLES["chop_without_empty"] = "WITH " + SQL.strip() + """
full_ AS (SELECT seg_id AS old, seq, CAST(ceil(len / 9.0) AS BIGINT) AS n FROM segments WHERE len >= 9),
parts AS (SELECT old, n, i AS piece, substr(seq, CAST(i * 9 + 1 AS INT), 9) AS seq, CAST(row_number() OVER (ORDER BY old, i) - 1 AS BIGINT) AS seg_id FROM full_, unnest(range(n)) AS u(i))
SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY step_idx, CASE WHEN fwd THEN piece ELSE -piece END) - 1 AS BIGINT) AS step_idx, p.seg_id, fwd, seq FROM steps t JOIN parts p ON p.old = t.seg_id"""


@query()
def chop_links(g: Graph, spark, sf_dir):
    return transforms.chop(g, 9, with_links=True).links.select("link_id", *links.ENDS)


ORACLES["chop_links"] = _chop_sql("SELECT CAST(row_number() OVER (ORDER BY part, o1, o2) - 1 AS BIGINT) AS link_id, from_seg, from_fwd, to_seg, to_fwd FROM (SELECT 0 AS part, first + i AS o1, 0 AS o2, first + i AS from_seg, TRUE AS from_fwd, first + i + 1 AS to_seg, TRUE AS to_fwd FROM cut, unnest(range(n - 1)) AS u(i) UNION ALL SELECT 1, l.from_seg * 2 + CAST(l.from_fwd AS INT), l.to_seg * 2 + CAST(l.to_fwd AS INT), CASE WHEN l.from_fwd THEN a.first + a.n - 1 ELSE a.first END, l.from_fwd, CASE WHEN l.to_fwd THEN b.first ELSE b.first + b.n - 1 END, l.to_fwd FROM links l JOIN cut a ON a.seg_id = l.from_seg JOIN cut b ON b.seg_id = l.to_seg)")


@query("SELECT seg_id, name, regexp_replace(seq, 'N+', 'N', 'g') AS seq, CAST(length(regexp_replace(seq, 'N+', 'N', 'g')) AS BIGINT) AS len FROM segments")
def crush(g: Graph, spark, sf_dir):
    return transforms.crush(g).segments.select("seg_id", "name", "seq", "len")


_FLIP = """
turned AS (SELECT p.path_id, p.name, coalesce(sum(CASE WHEN x.fwd THEN x.len ELSE -x.len END), 0) < 0 AS flips, count(x.seg_id) AS n FROM paths p LEFT JOIN spans x USING (path_id) GROUP BY p.path_id, p.name),
fsteps AS (SELECT t.path_id, CASE WHEN u.flips THEN u.n - 1 - t.step_idx ELSE t.step_idx END AS step_idx, t.seg_id, t.fwd <> u.flips AS fwd, u.flips FROM steps t JOIN turned u USING (path_id)),
needed AS (SELECT * FROM (SELECT path_id, step_idx, seg_id AS from_seg, fwd AS from_fwd, lead(seg_id) OVER w AS to_seg, lead(fwd) OVER w AS to_fwd FROM fsteps WHERE flips WINDOW w AS (PARTITION BY path_id ORDER BY step_idx)) WHERE to_seg IS NOT NULL)
"""


@query()
def flip_paths(g: Graph, spark, sf_dir):
    f = transforms.flip(g)
    return f.steps.join(f.paths.select("path_id", "name"), "path_id").select("path_id", "name", "step_idx", "seg_id", "fwd")


ORACLES["flip_paths"] = "WITH " + SQL.strip() + _FLIP + "SELECT t.path_id, u.name || CASE WHEN u.flips THEN '_inv' ELSE '' END AS name, t.step_idx, t.seg_id, t.fwd FROM fsteps t JOIN turned u USING (path_id)"


@query()
def flip_links(g: Graph, spark, sf_dir):
    return transforms.flip(g).links.select(F.col("link_id").alias("place"), *links.ENDS)


ORACLES["flip_links"] = "WITH " + SQL.strip() + _FLIP + """, every AS (SELECT 0 AS part, from_seg * 2 + CAST(from_fwd AS INT) AS a, to_seg * 2 + CAST(to_fwd AS INT) AS b, from_seg, from_fwd, to_seg, to_fwd FROM links UNION ALL SELECT 1, path_id, step_idx, from_seg, from_fwd, to_seg, to_fwd FROM needed),
keyed AS (SELECT *, from_seg * 2 + CAST(from_fwd AS INT) AS h, to_seg * 2 + CAST(to_fwd AS INT) AS k, to_seg * 2 + CAST(NOT to_fwd AS INT) AS h2, from_seg * 2 + CAST(NOT from_fwd AS INT) AS k2 FROM every),
ranked AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN h < h2 OR (h = h2 AND k <= k2) THEN h ELSE h2 END, CASE WHEN h < h2 OR (h = h2 AND k <= k2) THEN k ELSE k2 END ORDER BY part, a, b) AS nth FROM keyed)
SELECT CAST(row_number() OVER (ORDER BY part, a, b) - 1 AS BIGINT) AS place, from_seg, from_fwd, to_seg, to_fwd FROM ranked WHERE nth = 1"""

#: Injections of the registered query: path, low, high, new name.
INJECTIONS = [("o3", 5, 60, "n0"), ("o1", 10, 33, "n1"), ("no-such-path", 1, 2, "n2"), ("o6", 0, 25, "n3")]
_INJECT = """
bed(ord, name, low, high, new) AS (VALUES (0, 'o3', 5, 60, 'n0'), (1, 'o1', 10, 33, 'n1'), (2, 'no-such-path', 1, 2, 'n2'), (3, 'o6', 0, 25, 'n3')),
asked AS (SELECT bed.*, p.path_id FROM bed JOIN paths p USING (name)),
points AS (SELECT DISTINCT path_id, point FROM (SELECT path_id, low AS point FROM asked UNION ALL SELECT path_id, high FROM asked)),
cuts AS (SELECT DISTINCT x.seg_id, CASE WHEN x.fwd THEN q.point - x.pos ELSE x.len - (q.point - x.pos) END AS cut FROM spans x JOIN points q USING (path_id) WHERE x.pos < q.point AND q.point < x.pos + x.len),
edges AS (SELECT seg_id, 0 AS low FROM segments UNION ALL SELECT * FROM cuts),
ipieces AS (SELECT e.seg_id, s.seq, e.low, coalesce(lead(e.low) OVER (PARTITION BY e.seg_id ORDER BY e.low), s.len) AS high, row_number() OVER (ORDER BY e.seg_id, e.low) - 1 AS new_id FROM edges e JOIN segments s USING (seg_id)),
isteps AS (SELECT t.path_id, row_number() OVER (PARTITION BY t.path_id ORDER BY t.step_idx, CASE WHEN t.fwd THEN i.low ELSE -i.low END) - 1 AS step_idx, i.new_id AS seg_id, t.fwd, i.high - i.low AS len FROM steps t JOIN ipieces i USING (seg_id)),
ispans AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY path_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM isteps)
"""


@query()
def inject_segments(g: Graph, spark, sf_dir):
    return transforms.inject(g, INJECTIONS).segments.select("seg_id", "name", "seq")


ORACLES["inject_segments"] = "WITH " + SQL.strip() + _INJECT + "SELECT CAST(new_id AS BIGINT) AS seg_id, CAST(new_id + 1 AS BIGINT) AS name, substr(seq, CAST(low + 1 AS INT), CAST(high - low AS INT)) AS seq FROM ipieces"


@query()
def inject_paths(g: Graph, spark, sf_dir):
    out = transforms.inject(g, INJECTIONS)
    return out.steps.join(out.paths.select("path_id", "name"), "path_id").select("name", "step_idx", "seg_id", "fwd")


ORACLES["inject_paths"] = "WITH " + SQL.strip() + _INJECT + "SELECT p.name, CAST(t.step_idx AS BIGINT) AS step_idx, CAST(t.seg_id AS BIGINT) AS seg_id, t.fwd FROM isteps t JOIN paths p USING (path_id) UNION ALL SELECT a.new, CAST(row_number() OVER (PARTITION BY a.ord ORDER BY t.step_idx) - 1 AS BIGINT), CAST(t.seg_id AS BIGINT), t.fwd FROM asked a JOIN ispans t USING (path_id) WHERE a.low <= t.pos AND t.pos + t.len <= a.high"

_BFS = """
edges AS (SELECT from_seg AS a, to_seg AS b FROM links UNION SELECT to_seg, from_seg FROM links),
reach0 AS (SELECT 9 AS seg_id), reach1 AS (SELECT seg_id FROM reach0 UNION SELECT b FROM edges JOIN reach0 ON a = seg_id),
found AS (SELECT seg_id FROM reach1 UNION SELECT b FROM edges JOIN reach1 ON a = seg_id)
"""


@query()
def extract_bfs(g: Graph, spark, sf_dir):
    return extract.neighborhood(g, accessors.find_segment(g, 10), 2)


ORACLES["extract_bfs"] = "WITH " + SQL.strip() + _BFS + "SELECT CAST(seg_id AS BIGINT) AS seg_id FROM found"


@query()
def subpaths(g: Graph, spark, sf_dir):
    paths, _ = extract.subpaths(g, extract.neighborhood(g, accessors.find_segment(g, 10), 1))
    return paths.select("path_id", "name", "start", "end", "n_steps")


ORACLES["subpaths"] = "WITH " + SQL.strip() + _BFS + ", flagged AS (SELECT x.*, r.seg_id IS NOT NULL AS inside FROM spans x LEFT JOIN reach1 r USING (seg_id)), runs AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY path_id ORDER BY step_idx) AS run FROM flagged) SELECT r.path_id, p.name || ':' || min(r.pos) || '-' || max(r.pos + r.len) AS name, min(r.pos) AS start, max(r.pos + r.len) AS \"end\", count(*) AS n_steps FROM runs r JOIN paths p USING (path_id) WHERE inside GROUP BY r.path_id, p.name, r.run"


@query()
def extract_full(g: Graph, spark, sf_dir):
    out = extract.extract(g, 10, 1, 40, rounds=2, at_once=True)
    return out.segments.select("name").join(out.steps.groupBy("seg_id").count().join(out.segments.select("seg_id", "name"), "seg_id").select("name", F.col("count").alias("n_steps")), "name", "left").na.fill(0)


def _gap_sql(old: str, new: str) -> str:
    flags = f"SELECT x.path_id, x.step_idx, x.seg_id, x.pos, r.seg_id IS NOT NULL AS inside FROM spans x LEFT JOIN {old} r USING (seg_id)"
    beside = f"SELECT seg_id, inside, max(CAST(inside AS INT)) OVER (PARTITION BY path_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visited, min(CASE WHEN inside THEN pos END) OVER (PARTITION BY path_id ORDER BY step_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back_at FROM ({flags})"
    return f"{new} AS (SELECT seg_id FROM {old} UNION SELECT seg_id FROM ({beside}) WHERE NOT inside AND visited = 1 AND back_at <= 40)"


ORACLES["extract_full"] = "WITH " + SQL.strip() + _BFS + ", " + _gap_sql("reach1", "filled1") + ", " + _gap_sql("filled1", "filled2") + " SELECT s.name, count(t.path_id) AS n_steps FROM filled2 f JOIN segments s USING (seg_id) LEFT JOIN steps t ON t.seg_id = f.seg_id GROUP BY s.name"


@query()
def extract_in_turn(g: Graph, spark, sf_dir):
    """The same with gaps filled path after path; the tests hold it against a walk over all paths."""
    return extract.extract(g, 10, 1, 40, rounds=2).segments.select("name")


@query()
def somepaths(g: Graph, spark, sf_dir):
    return transforms.sampled_names(g, 50)


# Lines and exports


@query("SELECT seg_id, name, 'S\t' || name || '\t' || seq AS text FROM segments")
def gfa_segment_lines(g: Graph, spark, sf_dir):
    return gfa_text.segment_lines(g)


@query("SELECT p.path_id, p.name, 'P\t' || p.name || '\t' || coalesce(string_agg((t.seg_id + 1) || CASE WHEN t.fwd THEN '+' ELSE '-' END, ',' ORDER BY t.step_idx), '') || '\t*' AS text FROM paths p LEFT JOIN steps t USING (path_id) GROUP BY p.path_id, p.name")
def gfa_path_lines(g: Graph, spark, sf_dir):
    return gfa_text.path_lines(g)


@query("SELECT 'L\t' || (from_seg + 1) || '\t' || CASE WHEN from_fwd THEN '+' ELSE '-' END || '\t' || (to_seg + 1) || '\t' || CASE WHEN to_fwd THEN '+' ELSE '-' END || '\t0M' AS text FROM links")
def gfa_link_lines(g: Graph, spark, sf_dir):
    return gfa_text.link_lines(g).select("text")


@query("SELECT CASE WHEN CAST(to_seg + 1 AS VARCHAR) < CAST(from_seg + 1 AS VARCHAR) OR (to_seg = from_seg AND NOT from_fwd) THEN 'L\t' || (to_seg + 1) || '\t' || CASE WHEN to_fwd THEN '-' ELSE '+' END || '\t' || (from_seg + 1) || '\t' || CASE WHEN from_fwd THEN '-' ELSE '+' END || '\t0M' ELSE 'L\t' || (from_seg + 1) || '\t' || CASE WHEN from_fwd THEN '+' ELSE '-' END || '\t' || (to_seg + 1) || '\t' || CASE WHEN to_fwd THEN '+' ELSE '-' END || '\t0M' END AS text FROM links")
def canonical_links(g: Graph, spark, sf_dir):
    return gfa_text.link_lines(g, canonical=True).select("text")


_CANONICAL = """SELECT 0 AS section, '00000000000000000000' AS key, 'H\tVN:Z:1.0' AS text
UNION ALL SELECT 1, CAST(name AS VARCHAR), 'S\t' || name || '\t' || seq FROM segments
UNION ALL SELECT 2, u.name, 'P\t' || u.name || CASE WHEN u.flips THEN '_inv' ELSE '' END || '\t' || coalesce(string_agg((t.seg_id + 1) || CASE WHEN t.fwd THEN '+' ELSE '-' END, ',' ORDER BY t.step_idx), '') || '\t*' FROM turned u LEFT JOIN fsteps t USING (path_id) GROUP BY u.path_id, u.name, u.flips"""


@query()
def canonical_text(g: Graph, spark, sf_dir):
    """Turned paths keep the place of their old names; names that end alike by themselves sort as they are."""
    return gfa_text.canonical_lines(transforms.flip(g), links=False)


ORACLES["canonical_text"] = "WITH " + SQL.strip() + _FLIP + _CANONICAL


@query("SELECT p.name, t.step_idx, s.name AS seg_name, t.fwd, s.seq, (SELECT count(*) FROM links) AS n_links FROM steps t JOIN paths p USING (path_id) JOIN segments s USING (seg_id)")
def text_round_trip(g: Graph, spark, sf_dir):
    """The graph written as text and read again."""
    lines = numbered(gfa_text.normalized_lines(g), "line_no", F.col("section"), F.col("ord")).select("line_no", F.col("text").alias("value"))
    back = gfa_text.graph_of(lines, "strict")
    rows = back.steps.join(back.paths.select("path_id", "name"), "path_id").join(back.segments.select("seg_id", F.col("name").alias("seg_name"), "seq"), "seg_id")
    return rows.select("name", "step_idx", "seg_name", "fwd", "seq").crossJoin(back.links.agg(F.count(F.lit(1)).alias("n_links")))


@query("SELECT s.name, coalesce(string_agg(t.path_id + 1, ',' ORDER BY t.path_id, t.step_idx), '') || repeat(',0', CAST((SELECT max(depth) FROM depths) - count(t.path_id) AS INT)) AS path_ids FROM segments s LEFT JOIN steps t USING (seg_id) GROUP BY s.seg_id, s.name")
def depth_export(g: Graph, spark, sf_dir):
    most = accessors.graph_maxes(g).first()["max_e"]
    rows = json_graph.depth_tables(g, most)
    text = F.array_join(F.transform("path_ids", lambda x: x.cast("string")), ",")
    return rows.select("name", F.when(F.get("path_ids", F.lit(0)) == 0, F.concat(F.lit(","), text)).otherwise(text).alias("path_ids"))


@query("SELECT p.name, coalesce(string_agg((t.seg_id + 1) || ',' || CASE WHEN t.fwd THEN 0 ELSE 1 END, ',' ORDER BY t.step_idx), '') AS codes FROM paths p LEFT JOIN steps t USING (path_id) GROUP BY p.path_id, p.name")
def path_codes(g: Graph, spark, sf_dir):
    return json_graph.path_codes(g).select("name", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@query("SELECT (from_seg + 1) || ',' || CASE WHEN from_fwd THEN 0 ELSE 1 END || ',' || (to_seg + 1) || ',' || CASE WHEN to_fwd THEN 0 ELSE 1 END || ',0M' AS codes FROM links")
def link_codes(g: Graph, spark, sf_dir):
    return json_graph.link_codes(g).select(F.array_join("codes", ",").alias("codes"))


@query(f"SELECT seg_id, start AS before FROM {_PLACES}")
def running_sums(g: Graph, spark, sf_dir):
    return sums_before(g.segments.select("seg_id", "len"), "seg_id", F.col("len"), "before").select("seg_id", "before")


@query("SELECT x.path_id, x.step_idx, x.pos, (x.seg_id + 1) || CASE WHEN x.fwd THEN '+' ELSE '-' END AS handle FROM spans x")
def running_positions(g: Graph, spark, sf_dir):
    return handle_names(g, positions.positioned(g), "seg_id", "fwd", "handle").select("path_id", "step_idx", "pos", "handle")
