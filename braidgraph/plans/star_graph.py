"""A graph, intervals and reads derived from the star-schema tables, and the same derivation as SQL.

Parts are segments, orders are paths, line items are steps; links join consecutive steps of which one at least
is forward, so links that are backward on both sides may be missing. Some orders have no line items: empty paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import handle_text
from ..operators.links import step_pairs
from .graph import CIGAR, Graph

#: Far more line items than an order has; paths of that many steps need no second level of sums.
MOST_ITEMS = 1 << 10
_STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    part, orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders", "lineitem"))
    seq = F.substr(F.repeat(F.lit("ACGTNNACGT"), F.lit(6)), (F.col("p_partkey") % 10 + 1).cast("int"), F.col("p_size").cast("int"))
    segments = part.select(F.col("p_partkey").alias("seg_id"), (F.col("p_partkey") + 1).alias("name"), seq.alias("seq"), F.col("p_size").cast("long").alias("len"), F.lit("").alias("optional"))
    order = Window.partitionBy("l_orderkey").orderBy(*_STEP_ORDER)
    steps = items.select(F.col("l_orderkey").alias("path_id"), (F.row_number().over(order) - 1).cast("long").alias("step_idx"), F.col("l_partkey").alias("seg_id"), (F.col("l_returnflag") != "R").alias("fwd"))
    paths = orders.select(F.col("o_orderkey").alias("path_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(None).cast(f"array<{CIGAR.simpleString()}>").alias("overlaps"))
    ends = step_pairs(steps, MOST_ITEMS).where("from_fwd OR to_fwd").select("from_seg", "from_fwd", "to_seg", "to_fwd").distinct()
    number = (F.col("from_seg") * 2 + F.col("from_fwd").cast("long")) * F.lit(1 << 32) + F.col("to_seg") * 2 + F.col("to_fwd").cast("long")
    links = ends.select(number.alias("link_id"), "from_seg", "from_fwd", "to_seg", "to_fwd", F.array().cast(CIGAR.simpleString()).alias("overlap"))
    headers = spark.range(1).select(F.col("id").alias("ord"), F.lit("VN:Z:1.0").alias("text"))
    return Graph(headers, segments, paths, steps, links, longest=MOST_ITEMS)


def star_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of users from their events: ord, name, start, end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.col("event_id") % 1000
    return events.select(F.col("event_id").alias("ord"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), start.alias("start"), (start + F.floor(F.col("value")) % 50).cast("long").alias("end"))


def star_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of customers from their orders, under the users' names: ord, name, start, end."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.col("o_orderkey") % 1000
    return orders.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("name"), start.alias("start"), (start + F.floor("o_totalprice") % 50).cast("long").alias("end"))


def star_reads(g: Graph, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each path that has steps: its own walk, with a range that trims its ends; files by order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("path_id"), F.col("o_orderpriority").alias("file"))
    rows = g.steps.join(g.segments.select("seg_id", "name", "len"), "seg_id")
    step = F.concat(F.when(F.col("fwd"), ">").otherwise("<"), F.col("name").cast("string"))
    walks = rows.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_idx", step.alias("step")))), lambda x: x["step"]), "").alias("path"), F.sum("len").alias("length"))
    start, end = F.col("path_id") % 7, F.greatest(F.col("path_id") % 7, F.col("length") - F.col("path_id") % 5)
    return walks.join(orders, "path_id").select("file", F.col("path_id").alias("read_ord"), F.concat(F.lit("r"), F.col("path_id").cast("string")).alias("name"), "path", start.alias("start"), end.alias("end"))


def handle_names(g: Graph, rows: DataFrame, seg: str, fwd: str, out: str) -> DataFrame:
    """Adds the text of a handle, name and sign."""
    names = g.segments.select(F.col("seg_id").alias(seg), F.col("name").alias("handle_name"))
    return rows.join(names, seg).withColumn(out, handle_text(F.col("handle_name"), F.col(fwd))).drop("handle_name")


SQL = """
segments AS (SELECT p_partkey AS seg_id, p_partkey + 1 AS name, substr(repeat('ACGTNNACGT', 6), CAST(1 + p_partkey % 10 AS INT), p_size) AS seq, CAST(p_size AS BIGINT) AS len FROM part),
steps AS (SELECT l_orderkey AS path_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS step_idx, l_partkey AS seg_id, l_returnflag <> 'R' AS fwd FROM lineitem),
paths AS (SELECT o_orderkey AS path_id, 'o' || CAST(o_orderkey AS VARCHAR) AS name FROM orders),
pairs AS (SELECT * FROM (SELECT path_id, step_idx, seg_id AS from_seg, fwd AS from_fwd, lead(seg_id) OVER w AS to_seg, lead(fwd) OVER w AS to_fwd FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY step_idx)) WHERE to_seg IS NOT NULL),
links AS (SELECT DISTINCT from_seg, from_fwd, to_seg, to_fwd FROM pairs WHERE from_fwd OR to_fwd),
depths AS (SELECT seg_id, count(*) AS depth, count(DISTINCT path_id) AS uniq FROM steps GROUP BY seg_id),
spans AS (SELECT t.*, s.len, s.name AS seg_name, s.seq, CAST(coalesce(sum(s.len) OVER (PARTITION BY path_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM steps t JOIN segments s USING (seg_id)),
lengths AS (SELECT p.path_id, p.name, CAST(coalesce(sum(x.len), 0) AS BIGINT) AS length FROM paths p LEFT JOIN spans x USING (path_id) GROUP BY ALL),
strands AS (SELECT seg_id, name, TRUE AS fwd, seq AS oseq FROM segments UNION ALL SELECT seg_id, name, FALSE, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) FROM segments),
intervals AS (SELECT event_id AS ord, 'u' || CAST(user_id AS VARCHAR) AS name, event_id % 1000 AS start, CAST(event_id % 1000 + CAST(floor(value) AS BIGINT) % 50 AS BIGINT) AS stop FROM events),
stays AS (SELECT o_orderkey AS ord, 'u' || CAST(o_custkey AS VARCHAR) AS name, o_orderkey % 1000 AS start, CAST(o_orderkey % 1000 + CAST(floor(o_totalprice) AS BIGINT) % 50 AS BIGINT) AS stop FROM orders),
walks AS (SELECT path_id, string_agg(CASE WHEN fwd THEN '>' ELSE '<' END || CAST(seg_name AS VARCHAR), '' ORDER BY step_idx) AS path, CAST(sum(len) AS BIGINT) AS length FROM spans GROUP BY path_id),
reads AS (SELECT o_orderpriority AS file, w.path_id AS read_ord, 'r' || CAST(w.path_id AS VARCHAR) AS name, w.path, w.path_id % 7 AS s, greatest(w.path_id % 7, length - w.path_id % 5) AS e FROM walks w JOIN orders ON o_orderkey = w.path_id),
"""
