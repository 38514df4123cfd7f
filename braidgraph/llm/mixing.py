"""Mixing sources to target weights.

Sizes are aggregated per source, targets are shared out by weight up to a highest repetition rate, and
every document is taken floor(rate) times, plus once more with the probability of the fraction, drawn
from a hash of a seed and its id. Reruns agree, and no document waits for another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import free_prefix
from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
MOST_RATE = 3
SEED = "mix-1"
#: Targets are broadcast up to this number of sources (about 100 bytes each), else joined by a salted shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 32


def _size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_col: str, seed: str):
    """A number in [0, 1) from the first 52 bits of md5(seed:id)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(2**52).cast("double")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_rate: int = MOST_RATE) -> DataFrame:
    """source, source_size, target for each source; `sizes` has source and size, one row a document.

    All sizes together are shared by weight; a target stops at most_rate times its source's size, and
    the excess goes to the others by weight. In order of most_rate * size / weight the full sources
    come first, so running sums find the level at once. The table has one row a source, about 100 bytes, and one
    task sorts it: meant for up to some ten million sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", w.cast("long")).withColumn("most", F.lit(most_rate).cast("long") * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("w_rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("total", F.sum("source_size").over(everything))
    by = by.withColumn("full", F.col("most") * F.col("w_rest") <= F.col("w") * (F.col("total") - F.col("full_before")))
    by = by.withColumn("full_sum", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))).withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("w").cast("double") * (F.col("total") - F.col("full_sum")).cast("double") / F.col("open_w").cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_rate: int = MOST_RATE, seed: str = SEED) -> DataFrame:
    """All columns of the documents, and mix_size, mix_source_size, mix_target, mix_copies.

    A null text has size 0, a null source is a source of its own, the last in order. A source without
    words has target 0 and its documents no copies. Rows with equal ids are drawn alike. Columns of
    the documents that already have one of the four names are replaced. An empty table gives no rows.
    """
    given = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    own = [c for c in docs.columns if c not in given]
    p = free_prefix(docs.columns, "mixing_")
    sized = docs.select(*own, _size(text_col).alias("mix_size"))
    targets = source_targets(docs.select(F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size")), weights, most_rate)
    targets = targets.select(F.col("source").alias(f"{p}source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    targets = written(targets, "mix-targets")
    same = F.col(source_col).cast("string").eqNullSafe(F.col(f"{p}source"))
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = sized.join(F.broadcast(targets), same)
    else:
        salted = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{p}salt"))
        rows = sized.withColumn(f"{p}own_salt", F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(f"{p}own_salt") == F.col(f"{p}salt")))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    taken = whole + F.when(_draw(id_col, seed) < rate - whole, 1).otherwise(0)
    return rows.select(*own, "mix_size", "mix_source_size", "mix_target", taken.cast("long").alias("mix_copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with copy_no from 1."""
    rows = copies(docs, id_col, text_col, source_col, **how)
    own = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies", "copy_no")]
    return rows.where("mix_copies > 0").select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy_no"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS most FROM s),
r AS (SELECT *, CAST(coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
        CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_rest,
        CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
f AS (SELECT *, most * w_rest <= w * (total - full_before) AS is_full FROM r),
g AS (SELECT *, CAST(coalesce(sum(most) FILTER (is_full) OVER (), 0) AS BIGINT) AS full_sum, CAST(sum(w) FILTER (NOT is_full) OVER () AS BIGINT) AS open_w FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(total - full_sum AS DOUBLE) / CAST(open_w AS DOUBLE) END AS target FROM g),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        CAST(CAST('0x' || substr(md5('mix-1:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
