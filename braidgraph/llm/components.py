"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a join and an aggregation; hot nodes are aggregated before the shuffle and joined by
broadcast or by a join that adaptive execution can split. Steps end in tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import packed, scratch, stored

#: Smallest neighbours are broadcast up to this number of nodes (about 60 bytes each), else joined by shuffle.
BROADCAST_NODES = 200_000


def bounded(df: DataFrame, most: int) -> DataFrame:
    """A table of the shared folder, marked for broadcast if it has at most so many rows."""
    rows = getattr(df, "braid_rows", None)
    return F.broadcast(df) if (df.limit(most + 1).count() if rows is None else rows) <= most else df


def _least(pairs: DataFrame, key: str, value: str, name: str, rows: int) -> DataFrame:
    return bounded(stored(packed(pairs.groupBy(key).agg(F.min(value).alias("least")), rows), name), BROADCAST_NODES)


def _state(links: DataFrame) -> tuple[int, int]:
    mark = F.xxhash64("u", "v")
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x")).first()
    return row.n, row.x or 0


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node and label (the least node of its component) for every node of the links u, v; loops are ignored.

    Columns of any one orderable type. No links give no rows. rows: the number of links, repeated ones included, or
    more, if it is known.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links if rows is None else packed(links, rows), "cc-links")
    state = _state(links)
    while state[0]:
        with scratch(links.sparkSession) as keep:
            links = keep(_step(links, 2 * state[0]))
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(packed(roots, state[0]))


def _step(links: DataFrame, rows: int) -> DataFrame:
    """Links after a large and a small step; rows: twice their number, which no table of the step exceeds."""
    both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = _least(both, "u", "v", "cc-least", rows)
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
    large = stored(packed(large, rows), "cc-large")
    least = _least(large, "u", "v", "cc-least", rows)
    moved = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return stored(packed(moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), rows), "cc-links")
