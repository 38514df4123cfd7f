"""Dense numbers and running sums over whole tables, without a window over one partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Consecutive ids whose sums are formed together.
BUCKET = 1 << 16


def sums_before(df: DataFrame, order: str, value: Column | dict[str, Column], name: str | None = None) -> DataFrame:
    """Adds the sum of `value` over all rows with a smaller `order` (a dense id from 0); a dict adds several.

    Each bucket of ids is summed by itself; only the table of bucket sums, one row for BUCKET ids, is
    summed by a single task.
    """
    values = value if isinstance(value, dict) else {name: value}
    held = {n: f"prefix_value_{i}" for i, n in enumerate(values)}
    rows = df.withColumns({"prefix_bucket": F.floor(F.col(order) / BUCKET)} | {held[n]: v.cast("long") for n, v in values.items()})
    sums = rows.groupBy("prefix_bucket").agg(*(F.sum(c).alias(c) for c in held.values()))
    before = Window.orderBy("prefix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("prefix_bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_offset") for c in held.values()))
    inner = Window.partitionBy("prefix_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, "prefix_bucket")
    rows = rows.withColumns({n: F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in held.items()})
    return rows.drop("prefix_bucket", *held.values(), *(f"{c}_offset" for c in held.values()))


def _in_buckets(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("prefix_bucket", F.floor(F.col(order) / BUCKET))


def _with_other_buckets(rows: DataFrame, key: str, order: str, found: dict[str, tuple], combine) -> DataFrame:
    """Adds for each name an aggregate over all buckets of the key before, or after, the row's own; null if there are none.

    `found` has (aggregate, whether after) by name. Only keys that reach beyond one bucket are summed up; each of
    their buckets sends one row, and one task holds those of a key.
    """
    long = rows.where(F.col(order) >= BUCKET).select(key).distinct()
    sums = rows.join(long, key, "left_semi").groupBy(key, "prefix_bucket").agg(*(v.alias(f"{n}_other") for n, (v, _) in found.items()))
    buckets = Window.partitionBy(key).orderBy("prefix_bucket")
    sides = {False: buckets.rowsBetween(Window.unboundedPreceding, -1), True: buckets.rowsBetween(1, Window.unboundedFollowing)}
    sums = sums.select(key, "prefix_bucket", *(combine(F.col(f"{n}_other")).over(sides[after]).alias(f"{n}_other") for n, (_, after) in found.items()))
    return rows.join(sums, [key, "prefix_bucket"], "left")


def sums_within(rows: DataFrame, key: str, order: str, values: dict[str, Column], most: int | None = None) -> DataFrame:
    """Adds the sums of the values over all rows of the same key with a smaller `order` (dense from 0 for each key).

    A key's rows are summed in buckets of BUCKET, so a key with most of the rows is spread over many tasks. `most` may say
    how many rows a key has at most, where that is known: if they fit in one bucket there is nothing to add.
    """
    if most is not None and most <= BUCKET:
        whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({n: F.coalesce(F.sum(v.cast("long")).over(whole), F.lit(0)) for n, v in values.items()})
    rows = _in_buckets(rows, order).withColumns({f"{n}_value": v.cast("long") for n, v in values.items()})
    rows = _with_other_buckets(rows, key, order, {n: (F.sum(f"{n}_value"), False) for n in values}, F.sum)
    inner = Window.partitionBy(key, "prefix_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.col(f"{n}_other"), F.lit(0)) + F.coalesce(F.sum(f"{n}_value").over(inner), F.lit(0)) for n in values})
    return rows.drop("prefix_bucket", *(f"{n}_{x}" for n in values for x in ("value", "other")))


def least_beside(rows: DataFrame, key: str, order: str, value: Column, before: str, after: str) -> DataFrame:
    """Adds the least value over all rows of the key with a smaller `order`, and over those with a greater one; nulls
    don't count. Buckets as in sums_within."""
    rows = _in_buckets(rows, order).withColumn("beside_value", value)
    rows = _with_other_buckets(rows, key, order, {before: (F.min("beside_value"), False), after: (F.min("beside_value"), True)}, F.min)
    inner = Window.partitionBy(key, "prefix_bucket").orderBy(order)
    rows = rows.withColumns({before: F.least(f"{before}_other", F.min("beside_value").over(inner.rowsBetween(Window.unboundedPreceding, -1))), after: F.least(f"{after}_other", F.min("beside_value").over(inner.rowsBetween(1, Window.unboundedFollowing)))})
    return rows.drop("prefix_bucket", "beside_value", f"{before}_other", f"{after}_other")


def with_next(rows: DataFrame, key: str, order: str, columns: dict[str, str], most: int | None = None) -> DataFrame:
    """Adds the columns of the next row of the key (named by the dict's values), null for the last one.

    The first row of every bucket but the first is seen in the bucket before too. `most` as in sums_within.
    """
    if most is not None and most <= BUCKET:
        whole = Window.partitionBy(key).orderBy(order)
        return rows.withColumns({new: F.lead(old).over(whole) for old, new in columns.items()})
    bucket = F.floor(F.col(order) / BUCKET)
    seen = F.when((F.col(order) % BUCKET == 0) & (F.col(order) > 0), F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    rows = rows.withColumn("prefix_bucket", F.explode(seen))
    inner = Window.partitionBy(key, "prefix_bucket").orderBy(order)
    rows = rows.withColumns({new: F.lead(old).over(inner) for old, new in columns.items()})
    return rows.where(F.col("prefix_bucket") == bucket).drop("prefix_bucket")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="braid-shared-")
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: computed once, and safe from lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Small sides are broadcast up to this number of rows, else joined by shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most so many rows, which are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds dense numbers from 0 in the given order: rows are sorted by range, each partition numbers its own.

    The rows are checkpointed with their partition's number, as two readings might be partitioned differently.
    The order should be total; equal rows are numbered in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"number_part": F.spark_partition_id(), "number_local": local}))
    counts = rows.groupBy("number_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("number_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("number_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("number_first"))
    # One row a partition.
    return rows.join(F.broadcast(offsets), "number_part").withColumn(name, F.col("number_first") + F.col("number_local")).drop("number_part", "number_local", "number_first")
