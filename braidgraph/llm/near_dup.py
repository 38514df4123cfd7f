"""Near-duplicate classes by DartMinHash signatures and banded joining.

Equal texts meet by a 128-bit key of their words and count once from then on. Each distinct text gets
a signature; texts that agree in all coordinates of a band share a bucket. Every member of a bucket is
compared with three hubs: the most central member (the one whose buckets are fullest: the original
of a group of copies shares most buckets), the least and the greatest. That settles buckets of up to
three. In larger buckets that still hold several components, the members outside the largest one meet all
members in pairs of blocks: first by signature alone, which tells the members that have a likely partner in the other
block, then those with their texts. A task sends members, or links that join two components, so its output grows with
its members, not their pairs. All pairs are verified on the words themselves before they link, and the classes are the
connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import free_prefix
from .components import bounded, components
from .darts import band_keys, shingles, signatures, similarity, text_keys
from .storage import packed, scratch, stored, written
from .textcols import blocks

#: Tables of nodes (about 60 bytes a row) are broadcast up to this number of rows, else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows that one task handles at least: signatures (about 800 bytes, a pair of them 1200), signatures to compare with a
#: whole block, texts, pairs of texts to verify, buckets.
TASK_SIGNATURES, TASK_COMPARED, TASK_TEXTS, TASK_PAIRS, TASK_BUCKETS = 4096, 2048, 1024, 1024, 65_536


@dataclass(frozen=True)
class Plan:
    """Words a shingle, least weighted Jaccard similarity, and the signature's bands times rows.

    With 24 bands of 6 rows a pair of similarity 0.8 shares a bucket with probability 0.9993, one of
    0.5 with 0.31. `likely` is the share of agreeing coordinates from which a pair is verified: 4.5
    standard deviations below 0.8.
    """

    size: int = 5
    least: float = 0.8
    bands: int = 24
    rows: int = 6
    likely: float = 0.65
    block: int = 512
    seed: int = 1


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    n = len(values)
    raw = np.ascontiguousarray(values).tobytes()
    width = len(raw) // n if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(raw)])


def signed(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """doc, text_key (md5), node (key of the text's words, null without words), sig, bands; one row a document."""
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("text_key", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    k = plan.bands * plan.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in blocks(b.column(1)):
                n = len(offsets) - 1
                high, low, counts = text_keys(data, offsets)
                sig = signatures(*shingles(data, offsets, plan.size), n, k, plan.seed)
                keys = band_keys(sig, plan.bands).view(np.int64)
                node = _fixed(np.stack([high, low], axis=1))
                if (counts == 0).any():
                    node = pc.if_else(pa.array(counts > 0), node, pa.nulls(n, pa.binary()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * plan.bands, plan.bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(2).slice(at, n), node, _fixed(sig), lists], schema.names)

    return stored(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), _text_key(text_col)), "dup-rows", run, schema)


def _text_key(text_col: str):
    return F.unhex(F.md5(text_col)).alias("text_key")


def _agreeing(pairs: DataFrame, most: int, sigs: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs u, v whose signatures agree in enough coordinates; most: the pairs and signatures, or more."""
    k = plan.bands * plan.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, k) for i in (2, 3))
                yield b.select(["u", "v"]).filter(pa.array((a == c).sum(axis=1) >= plan.likely * k))

    left, right = (sigs.select(F.col("node").alias(n), F.col("sig").alias(f"sig_{n}")) for n in "uv")
    rows = pairs.join(left, "u").join(right, "v").select("u", "v", "sig_u", "sig_v")
    return stored(packed(rows, most, TASK_SIGNATURES), "dup-likely", run, T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())]))


def _texts(nodes: DataFrame, most: int, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and one of its texts for each of the nodes, of which there are `most`, repeated ones included. A row is known
    by its text's hash, so ids may repeat or be null."""
    named = stored(packed(nodes.select("node").distinct(), most), "dup-named")
    most = named.braid_rows
    named = bounded(named, BROADCAST_ROWS)
    some = rows.join(named, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    some = bounded(stored(packed(some, rows.braid_rows), "dup-some"), BROADCAST_ROWS)
    texts = docs.select(_text_key(text_col), F.col(text_col).alias("text")).join(some, "text_key").select("node", "text")
    return stored(packed(texts.groupBy("node").agg(F.first("text").alias("text")), most, TASK_TEXTS), "dup-texts")


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """u, v, similarity of the pairs that are similar enough, by the words of one text of each node."""
    schema = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType()), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                (_, da, oa), (_, db, ob) = (next(blocks(part.column(c), 1 << 62)) for c in (2, 3))
                sim = similarity(da, oa, db, ob, plan.size)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], schema.names)
                yield out.filter(pa.array(sim >= plan.least))

    most = pairs.braid_rows
    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("node")), 2 * most, docs, rows, id_col, text_col)
    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    return stored(packed(both, most, TASK_PAIRS), "dup-links", run, schema)


def _likely(left: pa.Table, right: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the left, and of the right, have a partner of another label whose signature agrees in enough places."""
    k = plan.bands * plan.rows
    (ls, ll), (rs, rl) = ((np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, k), t["label"].to_pylist()) for t in (left, right))
    names = {x: i for i, x in enumerate({*ll, *rl})}
    ll, rl = (np.array([names[x] for x in side]) for side in (ll, rl))
    rows, columns = np.zeros(len(ls), bool), np.zeros(len(rs), bool)
    for i, s in enumerate(ls):
        found = ((rs == s).sum(axis=1) >= plan.likely * k) & (rl != ll[i])
        rows[i] = found.any()
        columns |= found
    return rows, columns


def _joining(left: pa.Table, right: pa.Table, plan: Plan) -> tuple[list, list]:
    """Verified links between members of two blocks that join components which no link before them joined."""
    k = plan.bands * plan.rows

    def side(t: pa.Table):
        _, data, offsets = next(blocks(t["text"], 1 << 62))
        row, key, count = shingles(data, offsets, plan.size)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, k)
        return t["node"].to_pylist(), t["label"].to_pylist(), sig, (row, key, count, np.searchsorted(row, np.arange(len(t) + 1)), np.bincount(row, count, len(t)))

    (ln, ll, ls, (_, lkey, lcount, lcut, ltotal)), (rn, rl, rs, (rrow, rkey, rcount, _, rtotal)) = side(left), side(right)
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    agree = np.stack([(rs == s).sum(axis=1) for s in ls])
    u, v = [], []
    # Central members first: their links join most, and joined pairs need no look.
    for i in np.argsort(-(agree >= plan.likely * k).sum(axis=1), kind="stable"):
        own = root(ll[i])
        likely = np.array([j for j in np.flatnonzero(agree[i] >= plan.likely * k) if root(rl[j]) != own], np.int64)
        if not len(likely):
            continue
        key, count = lkey[lcut[i] : lcut[i + 1]], lcount[lcut[i] : lcut[i + 1]]
        at = np.minimum(np.searchsorted(key, rkey), len(key) - 1)
        common = np.bincount(rrow, np.where(key[at] == rkey, np.minimum(count[at], rcount), 0), len(rn))
        similar = common / (ltotal[i] + rtotal - common) >= plan.least
        for j in likely[similar[likely]]:
            a, b = root(ll[i]), root(rl[j])
            if a != b:
                parent[a] = b
                u.append(max(ln[i], rn[j]))
                v.append(min(ln[i], rn[j]))
    return u, v


def _rest(members: DataFrame, labels: DataFrame, sigs: DataFrame, texts_of, plan: Plan) -> DataFrame:
    """Links u, v between members of one bucket in different components: those outside the bucket's largest
    component against all, block by block. texts_of(nodes, how many): a text for each of them."""
    most = members.count()
    pair = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])
    placed = members.join(bounded(labels, BROADCAST_ROWS), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("most")).where("parts > 1")
    buckets = stored(packed(buckets.select("bucket", "members", F.col("most.label").alias("most")), most), "dup-open")
    rows = stored(placed.join(bounded(buckets, BROADCAST_ROWS), "bucket"), "dup-open-members")
    if rows.isEmpty():
        return members.sparkSession.createDataFrame([], pair)
    n_blocks = F.ceil(F.col("members") / plan.block).cast("int")
    rows = rows.withColumns({"own": F.pmod(F.xxhash64("node"), n_blocks).cast("int"), "all": F.sequence(F.lit(0), n_blocks - 1), "outside": F.col("label") != F.col("most")})
    held = rows.where("outside").select("bucket", F.col("own").alias("left_block"), "members").distinct()
    held = stored(packed(held, most), "dup-blocks")
    n_dealt = (rows.where("outside").agg(F.sum(n_blocks)).first()[0] or 0) + (held.agg(F.sum("members")).first()[0] or 0)
    rows = rows.join(sigs.select("node", "sig"), "node")
    # The left side goes to every block of the right side; the right side to every block that some outsider is in.
    lefts = rows.where("outside").select("bucket", F.col("own").alias("left_block"), F.explode("all").alias("right_block"), F.lit(True).alias("is_left"), "node", "label", "sig")
    rights = rows.select("bucket", F.col("own").alias("right_block"), F.lit(False).alias("is_left"), "node", "label", "sig").join(bounded(held, BROADCAST_ROWS), "bucket").select(*lefts.columns)

    dealt = lefts.unionByName(rights)
    met = T.StructType([*(dealt.schema[c] for c in ("bucket", "left_block", "right_block", "is_left", "node", "label", "sig"))])

    def able(table: pa.Table) -> pa.Table:
        """The rows of a pair of blocks that have a likely partner of another component on the other side."""
        left, right = (table.filter(pc.equal(table["is_left"], x)) for x in (True, False))
        if not len(left) or not len(right):
            return table.slice(0, 0)
        rows, columns = _likely(left, right, plan)
        return pa.concat_tables([left.filter(pa.array(rows)), right.filter(pa.array(columns))])

    # Texts go only to pairs of blocks where they have somebody to be compared with.
    dealt = dealt.groupBy("bucket", "left_block", "right_block").applyInArrow(able, met)
    dealt = written(packed(dealt, n_dealt, TASK_COMPARED), "dup-able")
    able_rows = dealt.count()
    if not able_rows:
        return members.sparkSession.createDataFrame([], pair)
    dealt = dealt.join(texts_of(dealt.select("node"), able_rows), "node")

    def run(table: pa.Table) -> pa.Table:
        left, right = (table.filter(pc.equal(table["is_left"], x)) for x in (True, False))
        u, v = _joining(left, right, plan) if len(left) and len(right) else ([], [])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return packed(dealt.groupBy("bucket", "left_block", "right_block").applyInArrow(run, pair).distinct(), able_rows)


def _classes(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, node), and node with class_id for the nodes of more than one row."""
    with scratch(docs.sparkSession) as keep:
        rows, classes = _classed(docs, id_col, text_col, plan)
        return keep(rows).select("doc", "node"), keep(classes)


def _classed(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> tuple[DataFrame, DataFrame]:
    rows = signed(docs, id_col, text_col, plan)
    n_rows = rows.braid_rows
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = stored(packed(nodes, n_rows, TASK_SIGNATURES), "dup-nodes")
    members = nodes.select("node", F.explode_outer("bands").alias("bucket")).where("bucket IS NOT NULL")
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = stored(packed(full, n_rows * plan.bands, TASK_BUCKETS), "dup-buckets")
    members = stored(members.join(bounded(full, BROADCAST_ROWS), "bucket"), "dup-members")
    n_members = members.braid_rows
    central = bounded(stored(packed(members.groupBy("node").agg(F.sum("n").alias("met")), n_members), "dup-central"), BROADCAST_ROWS)
    hubs = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high"))
    hubs = stored(packed(hubs.select("bucket", F.col("hub.node").alias("hub"), "low", "high"), n_members), "dup-hubs")

    ordered = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    stars = members.join(bounded(hubs, BROADCAST_ROWS), "bucket").select(F.col("node").alias("u"), F.explode(F.array_distinct(F.array("hub", "low", "high"))).alias("v")).where("u <> v").select(*ordered).distinct()
    likely = _agreeing(stars, n_rows + 3 * n_members, nodes, plan)
    links = _verified(likely, docs, rows, id_col, text_col, plan)
    # Rows with equal ids are one document, whatever their texts.
    named = rows.where("doc IS NOT NULL AND node IS NOT NULL").groupBy("doc").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("doc", "v")
    named = bounded(stored(packed(named, n_rows), "dup-renamed"), BROADCAST_ROWS)
    same = rows.join(named, "doc").where("node <> v").select(F.col("node").alias("u"), "v")
    labels = stored(components(links.select("u", "v").unionByName(same), links.braid_rows + n_rows), "dup-labels")

    large = members.where("n > 3").select("bucket", "node")
    more = written(_rest(large, labels, nodes, lambda some, n: _texts(some, n, docs, rows, id_col, text_col), plan), "dup-rest")
    if not more.isEmpty():
        stars = labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
        both = stored(stars.unionByName(more), "dup-all-links")
        labels = stored(components(both, both.braid_rows), "dup-labels")

    # Only nodes of several rows or links need a class of their own; the others' class is their one document.
    counted = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    counted = counted.join(bounded(labels, BROADCAST_ROWS), "node", "left").where("n > 1 OR label IS NOT NULL")
    counted = stored(packed(counted.select("node", F.coalesce("label", "node").alias("label"), "least"), n_rows), "dup-counted")
    least = counted.groupBy("label").agg(F.min("least").alias("class_id"))
    least = bounded(stored(packed(least, n_rows), "dup-least"), BROADCAST_ROWS)
    return rows, stored(packed(counted.join(least, "label").select("node", "class_id"), n_rows), "dup-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per document: its id and class_id, the least id among its exact and near copies, itself included.

    Texts are compared as sequences of lower-cased words. A text without words (null, empty, white
    space) has no copies and is a class of its own; a shorter text than a shingle is one shingle. Rows with
    equal ids are one document. Null ids: class_id is the least id among the copies that have one, null if none has.
    Other columns are not read. An empty table gives no rows.
    """
    rows, classes = _classes(docs, id_col, text_col, plan)
    rows = rows.join(bounded(classes, BROADCAST_ROWS), "node", "left")
    return rows.select(F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One document of each class, with all its columns: the one with the least id. Rows with a null id stay.

    Of rows that repeat the id that stays, one stays.
    """
    classed = stored(near_duplicates(docs, id_col, text_col, plan).withColumnRenamed(id_col, "dup_doc"), "dup-classed")
    gone = classed.where("dup_doc <> class_id").select("dup_doc").distinct()
    gone = bounded(stored(packed(gone, classed.braid_rows), "dup-gone"), BROADCAST_ROWS)
    rest = docs.join(gone, docs[id_col] == gone["dup_doc"], "left_anti")
    repeated = bounded(stored(classed.where("dup_doc IS NOT NULL AND dup_doc = class_id").groupBy("dup_doc").count().where("count > 1").select("dup_doc"), "dup-repeated"), BROADCAST_ROWS)
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    once = rest.join(repeated, rest[id_col] == repeated["dup_doc"], "left_semi")
    place = f"{free_prefix(docs.columns, 'dup_')}place"
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(*(F.col(c) for c in docs.columns if c != id_col)))
    once = once.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)
    return rest.join(repeated, rest[id_col] == repeated["dup_doc"], "left_anti").select(*docs.columns).unionByName(once)
