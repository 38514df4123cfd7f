"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions of a window that are hashed and leaves the others free. Windows of
the test items and of the documents that agree at the named positions meet by their hash; every
hit fixes a diagonal (place in the document less place in the item). Around the hit the tokens of item
and document are compared along the diagonal, and the best run of `window` places counts, so substituted words
cost only themselves, and words that agree by chance elsewhere on a long item count for nothing. Equal texts
are compared once. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free_prefix, let
from .components import bounded
from .storage import scratch, written

SPACES = r"[\x20\x09-\x0D]+"
#: Hashes of the benchmark are broadcast up to this number (16 bytes and some overhead each), else joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Texts with hits, and parts of items, are looked up by a broadcast up to this number, else by a shuffle.
BROADCAST_HITS = 200_000
#: Words of a document that are compared from one row, besides those of the run around a hit.
STRETCH = 128


@dataclass(frozen=True)
class Seeds:
    """Masks (places in a window that count) and what a diagonal needs to be an overlap.

    Document and item overlap if on some diagonal at least ceil(share * window) tokens agree within `window`
    neighbouring places of the item; on an item of fewer tokens, ceil(share * n) of all n; an item shorter than the
    longest mask must occur whole. These masks hit every such run, whichever places agree: with 18 places and 13 to
    agree, or n from 10 to 17, each choice of places that agree holds some mask (tests count all of them).
    """

    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4), (0, 2, 5, 6), (0, 2, 3, 8), (0, 4, 7, 9), (0, 1, 7, 8))
    share: float = 0.7
    window: int = 18

    @property
    def span(self) -> int:
        return max(m[-1] for m in self.masks) + 1


def tokens(text: Column) -> Column:
    """Lower-cased words of a text; none for a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), "")


def _window_hashes(hashed: Column, seeds: Seeds) -> list[Column]:
    """For each mask, the hash at every place of the window; empty if the text is shorter than the mask."""
    return [_hashes_at(hashed, mask, no) for no, mask in enumerate(seeds.masks)]


def _hashes_at(hashed: Column, mask: tuple[int, ...], salt: int) -> Column:
    reach = mask[-1]
    places = F.sequence(F.lit(0), F.size(hashed) - 1 - reach)
    each = F.transform(places, lambda i: F.xxhash64(F.lit(salt), *(F.get(hashed, i + k) for k in mask)))
    return F.when(F.size(hashed) > reach, each).otherwise(F.array().cast("array<bigint>"))


def _seeds(rows: DataFrame, key: str, seeds: Seeds, exact: list[int]) -> DataFrame:
    """key, size, flat, seed for every window of every mask, and for whole runs of the lengths in `exact`.

    size is the text's number of words, flat the place in all parts one after the other.
    """
    def parts(hashed: Column) -> Column:
        each = _window_hashes(hashed, seeds) + [_hashes_at(hashed, tuple(range(n)), -n) for n in exact]
        return F.struct(F.size(hashed).alias("size"), F.concat(*each).alias("seeds"))

    joined = rows.select(key, let(F.transform("words", lambda w: F.xxhash64(w)), parts).alias("p"))
    # Outer, with the nulls dropped after: else the optimiser filters by a second copy of the whole expression.
    return joined.select(key, "p.size", F.posexplode_outer("p.seeds").alias("flat", "seed")).where("seed IS NOT NULL")


def _lengths(seeds: Seeds, exact: list[int]) -> list[int]:
    """How many words a window of each part reaches over."""
    return [m[-1] + 1 for m in seeds.masks] + exact


def _place(flat: Column, size: Column, lengths: list[int]) -> tuple[Column, Column]:
    """The part that an element of the joined parts comes from, and its place there."""
    part, place, before = F.lit(0), flat, F.lit(0)
    for j, n in enumerate(lengths[:-1]):
        before = before + F.greatest(size - (n - 1), F.lit(0))
        part, place = F.when(flat >= before, j + 1).otherwise(part), F.when(flat >= before, flat - before).otherwise(place)
    return part, place


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seeds: Seeds = Seeds()) -> DataFrame:
    """One row for each document and item that overlap: their ids, n_matched (most tokens that agree within
    `seeds.window` neighbouring places of the item), n_item (tokens of the item).

    Items shorter than the longest mask must occur whole. Null or empty texts overlap nothing; documents
    with equal ids, null ones too, are taken for one, by the best of their texts; items with equal words are compared
    once and reported each. Other columns are not read; empty tables give no rows.
    """
    with scratch(docs.sparkSession) as keep:
        found, listed = _overlaps(docs.select(F.col(text_col).alias("text")), items, item_col, item_text_col, seeds)
        found, listed = keep(found), keep(listed)
    named = docs.select(F.col(id_col).alias("doc"), F.md5(text_col).alias("text_key")).join(bounded(found, BROADCAST_HITS), "text_key").join(listed.select("form", "item"), "form")
    best = named.groupBy("doc", "item").agg(F.max("n_matched").alias("n_matched"), F.first("n_item").alias("n_item"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_matched", "n_item")


def _overlaps(texts: DataFrame, items: DataFrame, item_col: str, item_text_col: str, seeds: Seeds) -> tuple[DataFrame, DataFrame]:
    """text_key (md5 of the text), form (of an item's words), n_matched, n_item of what overlaps; item and form of the items."""
    listed = items.select(F.col(item_col).alias("item"), tokens(F.col(item_text_col)).alias("words")).where("size(words) > 0")
    listed = written(listed.withColumn("form", F.sha2(F.concat_ws(" ", "words"), 256)), "bench-items")
    forms = listed.groupBy("form").agg(F.first("words").alias("words"))
    exact = sorted(r[0] for r in forms.where(F.size("words") < seeds.span).select(F.size("words")).distinct().collect())
    lengths = _lengths(seeds, exact)
    part, place = _place(F.col("flat"), F.col("size"), lengths)

    # A short item counts by its whole run only, so that its windows don't find what can't be verified.
    known = _seeds(forms, "form", seeds, exact).withColumn("part", part)
    is_mask = F.col("part") < len(seeds.masks)
    length = F.get(F.array(*map(F.lit, lengths)), F.col("part"))
    known = known.where((F.col("size") >= seeds.span) & is_mask | (F.col("size") < seeds.span) & ~is_mask & (length == F.col("size")))
    known = bounded(written(known.select("form", place.alias("item_pos"), "seed").distinct(), "bench-seeds"), BROADCAST_SEEDS)

    # A hit at place q of the item lies in the zone q div w; all runs of w places that hold it lie in the zone's reach.
    w = seeds.window
    texts = texts.select(F.md5("text").alias("text_key"), tokens(F.col("text")).alias("words"))
    hits = _seeds(texts, "text_key", seeds, exact).join(known, "seed")
    hits = hits.select("text_key", "form", (place - F.col("item_pos")).alias("diagonal"), F.floor(F.col("item_pos") / w).cast("int").alias("zone")).distinct()
    hits = written(hits, "bench-hits")

    begin = F.col("zone") * w - (w - 1)
    zones = forms.select("form", F.size("words").alias("n_item"), "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / w).cast("int"))).alias("zone"))
    zones = zones.select("form", "zone", "n_item", F.transform(F.sequence(begin, begin + 3 * w - 3), lambda i: F.get("words", i)).alias("item_words"))
    zones = bounded(written(zones, "bench-zones"), BROADCAST_HITS)
    # Hits meet the stretch of the text that they begin in; texts without hits, and repeated texts, send nothing.
    wanted = bounded(written(hits.select("text_key").distinct(), "bench-met"), BROADCAST_HITS)
    last = F.floor((F.size("words") - 1) / STRETCH).cast("int")
    stretches = F.transform(F.sequence(F.lit(-1), last), lambda n: F.struct(n.alias("stretch"), F.transform(F.sequence(n * STRETCH, (n + 1) * STRETCH + 3 * w - 3), lambda i: F.get("words", i)).alias("words")))
    # The stretches are cut before rows are made of them: a row that carried the whole text for each would be quadratic.
    met = texts.join(wanted, "text_key", "left_semi").select("text_key", F.explode(stretches).alias("cut")).select("text_key", "cut.stretch", "cut.words").dropDuplicates(["text_key", "stretch"])

    pairs = hits.join(zones, ["form", "zone"]).withColumn("at", begin + F.col("diagonal"))
    pairs = pairs.withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("int")).join(met, ["text_key", "stretch"])
    shift = (F.col("at") - F.col("stretch") * STRETCH).cast("int")
    agree = F.filter(F.sequence(F.lit(0), F.lit(3 * w - 3)), lambda k: F.get("item_words", k) == F.get("words", k + shift))
    needed = F.when(F.col("n_item") < seeds.span, F.col("n_item")).otherwise(F.ceil(F.least(F.col("n_item"), F.lit(w)) * seeds.share))
    rows = pairs.select("text_key", "form", "n_item", agree.alias("agree"), needed.alias("needed")).where(F.size("agree") >= F.col("needed"))
    within = F.transform("agree", lambda a: F.size(F.filter("agree", lambda b: (b >= a) & (b < a + w))))
    rows = rows.withColumn("n_matched", F.array_max(within)).where("n_matched >= needed")
    found = rows.groupBy("text_key", "form").agg(F.max("n_matched").cast("long").alias("n_matched"), F.first("n_item").cast("long").alias("n_item"))
    return written(found, "bench-overlaps"), listed


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seeds: Seeds = Seeds()) -> DataFrame:
    """The documents, all columns unchanged, whose text overlaps no item."""
    with scratch(docs.sparkSession) as keep:
        found, _ = _overlaps(docs.select(F.col(text_col).alias("text")), items, item_col, item_text_col, seeds)
        found = keep(found)
    key = f"{free_prefix(docs.columns, 'bench_')}key"
    gone = bounded(written(found.select(F.col("text_key").alias(key)).distinct(), "bench-found"), BROADCAST_HITS)
    # A null text has no key, finds nothing, and stays.
    return docs.withColumn(key, F.md5(text_col)).join(gone, key, "left_anti").select(*docs.columns)


#: The same rows by comparing all words of all documents and items, without masks.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
it AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM i),
m AS (SELECT DISTINCT doc_id, item_id, n, pos - j AS diagonal, j FROM dt JOIN it USING (word)),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND 17 FOLLOWING) AS c FROM m)
SELECT doc_id, item_id, CAST(max(c) AS BIGINT) AS n_matched, CAST(any_value(n) AS BIGINT) AS n_item FROM s
WHERE c >= CASE WHEN n < 10 THEN n ELSE ceil(0.7 * least(n, 18)) END GROUP BY doc_id, item_id
"""
