"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory maps.

Training, in buckets of a hash, one for BUCKET_BYTES of text and at least as many as shuffle partitions:
1. Tasks count 64-bit word hashes and send compressed, sorted runs; each bucket merges its runs to a
   sorted hash array with counts. A word's number is its place in all buckets one after the other.
2. Tasks look words up in the memory-mapped arrays and send runs of (context, word) numbers; each
   bucket merges them to a sorted array with counts, and sums up its contexts. A context that is so
   frequent that its pairs would overfill a bucket is split by word; there are at most four times as
   many of them as buckets.
3. Per word, the distinct contexts are summed: the continuation counts of the lower order.
Files lie in the shared folder. Scoring maps them and keeps nothing but the pages it touches.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh, map_arrow, mapped, read_range, remove, scratch, write_bytes, written
from .textcols import LOWER_KEYS, blocks, hashes, mix, per_row, words

#: The token at the end of every text.
END = np.uint64(0x9D5C1B3F27A86E41)
#: Counted keys that a task gathers before it sends them.
GATHERED = 3_000_000
#: Bytes of training text that one bucket is made for, so that a bucket fits in a task however large the corpus is.
BUCKET_BYTES = 64 << 20
HOT_SHARE = 4
RUN = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.BinaryType())])
_U = np.uint64


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, byte planes one after the other."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run of keys with counts: gaps and counts, compressed."""
    import zstandard

    gaps = np.diff(keys, prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(_pack(gaps) + _pack(counts))


def unpack_run(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    half = len(raw) // 2
    return np.cumsum(_unpack(raw[:half]), dtype=np.uint64), _unpack(raw[half:])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys.astype(np.uint64), counts.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    place = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[place], np.add.reduceat(counts[order].astype(np.uint64), place)


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack_run(b) for b in blobs]
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


class _Gather:
    """Counts keys over blocks and gives runs by bucket when it holds enough."""

    def __init__(self, bucket_of):
        self.bucket_of, self.parts, self.held = bucket_of, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held >= GATHERED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.held = [], 0
            bucket = self.bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                chosen = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[chosen[0]])], pa.int32()), pa.array([pack_run(keys[chosen], counts[chosen])], pa.binary())], RUN.names)


def by_range(hashed: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash; buckets one after the other hold the hashes in order."""
    return (((hashed >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: lower-cased words, then END, text by text."""
    starts, ends, rows = words(data, offsets)
    n = len(offsets) - 1
    counts = per_row(rows, n)
    total = len(rows) + n
    last = np.cumsum(counts + 1) - 1
    hashed = np.empty(total, np.uint64)
    inner = np.ones(total, bool)
    inner[last] = False
    hashed[inner] = hashes(data, starts, ends, LOWER_KEYS)
    hashed[last] = END
    return hashed, np.repeat(np.arange(n), counts + 1)


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON (name, type, length of each array), padded to 64 bytes, then the arrays."""
    head = json.dumps([(k, v.dtype.str, len(v)) for k, v in arrays.items()]).encode()
    size = -(-(len(head) + 9) // 64) * 64
    write_bytes(path, [b"%08d" % size, head.ljust(size - 8), *(np.ascontiguousarray(v).tobytes().ljust(-(-v.nbytes // 64) * 64, b"\0") for v in arrays.values())])


def _load(path: str) -> dict[str, np.ndarray]:
    data = mapped(path)
    size = int(data[:8])
    out, at = {}, size
    for name, kind, n in json.loads(bytes(data[8:size])):
        out[name] = np.frombuffer(data, np.dtype(kind), n, at)
        at += -(-out[name].nbytes // 64) * 64
    return out


class Vocabulary:
    """Word numbers, counts and continuation counts, mapped from the bucket files."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.n = folder, len(sizes)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.size = int(self.first[-1])
        self.files: dict[int, dict] = {}

    def bucket(self, b: int) -> dict:
        if b not in self.files:
            self.files[b] = _load(f"{self.folder}/words-{b}")
        return self.files[b]

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; -1 for unknown ones."""
        out = np.full(len(hashed), -1, np.int64)
        for b, lo, hi in _slices(by_range(hashed, self.n)):
            if self.first[b] == self.first[b + 1]:
                continue
            held = self.bucket(b)["hash"]
            at = np.searchsorted(held, hashed[lo:hi])
            fits = at < len(held)
            fits[fits] = held[at[fits]] == hashed[lo:hi][fits]
            out[lo:hi] = np.where(fits, at + self.first[b], -1)
        return out

    def counts(self, numbers: np.ndarray, name: str = "count") -> np.ndarray:
        """A column of the words of sorted numbers; 0 for -1."""
        out = np.zeros(len(numbers), np.int64)
        where = np.searchsorted(self.first, numbers, "right") - 1
        for b, lo, hi in _slices(where):
            if b >= 0:
                file = self.bucket(b) if name == "count" else self.continued(b)
                out[lo:hi] = file[name][numbers[lo:hi] - self.first[b]]
        return out

    def continued(self, b: int) -> dict:
        if ~b not in self.files:
            self.files[~b] = _load(f"{self.folder}/continued-{b}")
        return self.files[~b]


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of an array."""
    if len(bucket):
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[a]), int(a), int(b)


def pair_buckets(keys: np.ndarray, n: int, hot: dict[int, int]) -> np.ndarray:
    """The bucket of a pair: by its context, and for a hot context by one of its parts."""
    context = keys >> _U(32)
    out = mix(context) % _U(n)
    if hot:
        names = np.array(sorted(hot), np.uint64)
        parts = np.array([hot[int(x)] for x in names], np.uint64)
        at = np.minimum(np.searchsorted(names, context), len(names) - 1)
        is_hot = names[at] == context
        out[is_hot] = (out[is_hot] + mix(keys[is_hot] & _U(0xFFFFFFFF)) % parts[at[is_hot]]) % _U(n)
    return out.astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts; steady values where a corpus has too few."""
    if min(n1, n2, n3, n4) == 0:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(found)]


def _grouped(runs: DataFrame, reduce, schema: T.StructType) -> DataFrame:
    return runs.groupBy("bucket").applyInArrow(reduce, schema)


def is_training(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 != 0


def train(texts: DataFrame) -> dict:
    """Count a model over a table of one text column; returns its description (paths and a few numbers)."""
    with scratch(texts.sparkSession):
        return _trained(texts)


def delete_model(spark, model: dict) -> None:
    """Remove a model's files. Nothing else does: a model outlives the query that scores with it."""
    remove(spark, model["folder"])


def _trained(texts: DataFrame) -> dict:
    spark = texts.sparkSession
    folder = fresh(spark, "kneser-ney")
    size = texts.agg(F.sum(F.octet_length(texts.columns[0])).alias("n")).first()["n"] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(lambda keys: by_range(keys, n))
        for b in batches:
            for _, data, offsets in blocks(b.column(0)):
                yield from gather.add(_tokens(data, offsets)[0])
        yield from gather.flush()

    meta = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("total", T.LongType()), T.StructField("most", T.ArrayType(T.LongType()))])

    def merge_words(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        hashed, counts = merged(group["keys"].to_pylist())
        _save(f"{folder}/words-{bucket}", {"hash": hashed, "count": counts.astype(np.int64)})
        return pa.table([pa.array([bucket], pa.int32()), pa.array([len(hashed)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([[]], pa.list_(pa.int64()))], names=meta.names)

    found = {r.bucket: r for r in written(_grouped(map_arrow(texts, count_words, RUN), merge_words, meta), "kn-words").collect()}
    sizes = [found[b].size if b in found else 0 for b in range(n)]
    total, vocabulary = sum(r.total for r in found.values()), sum(sizes)
    if vocabulary >= 2**32 - 1:
        raise ValueError("more than 2^32 - 2 distinct words")
    first = [sum(sizes[:b]) for b in range(n)]
    limit = total // (HOT_SHARE * n) + 1

    def hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                counts = _load(f"{folder}/words-{b}")["count"]
                for i in np.flatnonzero(counts >= limit):
                    yield pa.RecordBatch.from_arrays([pa.array([first[b] + int(i)], pa.int64()), pa.array([int(counts[i])], pa.int64())], ["word", "count"])

    listed = spark.createDataFrame([(b,) for b in sorted(found)], "bucket int").repartition(n) if found else spark.createDataFrame([], "bucket int")
    hot = {r.word: -(-r["count"] // limit) for r in map_arrow(listed, hot_words, "word long, count long").collect()}
    n_texts = texts.count()
    if n_texts >= limit:
        hot[vocabulary] = -(-n_texts // limit)  # the context at the beginning of every text

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(folder, sizes)
        gather = _Gather(lambda keys: pair_buckets(keys, n, hot))
        for b in batches:
            for _, data, offsets in blocks(b.column(0)):
                hashed, rows = _tokens(data, offsets)
                distinct, back = np.unique(hashed, return_inverse=True)
                numbers = known.find(distinct)[back]
                yield from gather.add(_pairs(numbers, rows, vocabulary))
        yield from gather.flush()

    pairs_meta = T.StructType([*RUN.fields, T.StructField("kind", T.IntegerType())])

    def merge_pairs(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        keys, counts = merged(group["keys"].to_pylist())
        context = keys >> _U(32)
        place = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        sums = [np.add.reduceat(x.astype(np.int64), place) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        names = context[place]
        hot_here = np.isin(names, np.array(sorted(hot), np.uint64))
        _save(f"{folder}/pairs-{bucket}", {"key": keys, "count": counts.astype(np.uint32), "context": names[~hot_here].astype(np.uint32), **{k: s[~hot_here].astype(np.int64 if k == "total" else np.uint32) for k, s in zip(("total", "n1", "n2", "n3"), sums, strict=True)}})
        note = {"of": [int((counts == i).sum()) for i in (1, 2, 3, 4)], "hot": [[int(x) for x in row] for row in zip(names[hot_here], *(s[hot_here] for s in sums), strict=True)], "pairs": len(keys)}
        word, distinct = np.unique(keys & _U(0xFFFFFFFF), return_counts=True)
        owner = np.searchsorted(np.array(first + [vocabulary]), word.astype(np.int64), "right") - 1
        out = [(bucket, json.dumps(note).encode(), 0)]
        for b, lo, hi in _slices(owner):
            out.append((b, pack_run(word[lo:hi] - _U(first[b]), distinct[lo:hi]), 1))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.int32()), strict=True)], names=pairs_meta.names)

    runs = written(_grouped(map_arrow(texts, count_pairs, RUN), merge_pairs, pairs_meta), "kn-pairs")
    notes = [json.loads(r["keys"].decode()) for r in runs.where("kind = 0").toLocalIterator()]
    pair_files = [r.bucket for r in runs.where("kind = 0").select("bucket").collect()]
    of = [sum(x["of"][i] for x in notes) for i in range(4)]
    contexts: dict[int, list[int]] = {}
    for x in notes:
        for word, *sums in x["hot"]:
            contexts[word] = [a + b for a, b in zip(contexts.get(word, [0] * 4), sums, strict=True)]

    low_meta = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("of", T.ArrayType(T.LongType())), T.StructField("total", T.LongType())])

    def merge_continued(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        words_, distinct = merged(group["keys"].to_pylist())
        column = np.zeros(sizes[bucket], np.int64)
        column[words_.astype(np.int64)] = distinct
        _save(f"{folder}/continued-{bucket}", {"contexts": column})
        return pa.table([pa.array([bucket], pa.int32()), pa.array([[int((column == i).sum()) for i in (1, 2, 3, 4)] + [int((column >= 3).sum())]], pa.list_(pa.int64())), pa.array([int(column.sum())], pa.int64())], names=low_meta.names)

    low = written(_grouped(runs.where("kind = 1").select(*RUN.names), merge_continued, low_meta), "kn-continued").collect()
    low_of = [sum(r.of[i] for r in low) for i in range(5)]
    return {"folder": folder, "buckets": n, "sizes": sizes, "total": total, "vocabulary": vocabulary, "pair_files": pair_files, "hot": {str(k): v for k, v in hot.items()}, "hot_contexts": {str(k): v for k, v in contexts.items()}, "high": discounts(*of), "low": discounts(*low_of[:4]), "low_counts": [low_of[0], low_of[1], low_of[4]], "low_total": sum(r.total for r in low), "pairs": sum(x["pairs"] for x in notes)}


def _pairs(numbers: np.ndarray, rows: np.ndarray, begin: int) -> np.ndarray:
    """Keys of (token before or the beginning, token); both are known words."""
    before = np.concatenate(([begin], numbers[:-1]))
    before[np.concatenate(([True], rows[1:] != rows[:-1]))] = begin
    return (before.astype(np.uint64) << _U(32)) | numbers.astype(np.uint64)


class Scorer:
    """Looks a model up in its mapped files."""

    def __init__(self, model: dict):
        self.m = model
        self.known = Vocabulary(model["folder"], model["sizes"])
        self.hot = {int(k): v for k, v in model["hot"].items()}
        self.pair_files = set(model["pair_files"])
        self.files: dict[int, dict] = {}
        low, n = model["low"], model["low_counts"]
        self.low_rest = sum(d * c for d, c in zip(low, n, strict=True)) / model["low_total"] if model["low_total"] else 1.0
        self.high = np.array([0.0, *model["high"]])
        self.low = np.array([0.0, *low])
        contexts = sorted((int(k), *v) for k, v in model["hot_contexts"].items())
        self.hot_names = np.array([c[0] for c in contexts], np.uint64)
        self.hot_total = np.array([c[1] for c in contexts], np.float64)
        self.hot_rest = np.array([sum(d * x for d, x in zip(model["high"], c[2:], strict=True)) for c in contexts], np.float64)

    def low_order(self, contexts: np.ndarray) -> np.ndarray:
        """P(word) from continuation counts, interpolated with the uniform distribution over the words and one unknown."""
        seen = np.maximum(contexts - self.low[np.minimum(contexts, 3)], 0) / max(1, self.m["low_total"])
        return seen + self.low_rest / (self.m["vocabulary"] + 1)

    def high_order(self, keys: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P(word | context) of distinct keys; `low` is P(word)."""
        out = low.copy()
        bucket = pair_buckets(keys, self.m["buckets"], self.hot)
        order = np.argsort(bucket, kind="stable")
        for b, lo, hi in _slices(bucket[order]):
            if b not in self.pair_files:
                continue
            chosen = order[lo:hi]
            if b not in self.files:
                self.files[b] = _load(f"{self.m['folder']}/pairs-{b}")
            file, key = self.files[b], keys[chosen]
            count = _column(file["key"], file["count"], key).astype(np.int64)
            context = key >> _U(32)
            names = file["context"]
            at = np.minimum(np.searchsorted(names, context.astype(names.dtype)), max(len(names) - 1, 0))
            fits = names[at] == context if len(names) else np.zeros(len(key), bool)
            total, rest = np.zeros(len(key)), np.ones(len(key))
            place = at[fits]
            total[fits] = file["total"][place]
            rest[fits] = self.high[1] * file["n1"][place] + self.high[2] * file["n2"][place] + self.high[3] * file["n3"][place]
            if len(self.hot_names):
                at = np.minimum(np.searchsorted(self.hot_names, context), len(self.hot_names) - 1)
                is_hot = self.hot_names[at] == context
                total[is_hot], rest[is_hot] = self.hot_total[at[is_hot]], self.hot_rest[at[is_hot]]
            seen = total > 0
            p = low[chosen]
            p[seen] = np.maximum(count[seen] - self.high[np.minimum(count[seen], 3)], 0) / total[seen] + rest[seen] / total[seen] * p[seen]
            out[chosen] = p
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score of each text."""
        m, n = self.m, len(offsets) - 1
        hashed, rows = _tokens(data, offsets)
        distinct, back = np.unique(hashed, return_inverse=True)
        numbers = self.known.find(distinct)
        by_number = np.argsort(numbers, kind="stable")
        counts, contexts = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        counts[by_number] = self.known.counts(numbers[by_number])
        contexts[by_number] = self.known.counts(numbers[by_number], "contexts")
        base = np.log10((counts + 0.1) / (m["total"] + 0.1 * (m["vocabulary"] + 1)))[back]
        low = self.low_order(contexts)
        # An unknown word has the number vocabulary + 1, which no pair has.
        number = np.where(numbers < 0, m["vocabulary"] + 1, numbers)[back]
        key, first, key_back = np.unique(_pairs(number, rows, m["vocabulary"]), return_index=True, return_inverse=True)
        score = np.log10(self.high_order(key, low[back[first]]))[key_back]
        return [per_row(rows, n), per_row(rows[(counts > 0)[back]], n), np.bincount(rows, base, n), np.bincount(rows, score, n)]


def _column(held: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(held, keys), max(len(held) - 1, 0))
    return np.where(held[at] == keys, values[at], 0) if len(held) else np.zeros(len(keys), np.int64)


@functools.lru_cache(maxsize=2)
def _scorer(described: str) -> Scorer:
    return Scorer(json.loads(described))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_tokens, n_known, base_score, score (log10 probability) and perplexity.

    A null or empty text is the end token alone. Rows with equal ids are scored one by one; other columns
    are not read; an empty table gives no rows. Without training texts every token has probability 1.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))])
    described_path = f"{model['folder']}/model.json"
    write_bytes(described_path, [json.dumps(model).encode()])
    length = len(json.dumps(model).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(read_range(described_path, 0, length).decode())
        for b in batches:
            for at, data, offsets in blocks(b.column(1)):
                columns = scorer.score(data, offsets)
                ids = b.column(0).slice(at, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns), pa.array(10.0 ** (-columns[3] / columns[0]))], schema.names)

    return map_arrow(docs.select(id_col, text_col), run, schema)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents whose crc32(id as text) mod 10 is not 0 and score all of them."""
    model = train(docs.where(is_training(id_col)).select(text_col))
    return score(docs, model, id_col, text_col).withColumns({"held_out": ~is_training(id_col), "train_tokens": F.lit(model["total"]).cast("long")})
