"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of an archive file; a payload that several pages share
is stored once, by the page with the smallest id, and the others become revisit records. Index: the
captures sorted by reversed-host URL key are cut into blocks of lines, each block is compressed, and
the sparse directory of an index file, at its end, keeps the first key and the place of each block. The table
of an archive has one row an index file. A look-up finds the file among the sorted first keys, binary-searches
the file's directory, then the lines of the blocks, and gets the places of the records; records are read in order of
their places, adjoining ones at once. Many URLs are looked up in sorted partitions, so neighbours share directories and blocks.
Files go to the shared folder; a repeated task writes files of its own, and only the rows of the
attempt that succeeded name theirs.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh, map_arrow, read_range, remove, written

#: Digests that occur more than once are broadcast up to this number (about 100 bytes each), else joined by shuffle.
BROADCAST_DIGESTS = 200_000
ROLL_BYTES = 1 << 30
BLOCK_LINES = 1000
#: Records are read together if no more than GAP_BYTES lie between them, up to READ_BYTES at once; tasks share out SHARE_BYTES.
GAP_BYTES, READ_BYTES, SHARE_BYTES = 1 << 14, 8 << 20, 64 << 20
#: Directories and blocks that a look-up holds at once.
HELD_FILES, HELD_BLOCKS = 4, 4
LEVEL = 1
#: Characters of a URL that a header line carries as they are.
URL_SAFE = "".join(map(chr, range(0x21, 0x7F)))
DATE = "1970-01-01T00:00:00Z"
EOL = b"\r\n"

ENTRY = T.StructType(
    [
        T.StructField("surt", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
FILES = T.StructType(
    [
        T.StructField("first_surt", T.StringType()),
        T.StructField("last_surt", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("n_lines", T.LongType()),
    ]
)
PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])


@dataclass(frozen=True)
class Archive:
    """Where an archive lies: the folder of its files, and the table of its index files, with the place of each directory."""

    folder: str
    files: DataFrame

    def delete(self) -> None:
        """Remove the archive's files. Nothing else does: an archive outlives the query that wrote it."""
        remove(self.files.sparkSession, self.folder)


def surt(url: str | None) -> str:
    """The key of a URL: host labels reversed, joined by commas, then ) and the rest; '' for a null."""
    if not url:
        return ""
    _, found, rest = url.partition("://")
    rest = rest if found else url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: str | None) -> str:
    if page is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, page)}>"


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that only names the response's page."""
    http = b"HTTP/1.1 200 OK" + EOL + b"Content-Type: text/html; charset=utf-8" + EOL + b"Content-Length: %d" % len(payload) + EOL + EOL
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=URL_SAFE) if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if page is None else [f"X-Page: {quote(page)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[-2:-2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {quote(refers_to)}"]
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode("ascii") + EOL + EOL + block + EOL + EOL) + press.flush()


def parse(member: bytes) -> dict:
    """The fields of a record; a response's payload is held against its digest and length."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(EOL + EOL)
    fields = dict(line.split(": ", 1) for line in head.decode("ascii").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(EOL + EOL)
    size = int(next(line for line in http.split(EOL) if line.startswith(b"Content-Length: "))[16:])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"record of page {fields.get('X-Page')} doesn't hold its payload")
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    url = fields["WARC-Target-URI"]
    return {"page": None if page is None else unquote(page), "url": None if url == "urn:none" else url, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": named, "record_type": kind, "refers_to": None if refers is None else unquote(refers)}


class _Roll:
    """Appends to files of about ROLL_BYTES; each append returns the file and the place. Without `rolls` files end when closed."""

    def __init__(self, folder: str, kind: str, suffix: str, rolls: bool = True):
        self.rolls = rolls
        self.name = lambda: f"{folder}/{kind}-{uuid.uuid4().hex}{suffix}"
        self.out, self.path, self.at = None, "", 0

    def append(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.rolls and self.at > ROLL_BYTES:
            self.close()
            self.path, self.at = self.name(), 0
            self.out = _opened(self.path)
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return self.path, start, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _opened(uri: str):
    import os

    from .storage import _local, _store

    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> Archive:
    """Write one record a page, then the index. Ids are the captures' names.

    Of pages with equal payloads of at least `least_bytes` bytes the smallest id is the response; rows
    that repeat its id are responses too. A null id is kept as such; it comes after all others, so its page revisits
    another if there is one. Null payloads are empty ones, a null URL gets the key ''. Other columns are
    not read. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    folder = folder or fresh(spark, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("payload", "UTF-8"))))
    shared = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    shared = written(shared, "warc-digests")
    small = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    refers = F.when(~F.col("first").eqNullSafe(F.col("id")) & (F.octet_length("payload") >= least_bytes), F.col("first"))
    rows = rows.join(F.broadcast(shared) if small else shared, "digest", "left").select(F.col("id").cast("string").alias("page"), "url", "payload", refers.cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Roll(folder, "part", ".warc.gz")
        try:
            for b in batches:
                out: list[list] = [[], [], [], [], []]
                for page, url, payload, to in zip(*(b.column(i) for i in range(4)), strict=True):
                    page, url = page.as_py(), url.as_py()
                    place = files.append(record(page, url, payload.as_py().encode("utf-8"), to.as_py()))
                    for column, value in zip(out, (surt(url), page, *place), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ENTRY.names)
        finally:
            files.close()

    entries = written(map_arrow(rows, write, ENTRY), "warc-entries")
    return Archive(folder, written(index(entries, folder), "warc-files"))


def _line(surt_: str, page: str | None, *place) -> str:
    return "\t".join((quote(surt_), "\\" if page is None else quote(page), *map(str, place)))


def _lines(data: bytes) -> list[tuple]:
    """(key, page, file, start, length) of a block, or of a directory, whose pages are the blocks' first ones."""
    out = []
    for line in zlib.decompress(data).decode("utf-8").split("\n"):
        s, p, f, o, n = line.split("\t")
        out.append((unquote(s), None if p == "\\" else unquote(p), f, int(o), int(n)))
    return out


def index(entries: DataFrame, folder: str) -> DataFrame:
    """Sort the entries by key over all partitions, write them as compressed blocks with a directory at the end of each
    file, return the table of the files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Roll(folder, "index", ".blocks", rolls=False)
        lines, directory, n = [], [], 0

        def block() -> None:
            place = files.append(zlib.compress("\n".join(_line(*x) for x in lines).encode("utf-8"), 6))
            directory.append((*lines[0][:2], *place))

        def ended(last: str) -> pa.RecordBatch:
            nonlocal n
            path, start, length = files.append(zlib.compress("\n".join(_line(*x) for x in directory).encode("utf-8"), 6))
            files.close()
            row = [directory[0][0], last, path, start, length, n]
            directory.clear()
            n = 0
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.string()) for x in row], FILES.names)

        last = ""
        try:
            for b in batches:
                for line in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    lines.append(line)
                    n += 1
                    if len(lines) == BLOCK_LINES:
                        block()
                        last = lines[-1][0]
                        lines.clear()
                        if files.at > ROLL_BYTES:
                            yield ended(last)
            if lines:
                block()
                last = lines[-1][0]
            if directory:
                yield ended(last)
        finally:
            files.close()

    order = ["surt", "page", "file", "start"]
    return map_arrow(entries.repartitionByRange(_partitions(entries), *order).sortWithinPartitions(*order), write, FILES)


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Lookup:
    """Finds captures of URLs. It holds the first and last key of every index file, and the last directories and blocks
    that it read; index files are about as many as partitions, or one for ROLL_BYTES of compressed lines."""

    def __init__(self, files: list[tuple]):
        """files: first key, last key, path, start and length of the directory."""
        self.files = sorted(files)
        self.lasts = list(accumulate((f[1] for f in self.files), max))
        self.held: dict[tuple, list[tuple]] = {}

    @classmethod
    def of(cls, archive: Archive) -> Lookup:
        return cls([tuple(r) for r in archive.files.select(*FILES.names[:5]).collect()])

    def _read(self, file: str, start: int, length: int) -> list[tuple]:
        place = (file, start, length)
        if place not in self.held:
            while len(self.held) >= HELD_FILES + HELD_BLOCKS:
                del self.held[next(iter(self.held))]
            self.held[place] = _lines(read_range(*place))
        return self.held[place]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """The places of the blocks that may hold a key; a key with many captures lies in many, also in several files."""
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.files) and self.files[i][0] <= key:
            found = self._read(*self.files[i][2:])
            at = max(0, bisect.bisect_left(found, key, key=lambda x: x[0]) - 1)
            while at < len(found) and found[at][0] <= key:
                yield found[at][2:]
                at += 1
            i += 1

    def lines(self, key: str, block: tuple[str, int, int]) -> Iterator[tuple]:
        """The lines of a block with a key: key, page, file, start, length."""
        found = self._read(*block)
        at = bisect.bisect_left(found, key, key=lambda x: x[0])
        while at < len(found) and found[at][0] == key:
            yield found[at]
            at += 1

    def captures(self, url: str | None) -> list[dict]:
        key = surt(url)
        return [parse(read_range(*line[2:])) for block in self.blocks(key) for line in self.lines(key, block)]


def places(archive: Archive, keys: DataFrame) -> DataFrame:
    """file, start, length of every record whose key is among `keys` (one column, surt; equal ones count once).

    Sorted keys are searched in the directories; the blocks found are read once each and their lines are searched, so a
    key with very many captures is many blocks, shared out, and a block with many keys is one row.
    """
    files = [tuple(r) for r in archive.files.select(*FILES.names[:5]).collect()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(files)
        for b in batches:
            rows: list[tuple] = []
            for key in b.column(0).to_pylist():
                for block in look.blocks(key):
                    rows.append((key, *block))
                    if len(rows) == 10_000:
                        yield _batch(rows, found)
                        rows = []
            if rows:
                yield _batch(rows, found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(files)
        for b in batches:
            for keys_, block in zip(b.column(3).to_pylist(), zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), strict=True):
                rows = [line[2:] for key in keys_ for line in look.lines(key, block)]
                if rows:
                    yield _batch(rows, PLACE)

    found = T.StructType([T.StructField("surt", T.StringType()), *PLACE.fields])
    sorted_keys = keys.select("surt").distinct().repartitionByRange(_partitions(keys), "surt").sortWithinPartitions("surt")
    # At most BLOCK_LINES + 1 keys meet in a block.
    blocks = map_arrow(sorted_keys, find, found).groupBy(*PLACE.names).agg(F.collect_set("surt").alias("keys"))
    return map_arrow(blocks, search, PLACE)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if f.dataType == T.LongType() else pa.string()) for x, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], schema.names)


def all_places(archive: Archive) -> DataFrame:
    """file, start, length of every record, from all blocks of all index files."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for block in _lines(read_range(*file)):
                    yield _batch([line[2:] for line in _lines(read_range(*block[2:]))], PLACE)

    return map_arrow(archive.files.select(*PLACE.names).repartition(_partitions(archive.files)), list_, PLACE)


READ = T.StructType([T.StructField(n, t) for n, t in (("page", T.StringType()), ("url", T.StringType()), ("payload", T.BinaryType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.StringType()))])


def _ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted places joined to ranges: file, start, length, and the members' starts in the range with their lengths."""
    path, begin, end, members = None, 0, 0, []
    for file, start, length in rows:
        if members and (file != path or start > end + GAP_BYTES or start + length > begin + READ_BYTES):
            yield path, begin, end - begin, members
            members = []
        if not members:
            path, begin, end = file, start, start
        members.append((start - begin, length))
        end = max(end, start + length)
    if members:
        yield path, begin, end - begin, members


def records(where: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the places given by file, start, length; each stretch of a file is read in order by one task."""
    kept = [f for f in READ.fields if with_payload or f.name != "payload"]
    types = {"page": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        for file, start, length, members in _ranges(rows):
            data = read_range(file, start, length)
            for i in range(0, len(members), 200):
                found = [parse(data[o : o + n]) for o, n in members[i : i + 200]]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in found], types[f.name]) for f in kept], [f.name for f in kept])

    share = F.floor(F.col("start") / SHARE_BYTES)
    dealt = where.repartition(_partitions(where), "file", share).sortWithinPartitions("file", "start")
    return map_arrow(dealt, read, T.StructType(kept))


def read_archive(archive: Archive, with_payload: bool = True) -> DataFrame:
    """Every record of an archive."""
    return records(all_places(archive), with_payload)


def captures(archive: Archive, urls: DataFrame, url_col: str = "url", with_payload: bool = True) -> DataFrame:
    """Every record whose URL has the key of one of the URLs in a table (nulls have the key ''), found by the index."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(surt, b.column(0).to_pylist())), pa.string())], ["surt"])

    return records(places(archive, map_arrow(urls.select(F.col(url_col).cast("string")), key, "surt string")), with_payload)


def capture_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write an archive of the pages, look every page's URL up in its index, read the captures and report each without its payload.

    One row a page: its id, payload_bytes, payload_digest, record_type, refers_to, target_uri (as in the header).
    Ids are of any type that survives a cast to text and back; null ids stay null, and '' stays ''.
    """
    kind = pages.schema[id_col].dataType
    rows = captures(write_archive(pages, None, id_col, url_col, payload_col, least_bytes), pages, url_col, with_payload=False)
    return rows.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.col("url").alias("target_uri"))


def archive_at(spark: SparkSession, folder: str, files_path: str) -> Archive:
    return Archive(folder, spark.read.schema(FILES).parquet(files_path))


#: The registered query's rows. The digest's 160 bits are spelled five at a time.
ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS raw, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
b AS (SELECT hex, first, list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), lambda x, y: x || y) AS bits FROM f),
d AS (SELECT hex, first, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_reduce(list_transform(range(1, 6), lambda k: CAST(substr(bits, 5 * i + k, 1) AS INTEGER)), lambda x, y: 2 * x + y) AS BIGINT) + 1, 1)), lambda x, y: x || y) AS digest FROM b)
SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, url AS target_uri FROM p JOIN d USING (hex)
"""
