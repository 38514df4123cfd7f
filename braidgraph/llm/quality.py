"""Quality rules by compression bands.

zstandard ratios (bytes before / bytes after) of the whole text and of its fixed chunks, the last and shorter one
included, are held against limits that depend on length: too high a ratio means repetition, too low a ratio means noise.
The plain rules that come first (too few words, too many words in repeated windows) are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import map_arrow
from .textcols import IS_SPACE, blocks, code_points, count_true, hashes, per_row, windows, words

SYMBOLS = b"#*$%&|<>"

REPORT = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("ratio", T.DoubleType()),
    ("worst_chunk_high", T.DoubleType()),
    ("worst_chunk_low", T.DoubleType()),
]


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes: (up to, lowest ratio, highest ratio), for whole texts and for chunks.

    A text longer than one chunk is cut into chunks of `chunk_bytes`, the last one being what remains. A chunk is outside
    if its ratio is outside the limits for its own length; a text fails if more than `bad_share` of its bytes lie in such
    chunks. Beyond the last length, that one's limits hold.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (256, 0.80, 3.0),
        (1024, 1.10, 3.5),
        (4096, 1.35, 4.5),
        (16384, 1.45, 6.0),
        (float("inf"), 1.50, 8.0),
    )
    chunk_bytes: int = 4096
    chunks: tuple[tuple[float, float, float], ...] = (
        (64, 0.35, 4.0),
        (256, 0.75, 4.0),
        (1024, 1.00, 4.5),
        (2048, 1.15, 5.0),
        (4096, 1.35, 6.0),
    )
    bad_share: float = 0.15
    level: int = 3
    least_words: int = 20
    window: int = 8
    most_repeat_percent: int = 30


def _line_duplicates(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], cut + 1)))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    ends = np.concatenate((starts[1:], [len(data)]))
    ends = ends - (data[ends - 1] == 10)
    rows = np.searchsorted(offsets, starts, "right") - 1
    full = np.add.reduceat(~IS_SPACE[data], starts, dtype=np.int64) > 0
    starts, ends, rows = starts[full], ends[full], rows[full]
    key = hashes(data, starts, ends)
    order = np.lexsort((key, rows))
    key, rows = key[order], rows[order]
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (rows[1:] == rows[:-1])
    return per_row(rows[again], n)


def _repeat_words(hashed: np.ndarray, rows: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside windows of `size` words that occur twice or more in their text, per text."""
    key, at = windows(hashed, rows, size)
    if not len(key):
        return np.zeros(n, np.int64)
    order = np.lexsort((key, rows[at]))
    k, r = key[order], rows[at][order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    found = np.zeros(len(k), bool)
    found[1:] |= same
    found[:-1] |= same
    begin = at[order[found]]
    edge = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size, -1)
    return per_row(rows[np.cumsum(edge[:-1]) > 0], n)


def _inside(ratio: float, size: int, limits: tuple[tuple[float, float, float], ...]) -> bool:
    low, high = next(((lo, hi) for top, lo, hi in limits if size <= top), limits[-1][1:])
    return low <= ratio <= high


def _ratios(text: bytes, press, bands: Bands) -> tuple[float, float, float, bool]:
    """Whole ratio, lowest and highest ratio of the chunks, and whether all is inside the bands."""
    if not text:
        return 1.0, 1.0, 1.0, True
    size = len(text)
    ratio = size / len(press(text))
    fine = _inside(ratio, size, bands.whole)
    step = bands.chunk_bytes
    if size <= step:
        return ratio, ratio, ratio, fine
    parts = [text[i : i + step] for i in range(0, size, step)]
    each = [len(x) / len(press(x)) for x in parts]
    bad = sum(len(x) for x, r in zip(parts, each, strict=True) if not _inside(r, len(x), bands.chunks))
    return ratio, min(each), max(each), fine and bad <= bands.bad_share * size


def report_block(data: np.ndarray, offsets: np.ndarray, bands: Bands, press) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    hashed = hashes(data, starts, ends)
    n_words = per_row(rows, n)
    chars = count_true(code_points(data) & ~IS_SPACE[data], offsets)
    odd = np.zeros(256, bool)
    odd[list(SYMBOLS)] = True
    symbols = count_true(odd[data], offsets)
    lines = _line_duplicates(data, offsets, n)
    repeats = _repeat_words(hashed, rows, n, bands.window)
    failed = (n_words < bands.least_words) | (100 * repeats > bands.most_repeat_percent * n_words)
    whole = data.tobytes()
    found = [_ratios(whole[offsets[i] : offsets[i + 1]], press, bands) for i in range(n)]
    ratio, low, high, fine = (np.array(x) for x in zip(*found, strict=True))
    return [n_words, chars, symbols, lines, repeats, failed, ~failed & fine.astype(bool), ratio, high, low]


def _reports(texts: pa.Array, bands: Bands, press) -> list[pa.Array]:
    parts = [report_block(data, offsets, bands, press) for _, data, offsets in blocks(texts)]
    return [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: its id under its own name, then the columns of REPORT.

    A null text is an empty one: no words, base_failed. Rows with equal ids are judged one by one.
    Other columns are not read, so clashing names can't matter. An empty table gives no rows.
    """
    fields = [(id_col, docs.schema[id_col].dataType), *REPORT]
    schema = T.StructType([T.StructField(a, b) for a, b in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=bands.level).compress
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *_reports(b.column(1), bands, press)], [a for a, _ in fields])

    return map_arrow(docs.select(id_col, text_col), run, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=bands.level).compress
        kept = [a for a, _ in REPORT].index("kept")
        for b in batches:
            if b.num_rows:
                yield b.filter(_reports(b.column(b.schema.get_field_index(text_col)), bands, press)[kept])

    return map_arrow(docs, run, docs.schema)


#: The exact columns, by SQL.
BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, * FROM d),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM i) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
x AS (SELECT k, j, list_aggregate(w[j : j + 7], 'string_agg', ' ') AS run FROM i, unnest(range(1, len(w) - 6)) AS u(j) WHERE len(w) >= 8),
r AS (SELECT k, j FROM (SELECT k, j, count(*) OVER (PARTITION BY k, run) AS n FROM x) WHERE n >= 2),
c AS (SELECT k, count(DISTINCT j + o) AS n FROM r, unnest(range(8)) AS u(o) GROUP BY k),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM i LEFT JOIN l USING (k) LEFT JOIN c USING (k))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
"""
