"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text (a match of the vocabulary's split pattern) starts as one symbol per byte. The heap
holds the ranks of adjacent pairs; the lowest is popped again and again, leftmost first among equals,
and its two symbols become one. The count is the initial symbols minus the merges: no identifier is
ever looked up or emitted. Pieces repeat, so each worker keeps the counts of the pieces it has seen
in a table of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import map_arrow

#: Pieces a worker remembers; a full table is emptied, which changes no result.
REMEMBERED = 400_000
#: Longer pieces are merged each time they come: they rarely repeat.
LONGEST_REMEMBERED = 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Merger:
    """Counts the symbols that are left of a piece once no merge applies."""

    def __init__(self, merges: list[tuple[str, str]], n_bytes_symbols: dict[str, int]):
        #: (left symbol, right symbol) -> (rank, merged symbol); symbols are small integers of our own.
        self.symbols = dict(n_bytes_symbols)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = (self.symbols.setdefault(x, len(self.symbols)) for x in (a, b, a + b))
            self.pairs.setdefault((left, right), (rank, whole))

    def count(self, symbols: list[int]) -> int:
        n = len(symbols)
        if n < 2:
            return n
        pairs, symbol = self.pairs, symbols
        heap = []
        for i in range(n - 1):
            if found := pairs.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = whole, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if found := pairs.get((whole, symbol[k])):
                    heapq.heappush(heap, (found[0], i, whole, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbol[h], whole))):
                heapq.heappush(heap, (found[0], h, symbol[h], whole, found[1]))
        return left


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text under a byte-level BPE vocabulary file, which is read once a worker.

    As the file's own library does by default, special tokens that occur in a text count as one token
    each and split it; nothing is added at its ends, nothing is cut or padded.
    """
    import regex

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file["pre_tokenizer"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or file["normalizer"]:
        raise ValueError(f"{path}: a plain byte-level BPE vocabulary is needed")
    letters = byte_letters()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ids = {letters[b]: b for b in range(256)}
    merger = Merger(merges, ids)
    white = r"\p{White_Space}"
    pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{white}\p{{L}}\p{{N}}]+|{white}+(?!\P{{White_Space}})|{white}+").findall
    specials = [x["content"] for x in file["added_tokens"]]
    special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    seen: dict[str, int] = {}

    def count_plain(text: str) -> int:
        total = 0
        for piece in pieces(text):
            n = seen.get(piece)
            if n is None:
                n = merger.count(list(piece.encode("utf-8")))
                if len(piece) <= LONGEST_REMEMBERED:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = n
            total += n
        return total

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return count_plain(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(count_plain, parts))

    return count


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens, and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Rows with equal ids are counted one by one; other
    columns are not read. An empty table gives no rows. `vocabulary` is a path each worker can open.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            sizes, tokens = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], schema.names)

    return map_arrow(docs.select(id_col, text_col), run, schema)
