"""Packed nucleotides: two bases a byte, four bits each, the first base in the low bits."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the packed format: codes of the bases, and the number at the start of a packed file.
BASE_CODES = {"A": 0, "C": 1, "T": 2, "G": 3}
MAGIC = 0x12
_LETTERS = {v: k for k, v in BASE_CODES.items()}


def pack(seq: Column) -> Column:
    """ACTG text as binary; other letters are an error. An odd last base leaves the high bits zero."""
    checked = F.when(F.regexp_like(seq, F.lit("^[ACTG]*$")), seq).otherwise(F.raise_error(F.lit("packed sequences hold only A, C, T and G")).cast("string"))
    digits = F.translate(checked, "ACTG", "0123")
    even = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    # Each pair of digits swaps places, as the first base is the low half of the byte.
    return F.unhex(F.regexp_replace(even, "(.)(.)", "$2$1"))


def unpack(packed: Column, length: Column) -> Column:
    """The first `length` bases of a packed sequence."""
    swapped = F.regexp_replace(F.hex(packed), "(.)(.)", "$2$1")
    return F.translate(F.substr(swapped, F.lit(1), length.cast("int")), "0123", "ACTG")


def base_at(packed: Column, index: Column) -> Column:
    """One base of a packed sequence; null past its bytes."""
    pair = F.substr(F.hex(packed), (F.floor(index / 2) * 2 + 1).cast("int"), F.lit(2))
    half = F.when(index % 2 == 0, F.substr(pair, F.lit(2), F.lit(1))).otherwise(F.substr(pair, F.lit(1), F.lit(1)))
    return F.when(half != "", F.translate(half, "0123", "ACTG"))


def packed_slice(packed: Column, start: Column, end: Column) -> Column:
    """Text of a half-open range of bases."""
    return F.substr(unpack(packed, end), (start + 1).cast("int"))


class PackedSeq:
    """A packed sequence on the driver: index, slice, append, iterate, len, text."""

    def __init__(self, text: str = ""):
        self.data, self.size = bytearray(), 0
        for c in text:
            self.push(c)

    def push(self, base: str) -> None:
        code = BASE_CODES[base]
        if self.size % 2:
            self.data[-1] |= code << 4
        else:
            self.data.append(code)
        self.size += 1

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i):
        if isinstance(i, slice):
            return PackedSeq("".join(self[j] for j in range(*i.indices(self.size))))
        i += self.size * (i < 0)
        if not 0 <= i < self.size:
            raise IndexError(i)
        return _LETTERS[self.data[i // 2] >> 4 * (i % 2) & 15]

    def __setitem__(self, i: int, base: str) -> None:
        if not 0 <= i < self.size:
            raise IndexError(i)
        shift = 4 * (i % 2)
        self.data[i // 2] = self.data[i // 2] & ~(15 << shift) & 255 | BASE_CODES[base] << shift

    def __iter__(self):
        return (self[i] for i in range(self.size))

    def __str__(self) -> str:
        return "".join(self)

    def __eq__(self, other) -> bool:
        return isinstance(other, PackedSeq) and (self.size, self.data) == (other.size, other.data)

    __hash__ = None

    def to_bytes(self) -> bytes:
        """The packed file: magic number, data bytes, capacity, whether the last byte is whole, then the data."""
        return struct.pack("<QQQB", MAGIC, len(self.data), len(self.data), self.size % 2 == 0) + bytes(self.data)

    @staticmethod
    def from_bytes(raw: bytes) -> PackedSeq:
        magic, size, _, whole = struct.unpack_from("<QQQB", raw)
        if magic != MAGIC:
            raise ValueError("not a packed sequence")
        out = PackedSeq()
        out.data = bytearray(raw[25 : 25 + size])
        out.size = 2 * size - (not whole and size > 0)
        return out
