"""Column expressions over nucleotide sequences, handles, CIGAR strings and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def reverse_complement(seq: Column) -> Column:
    """ACGT and acgt are complemented, every other letter stays, and the order turns."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def oriented(seq: Column, fwd: Column) -> Column:
    return F.when(fwd, seq).otherwise(reverse_complement(seq))


def oriented_slice(seq: Column, fwd: Column, start: Column, end: Column) -> Column:
    """Half-open sub-range in the direction of the strand."""
    return F.substr(oriented(seq, fwd), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def strand_pieces(seq: Column, size: int) -> Column:
    """A strand cut into pieces of `size` letters; none for an empty strand."""
    if size < 1:
        raise ValueError("pieces need at least one letter")
    starts = F.sequence(F.lit(0), F.length(seq) - 1, F.lit(size))
    return F.when(F.length(seq) > 0, F.transform(starts, lambda i: F.substr(seq, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sign(fwd: Column) -> Column:
    return F.when(fwd, "+").otherwise("-")


def parse_sign(text: Column) -> Column:
    """True for +, false for -, an error for anything else."""
    bad = F.raise_error(F.concat(F.lit("not an orientation: "), F.coalesce(text, F.lit("null"))))
    return F.when(text == "+", F.lit(True)).when(text == "-", F.lit(False)).otherwise(bad.cast("boolean"))


def handle_text(name: Column, fwd: Column) -> Column:
    return F.concat(name.cast("string"), sign(fwd))


def parse_cigar(text: Column, strict: bool = False) -> Column:
    """3M2I as an array of (len, op); * and the empty text have no operations. What doesn't fit is left out, or with
    strict an error."""
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an overlap: "), text)).cast("string")
        text = F.when(F.regexp_like(text, F.lit(r"^(?:(?:[0-9]+[MNDI])*|\*)$")), text).otherwise(bad)
    found = F.regexp_extract_all(text, F.lit("[0-9]+[MNDI]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_text(cigar: Column) -> Column:
    """The text of an overlap; one without operations is 0M."""
    parts = F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"]))
    return F.when(F.coalesce(F.size(cigar), F.lit(0)) > 0, F.array_join(parts, "")).otherwise(F.lit("0M"))


def overlap_start(a_start: Column, b_start: Column) -> Column:
    return F.greatest(a_start, b_start)


def overlap_end(a_end: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end)


def overlap_width(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def format_number(value: float, digits: int = 2) -> str:
    """Fixed digits, half to even on the exact binary value, without trailing zeros; NaN as NaN."""
    if value != value:
        return "NaN"
    text = format(value, f".{digits}f")
    return text.rstrip("0").rstrip(".") if "." in text else text


#: Codes of the export codec for nucleotides.
NUCLEOTIDE_CODES = {"A": 1, "T": 2, "G": 3, "C": 4, "N": 5}


def nucleotides_to_ints(seq: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in NUCLEOTIDE_CODES.items() for x in pair))
    return F.when(F.length(seq) > 0, F.transform(F.split(seq, ""), lambda c: F.element_at(table, c))).otherwise(F.array().cast("array<int>"))


def ints_to_nucleotides(codes: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in NUCLEOTIDE_CODES.items() for x in (v, k)))
    return F.array_join(F.transform(codes, lambda c: F.element_at(table, c)), "")


def path_to_ints(handles: Column) -> Column:
    """Handles (name, fwd) as name, 0, name, 1 ...: 0 is forward, 1 backward."""
    return F.flatten(F.transform(handles, lambda h: F.array(h["name"].cast("long"), (~h["fwd"]).cast("long"))))


def ints_to_path(values: Column) -> Column:
    """The inverse of path_to_ints, as text: 1+,2-."""
    places = F.sequence(F.lit(0), F.size(values) - 2, F.lit(2))
    text = F.array_join(F.transform(places, lambda i: F.concat(F.get(values, i).cast("string"), F.when(F.get(values, i + 1) == 0, "+").otherwise("-"))), ",")
    return F.when(F.size(values) > 1, text).otherwise("")


def link_to_list(from_name: Column, from_fwd: Column, to_name: Column, to_fwd: Column, overlap: Column) -> Column:
    """A link as five texts: from, 0 (forward) or 1, to, 0 or 1, overlap."""
    return F.array(*(x.cast("string") for x in (from_name, (~from_fwd).cast("int"), to_name, (~to_fwd).cast("int"))), cigar_text(overlap))
