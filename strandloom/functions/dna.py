"""The two alphabets as columns: validation, packing, lengths, order. All built from Spark's own functions.

A DNA value is a canonical string: upper case, U written as T. kind "dna2" is
ACGT with two bits a base, "dna4" the IUPAC codes with four. Packed forms put the
first base into the high bits and fill the last byte with zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes in the order of their four bits, from 1 to 15.
DNA4_CODES = "ACMGRSVTWYHKDBN"
#: The bases that a degenerate code stands for (N is never expanded).
DEGENERATE = {
    "M": "AC",
    "R": "AG",
    "W": "AT",
    "S": "CG",
    "Y": "CT",
    "K": "GT",
    "V": "ACG",
    "H": "ACT",
    "D": "AGT",
    "B": "CGT",
}
_ALPHABET = {"dna2": "ACGT", "dna4": DNA4_CODES}
_BITS = {"dna2": 2, "dna4": 4}
#: Bases that are packed at a time (two digits of base 4 are one of base 16).
_RUN = 24


def _name(kind: str) -> str:
    return kind.upper()


def is_valid(text: Column, kind: str) -> Column:
    return F.upper(text).rlike(f"^[{_ALPHABET[kind]}U]*$")


def canonical(text: Column, kind: str) -> Column:
    """The canonical form; an invalid character is an error that names it. Null stays null."""
    up = F.upper(text)
    bad = F.substring(F.regexp_replace(text, f"(?i)[{_ALPHABET[kind]}U]", ""), 1, 1)
    error = F.raise_error(F.concat(F.lit("invalid character '"), bad, F.lit(f"' for {_name(kind)} type"))).cast("string")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(is_valid(text, kind), F.translate(up, "U", "T")).otherwise(error)


def nuc_length(seq: Column) -> Column:
    return F.length(seq)


char_length = length = nuc_length


def bit_length(seq: Column, kind: str) -> Column:
    return F.length(seq) * _BITS[kind]


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value evaluated once, however often it stands in what is made of it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def data_bytes(seq: Column, kind: str) -> Column:
    """The packed bases."""
    return _once(seq, lambda s: _data_bytes(s, kind))


def _data_bytes(seq: Column, kind: str) -> Column:
    if kind == "dna4":
        digits = F.translate(seq, DNA4_CODES, "123456789ABCDEF")
        return F.unhex(F.concat(digits, F.repeat(F.lit("0"), F.length(seq) % 2)))
    padded = F.concat(F.translate(seq, "ACGT", "0123"), F.repeat(F.lit("0"), F.pmod(-F.length(seq), F.lit(_RUN))))
    runs = F.regexp_extract_all(padded, F.lit(f"[0-3]{{{_RUN}}}"), F.lit(0))
    hexes = F.transform(runs, lambda p: F.lpad(F.conv(p, 4, 16), _RUN // 2, "0"))
    digits = F.floor((F.length(seq) + 3) / 4).cast("int") * 2
    return F.unhex(F.substring(F.array_join(hexes, ""), F.lit(1), digits))


def to_bytes(seq: Column, kind: str) -> Column:
    """Four bytes of bit length, big-endian, then the packed bases: also the wire form that is sent."""
    return _once(seq, lambda s: F.concat(F.unhex(F.lpad(F.hex(bit_length(s, kind).cast("long")), 8, "0")), _data_bytes(s, kind)))


wire_send = to_bytes


def from_bytes(data: Column, kind: str) -> Column:
    """The sequence of a wire form."""
    return _once(data, lambda d: _from_bytes(d, kind))


def _from_bytes(data: Column, kind: str) -> Column:
    bits = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("int")
    digits = F.hex(F.substring(data, 5, 2**31 - 1))
    if kind == "dna4":
        bases = F.translate(digits, "0123456789ABCDEF", "?" + DNA4_CODES)
    else:
        padded = F.concat(digits, F.repeat(F.lit("0"), F.lit(_RUN // 2 - 1)))  # what is left over falls to no run
        runs = F.regexp_extract_all(padded, F.lit(f"[0-9A-F]{{{_RUN // 2}}}"), F.lit(0))
        bases = F.translate(F.array_join(F.transform(runs, lambda h: F.lpad(F.conv(h, 16, 4), _RUN, "0")), ""), "0123", "ACGT")
    return F.substring(bases, F.lit(1), F.floor(bits / _BITS[kind]).cast("int"))


wire_receive = from_bytes


def sort_key(seq: Column, kind: str) -> Column:
    """Order: the shorter first, then the bases by their codes."""
    codes = seq if kind == "dna2" else F.translate(seq, DNA4_CODES, "123456789ABCDEF")
    return F.struct(F.length(seq).alias("n"), codes.alias("codes"))


def compare(a: Column, b: Column, kind: str) -> Column:
    """-1, 0 or 1."""
    x, y = sort_key(a, kind), sort_key(b, kind)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(x < y, -1).when(x > y, 1).otherwise(0)


def equal(a: Column, b: Column) -> Column:
    return a == b


def not_equal(a: Column, b: Column) -> Column:
    return a != b


def hashed(seq: Column) -> Column:
    return F.hash(seq)


def hashed_extended(seq: Column, seed: Column | int = 0) -> Column:
    return F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, seq)
