"""Sequence expressions: native columns, one for each scalar function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each ambiguity code is resolved to, and the bases each stands for.
CODES, RESOLVED = "BDRYKMSWV", "CGACTACAA"
AMBIGUOUS = {"R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "GC", "W": "AT", "B": "CGT", "D": "AGT", "V": "ACG"}
ALPHABET = "ACGTNRYKMSWBDVH"


def letters_to_bases(text: Column) -> Column:
    """A text's letters as bases, a to z going round ACGT; everything else is dropped."""
    mapped = F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return F.regexp_replace(mapped, "[^ACGT]+", "")


def letters_to_raw(text: Column) -> Column:
    """As letters_to_bases, with N and ambiguity codes among the bases."""
    mapped = F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "NCGTARYKMSWBDVACGTNACGTACG")
    return F.regexp_replace(mapped, "[^A-Z]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def trim_n(seq: Column) -> tuple[Column, Column]:
    """The sequence without Ns at its ends, and the number of leading Ns."""
    return F.regexp_replace(seq, "^N+|N+$", ""), F.length(F.regexp_extract(seq, "^N*", 0)).cast("long")


def resolve(seq: Column) -> Column:
    """Ambiguity codes to one base each; N to the base that its place (from 0) modulo 4 names; any other symbol is an error."""
    seq = F.when(seq.rlike(f"[^ACGTN{CODES}]"), F.raise_error(F.concat(F.lit("no base or code: "), F.regexp_extract(seq, f"[^ACGTN{CODES}]", 0)))).otherwise(seq)
    chars = F.split(F.translate(seq, CODES, RESOLVED), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c == "N", F.substring(F.lit("ACGT"), (i % 4 + 1).cast("int"), F.lit(1))).otherwise(c)), "")


def skip_n(seq: Column) -> Column:
    """The longest prefix whose last eight symbols hold no N but perhaps in last place; empty if there is none."""
    return F.regexp_extract(seq, "^(.*[^N]{7}.)", 1)


def rol(seq: Column) -> Column:
    return F.concat(F.substring(seq, 2, 1 << 30), F.left(seq, F.lit(1)))


def ror(seq: Column) -> Column:
    return F.concat(F.right(seq, F.lit(1)), F.substring(seq, F.lit(1), F.length(seq) - 1))


def bit_rol(byte: Column, n: int) -> Column:
    """An 8-bit value turned left by n bits."""
    return (F.shiftleft(byte, n) + F.shiftright(byte, 8 - n)).bitwiseAND(255)


def sigma(q: Column, r: Column) -> Column:
    """Score of query symbol q against reference symbol r."""
    stands = F.lit(False)
    for code, bases in AMBIGUOUS.items():
        stands = stands | ((r == code) & q.isin(*bases))
    return F.when(q == r, F.when(q == "N", 1.6).otherwise(2.0)).when((q == "N") | (r == "N"), 1.6).when(stands, 2.0).otherwise(-1.0)


def kmers(raw: Column, k: int) -> Column:
    """All substrings of length k of a binary column, in order; none for shorter ones. Binary, because a place in a string is found by counting characters from its start, and in bytes at once."""
    starts = F.sequence(F.lit(1), F.octet_length(raw) - (k - 1))
    return F.when(F.octet_length(raw) >= k, F.transform(starts, lambda i: F.substring(raw, i, F.lit(k)))).otherwise(F.array().cast("array<binary>"))


def overlapping_starts(raw: Column, pattern: str) -> Column:
    """1-based starts of all matches in a binary column, overlapping ones too."""
    k, wanted = len(pattern), F.lit(pattern).cast("binary")
    starts = F.sequence(F.lit(1), F.octet_length(raw) - (k - 1))
    return F.when(F.octet_length(raw) >= k, F.filter(starts, lambda i: F.substring(raw, i, F.lit(k)) == wanted)).otherwise(F.array().cast("array<int>"))
