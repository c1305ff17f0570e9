"""Column functions over strings of bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their complements.
LETTERS, PARTNERS = "ACGTacgt", "TGCAtgca"
#: Bases in order of their two bits in packed k-mers.
PACKED = "ACGT"


def complement(bases: Column) -> Column:
    return F.translate(bases, LETTERS, PARTNERS)


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def is_valid(bases: Column) -> Column:
    """Whether a string holds A, C, G, T and N only, in either case."""
    return bases.rlike("^[ACGTNacgtn]*$")


def first_offender(bases: Column) -> Column:
    """First character that is no base, empty if there is none."""
    return F.regexp_extract(bases, "([^ACGTNacgtn])", 1)


def upper_bases(bases: Column) -> Column:
    """Bases in upper case; other characters stay, as the upper case of some ("ß") is longer or holds other letters."""
    return F.translate(bases, "acgtn", "ACGTN")


def upper_sign(sign: Column) -> Column:
    """One character's simple upper case, which is one character again."""
    upper, title = F.upper(sign), F.initcap(sign)
    return F.when(F.length(upper) <= 1, upper).when(F.length(title) == 1, title).when(sign == "ß", F.lit("ẞ")).otherwise(sign)


def contains_n(bases: Column) -> Column:
    """Upper-case N only."""
    return F.contains(bases, F.lit("N"))


def cut(bases: Column, start: Column, size: Column | int) -> Column:
    """``size`` bases from the 0-based ``start``; bases are single bytes, so no characters are counted."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.substr(bases.cast("binary"), (start + 1).cast("int"), size.cast("int")).cast("string")


def kmer_text(kmer: Column, k: int) -> Column:
    """The bases of a packed k-mer."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", PACKED)
