"""K-mer expressions: cutting sequences into windows and their canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases a piece of a long sequence begins with; pieces overlap by k - 1.
PIECE = 1024

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGT" * 13


def pseudo_dna(text: Column) -> Column:
    """Text as bases: the 52 ASCII letters become A, C, G, T in turn, everything else breaks a run."""
    return F.translate(text, LETTERS, BASES)


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def runs(sequence: Column, k: int) -> Column:
    """Maximal runs of A, C, G, T that are at least k long; windows over other symbols do not exist."""
    return F.regexp_extract_all(sequence, F.lit(f"([ACGT]{{{k},}})"), F.lit(1))


def pieces(run: Column, k: int, canonical: bool = False) -> Column:
    """A run cut into overlapping binary pieces that together have the run's k-mers, each once.

    Structs of ``piece`` and, if asked, its reverse complement ``other``, made once a piece.
    """
    raw = run.cast("binary")
    starts = F.sequence(F.lit(1), F.octet_length(run) - (k - 1), F.lit(PIECE))
    cut = F.transform(starts, lambda i: F.substring(raw, i, F.lit(PIECE + k - 1)))
    return F.transform(cut, lambda p: F.struct(p.alias("piece"), *([other_strand(p).alias("other")] if canonical else [])))


def starts(piece: Column, k: int) -> Column:
    """Places at which a window of length k of a binary piece begins, from one."""
    return F.sequence(F.lit(1), F.octet_length(piece) - (k - 1))


def window(piece: Column, at: Column, k: int) -> Column:
    """The window of a binary piece that begins at ``at``; binary substrings cost no scan of what is before them."""
    return F.substring(piece, at, F.lit(k))


def other_strand(piece: Column) -> Column:
    """The reverse complement of a binary piece."""
    return F.reverse(F.translate(piece.cast("string"), "ACGT", "TGCA")).cast("binary")


def canonical_window(piece: Column, other: Column, at: Column, k: int) -> Column:
    """The smaller of a window and its reverse complement, which is a window of the other strand."""
    return F.least(window(piece, at, k), window(other, F.octet_length(piece) - at - (k - 2), k))
