"""Substrings of fixed length and the distances of their sets, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def windows(seq: Column, k: int, letters: str = ".") -> Column:
    """All substrings of k such letters, in order: one pass of a look-ahead, where substring() at each place would scan the
    text from its start each time. No window starts inside a surrogate pair."""
    return F.regexp_extract_all(seq, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=({letters}{{{k}}}))"), F.lit(1))


def kmer_set(seq: Column, k: int = 8) -> Column:
    """Distinct k-mers of the upper-cased text, gaps and N deleted first; other letters stay."""
    return F.array_distinct(windows(F.translate(F.upper(seq), "-N", ""), k))


def strict_kmer_set(seq: Column, k: int = 8) -> Column:
    """Distinct k-mers of A, C, G and T alone; windows with any other letter are skipped."""
    return F.array_distinct(windows(F.upper(seq), k, "[ACGT]"))


def packed(kmer: Column) -> Column:
    """A k-mer of ACGT as a number of two bits a letter."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def reverse_complement(seq: Column) -> Column:
    """Of the letters ACGT in upper case; others stay, in reverse order."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1.0 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def jaccard_from_counts(shared: Column, n_a: Column, n_b: Column) -> Column:
    return F.when((n_a == 0) | (n_b == 0), 1.0).otherwise(1.0 - shared / (n_a + n_b - shared))


def jukes_cantor(p: Column) -> Column:
    """The corrected distance of a share of differing places, which is held to 0 .. 0.7499."""
    return -0.75 * F.log(1.0 - 4.0 / 3.0 * F.least(F.greatest(p, F.lit(0.0)), F.lit(0.7499))) + 0.0


def codes(seq: Column) -> Column:
    """1 to 4 for A, C, G and T or U of either case, 0 for all else."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGTU]", "0"), "ACGTU", "12344")
