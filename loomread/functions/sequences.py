"""Column functions on sequences: complements, k-mers, qualities, slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements, case kept.
IUPAC, IUPAC_COMPLEMENT = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def ascii_upper(c: Column) -> Column:
    """Upper case of a-z only, alike in every engine."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, IUPAC, IUPAC_COMPLEMENT))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_flipped(kmer: Column) -> Column:
    """Whether canonical() takes the reverse complement; a palindrome counts as flipped."""
    return kmer >= reverse_complement(kmer)


def characters(c: Column) -> Column:
    """Array of the characters of a string, empty for null and the empty string."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")


def grams(chars: Column, k: int) -> Column:
    """All runs of k elements of an array of strings, joined; empty where there are fewer. O(k) for each run."""
    at = F.when(F.size(chars) >= k, F.sequence(F.lit(0), F.size(chars) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(*[F.get(chars, i + j) for j in range(k)]))


def masked(c: Column, start: int, end: int) -> Column:
    """N outside [start, end)."""
    n = F.length(c)
    left, right = F.least(F.lit(start), n), F.greatest(n - end, F.lit(0))
    return F.concat(F.repeat(F.lit("N"), left), F.substring(c, start + 1, max(end - start, 0)), F.repeat(F.lit("N"), F.least(right, n - left)))


def phred(char: Column) -> Column:
    """Quality of a character: code - 33, held in 0 to 60."""
    return F.least(F.greatest(F.ascii(char) - 33, F.lit(0)), F.lit(60))


def trim_length(quals: Column, k: int, least: int) -> Column:
    """Length of the longest prefix whose last k qualities are all >= least, else 0."""
    ends = F.when(F.size(quals) >= k, F.sequence(F.lit(k), F.size(quals))).otherwise(F.array().cast("array<int>"))
    good = F.filter(ends, lambda e: F.least(*[F.get(quals, e - j) for j in range(1, k + 1)]) >= least)
    return F.coalesce(F.array_max(good), F.lit(0))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
