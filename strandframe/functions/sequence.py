"""Scalar functions over sequences, all as Column expressions."""
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: fixed values: the standard genetic code, codons in the order T, C, A, G
BASES, CODE = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def clean(col, letters: str = AMINO) -> Column:
    """Upper case after dropping all that is no ASCII letter, then only `letters`."""
    return F.regexp_replace(F.upper(F.regexp_replace(col, "[^A-Za-z]", "")), f"[^{letters}]", "")


def clean_text(text: str, letters: str = AMINO) -> str:
    """clean of one text, for numpy kernels."""
    return text.encode("ascii", "ignore").upper().translate(None, _others(letters)).decode()


@functools.cache
def _others(letters: str) -> bytes:
    return bytes(c for c in range(128) if chr(c) not in letters)


def strip_gaps(col) -> Column:
    return F.regexp_replace(col, "[-.\\s]", "")


def reverse_complement(col) -> Column:
    """IUPAC codes; other characters stay as they are."""
    return F.reverse(F.translate(col, "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"))


def translate_frame(col, frame: int) -> Column:
    """Amino letters of frame 1..3, or -1..-3 on the reverse complement; codons with other letters give X, stops *."""
    seq = F.col(col) if isinstance(col, str) else col
    seq = F.upper(seq if frame > 0 else reverse_complement(seq))
    # a codon as a number of base 5, other letters being 4, is a place in the table
    of = "".join(CODE[a * 16 + b * 4 + c] if max(a, b, c) < 4 else "X" for a in range(5) for b in range(5) for c in range(5))
    digits = F.regexp_replace(F.translate(F.regexp_replace(seq, "[0-9]", "N"), BASES, "0123"), "(?s)[^0-3]", "4")
    # codons by one pass of a pattern: substring by position would walk the string again for each codon
    own = F.regexp_extract_all(F.substring(digits, abs(frame), F.length(digits)), F.lit("..."), F.lit(0))
    table = F.split(F.lit(of), "")
    return F.concat_ws("", F.transform(own, lambda c: F.get(table, F.conv(c, 5, 10).cast("int"))))


def is_nucleotide(col, share: float = 0.9) -> Column:
    first = F.substring(col, 1, 1024)
    return F.length(F.regexp_replace(first, "[^ACGTUNacgtun]", "")) > share * F.length(first)


def wrap(col, width: int = 80) -> Column:
    return F.regexp_replace(col, f"(.{{{width}}})(?=.)", "$1\n")


def accession(col) -> Column:
    return F.substring_index(col, " ", 1)


def annotation(score: Column) -> Column:
    return F.when(score >= 1, "|").when(score >= 0.5, "+").when(score > 0, ".").otherwise(" ")
