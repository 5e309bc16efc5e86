"""Nucleotide and protein columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in TCAG order.
BASE_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    """Codon to amino acid, from the code string."""
    codons = [a + b + c for a in BASE_ORDER for b in BASE_ORDER for c in BASE_ORDER]
    return dict(zip(codons, AMINO_ACIDS))


def code_places() -> list[str]:
    """Amino acids by codon with the bases T, C, A, G as the digits 0 to 3; places of no codon hold ``X``."""
    places = ["X"] * 334
    for codon, amino in codon_table().items():
        places[int("".join(str(BASE_ORDER.index(b)) for b in codon))] = amino
    return places


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def piece(seq, start, length) -> Column:
    """1-based substring with column bounds; a length below 1 gives an empty string."""
    return F.substring(col(seq), start if isinstance(start, Column) else F.lit(start),
                       F.greatest(F.lit(0), length if isinstance(length, Column) else F.lit(length)))


def cut(seq, start: Column, end: Column) -> Column:
    """0-based half-open slice; a negative end counts from the back."""
    seq = col(seq)
    stop = F.when(end < 0, F.length(seq) + end).otherwise(end)
    return piece(seq, start + 1, (stop - start).cast("int"))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def translate_cds(seq, to_stop: bool = False) -> Column:
    """Protein of a coding sequence: ``*`` for stops, ``X`` for codons with unknown bases, partial codons ignored.

    One pass cuts the codons; each is read as a number, its place in the code table.
    """
    digits = F.translate(F.upper(col(seq)), "TUCAG0123456789", "00123" + "N" * 10)
    codons = F.regexp_extract_all(digits, F.lit(".{3}"), F.lit(0))
    # folded to one literal array; the leading 1 keeps signs and blanks from being read as part of a number
    table = F.split(F.lit(",".join(code_places())), ",")
    place = lambda c: F.concat(F.lit("1"), c).try_cast("int") - 1000
    protein = F.array_join(F.transform(codons, lambda c: F.coalesce(F.get(table, place(c)), F.lit("X"))), "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


def codon_start(position) -> Column:
    """0-based start of the codon that holds a 1-based position."""
    p = col(position) - 1
    return (p - F.pmod(p, F.lit(3))).cast("int")


def codon_end(position) -> Column:
    """0-based inclusive end of the codon that holds a 1-based position."""
    return codon_start(position) + 2


def clean_allele(text) -> Column:
    """Bases only."""
    return F.regexp_replace(col(text), "[^ACTG]", "")
