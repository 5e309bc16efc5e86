"""Alterations of a coding sequence and their consequences, as columns.

Positions named ``cds_start``/``cds_end`` are 1-based and closed; offsets are 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .models import bound
from .sequence import codon_end, codon_start, col, cut, piece, translate_cds

NMD_DISTANCE = 50  # bases between the truncation boundary and the last junction
PEPTIDE = 9


def usable(seq, start, end) -> Column:
    """The CDS positions exist, are not negative and lie inside the sequence."""
    s, e = col(start), col(end)
    return F.coalesce((s >= 1) & (e >= s) & (e <= F.length(col(seq))), F.lit(False))


def apply_alteration(seq, start, end, alt, is_insertion) -> Column:
    """Altered coding sequence; an insertion goes behind base ``start``. Unusable positions give an empty text."""
    q, s, e, a = col(seq), col(start), col(end), col(alt)
    inserted = F.concat(piece(q, 1, s), a, F.substring(q, s + 1, F.length(q)))
    replaced = F.concat(piece(q, 1, s - 1), a, F.substring(q, e + 1, F.length(q)))
    return F.when(usable(q, s, e), F.when(col(is_insertion), inserted).otherwise(replaced)).otherwise("")


def full_codons(start, end, length, first_codon: bool = True) -> tuple[Column, Column]:
    """0-based closed bounds of the whole codons around a range; null outside the sequence.

    ``first_codon=False`` also gives null when the range touches the first codon, as the reported codon
    columns do.
    """
    lo, hi, n = codon_start(start), codon_end(end), col(length)
    ok = (lo >= (0 if first_codon else 1)) & (hi < n) & (lo < n)
    return F.when(ok, lo), F.when(ok, hi)


def marked_codons(seq, start, end, alt, is_insertion) -> tuple[Column, Column]:
    """Whole codons before and after: lower case, changed bases upper case."""
    q, s, e, a, ins = col(seq), col(start), col(end), col(alt), col(is_insertion)
    lo, hi = full_codons(s, e, F.length(q), first_codon=False)
    head = F.lower(piece(q, lo + 1, s - 1 - lo))
    tail = F.lower(piece(q, e + 1, hi + 1 - e))
    upto = F.lower(piece(q, lo + 1, s - lo))
    rest = F.lower(piece(q, s + 1, hi + 1 - s))
    before = F.when(ins, F.lower(piece(q, lo + 1, hi - lo + 1))).otherwise(
        F.concat(head, F.upper(piece(q, s, e - s + 1)), tail)
    )
    after = F.when(ins, F.concat(upto, F.upper(a), rest)).otherwise(F.concat(head, F.upper(a), tail))
    ok = usable(q, s, e) & lo.isNotNull()
    return F.when(ok, before), F.when(ok, after)


def plain_codons(seq, altered, start, end, added) -> tuple[Column, Column]:
    """Codons of both sequences over the range, widened by the inserted length ``added``."""
    q, v = col(seq), col(altered)
    lo, hi = full_codons(start, col(end) + col(added), F.length(q), first_codon=False)
    size = hi - lo + 1
    inside = (lo <= F.length(v)) & (hi <= F.length(v))
    return F.when(lo.isNotNull(), piece(q, lo + 1, size)), F.when(inside, piece(v, lo + 1, size))


def divergence(first, second) -> Column:
    """0-based index of the first differing letter over the shorter length; -1 if there is none."""
    letters = [F.split(F.upper(col(x)), "") for x in (first, second)]
    differs = F.zip_with(*letters, lambda a, b: a != b)
    some = (F.length(col(first)) > 0) & (F.length(col(second)) > 0)
    return F.when(some, F.array_position(differs, True) - 1).otherwise(-1).cast("int")


def match_length(original, altered) -> Column:
    """Letters that have to agree before two proteins count as equal again.

    6, or the logarithm to base 20 of the longer length if that is larger; an altered protein not longer
    than that falls back to the logarithm.
    """
    longest = F.greatest(F.length(col(original)), F.length(col(altered))).cast("double")
    least = F.ceil(F.log(longest) / F.log(F.lit(20.0))).cast("int")
    k = F.greatest(least, F.lit(6))
    return F.when(k >= F.length(col(altered)), least).otherwise(k)


def first_hit(places, test) -> Column:
    """First place that passes the test, -1 if none; places behind it are not tested."""
    return F.aggregate(places, F.lit(-1), lambda hit, i: F.when(hit >= 0, hit).when(test(i), i).otherwise(-1))


def reconvergence(original, altered, diverged, letters) -> Column:
    """First index at or after ``diverged`` from which the next letters occur anywhere in the original; -1 if none.

    The arguments should be plain columns: they are read once per index.
    """
    o, v, d, k = col(original), col(altered), col(diverged), col(letters)
    last = F.length(v) - k
    places = F.when((d >= 0) & (last >= d), F.sequence(d, last)).otherwise(F.array().cast("array<int>"))
    return first_hit(places, lambda i: F.contains(o, F.substring(v, i + 1, k)))


def altered_window(original_cds, altered_cds, start_aa, stop_aa, peptide: int = PEPTIDE) -> tuple[Column, Column]:
    """0-based slice bounds of the coding window around a protein difference.

    ``stop_aa`` -1 means the difference runs to the end of the altered protein. A window past the end gets
    the bound -1, which as a slice bound drops the last base.
    """
    flank = 3 * peptide
    length = F.length(col(altered_cds))
    lo = F.greatest(col(start_aa) * 3 - flank, F.lit(0))
    hi = col(stop_aa) * 3 + 2 + flank
    return lo, F.when(hi > length, F.lit(-1)).otherwise(hi)


def first_window(original, altered, diverged, peptide: int = PEPTIDE) -> Column:
    """Start of the first window of 3 * peptide bases that differs, given the first differing base; -1 if none."""
    o, v, d = col(original), col(altered), col(diverged)
    base = F.when(d >= 0, d).when(F.length(o) < F.length(v), F.length(o)).otherwise(-1)
    return F.when(base >= 0, F.greatest(base - (3 * peptide - 1), F.lit(0))).otherwise(-1)


def next_equal_window(original, altered, start, peptide: int = PEPTIDE) -> Column:
    """End of the first window at or after ``start`` that is equal in both sequences; -1 if none."""
    o, v, s = col(original), col(altered), col(start)
    n, size = F.length(v), 3 * peptide
    # a mark for each base from the start on; marks behind the end stand for what a shorter last window lacks
    letters = [F.split(F.substring(x, s + 1, F.length(x)), "") for x in (o, v)]
    marks = F.array_join(F.zip_with(*letters, lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    padded = F.concat(F.substring(marks, F.lit(1), n - s), F.lit("1" * (size - 1)))
    found = F.when((s >= 0) & (n > s), F.instr(padded, "1" * size))
    return bound(found, lambda at: F.when(at > 0, F.least(n, s + at - 1 + size)).otherwise(-1))


def codons_before(offset, n: int, frame: int = 0) -> Column:
    new = col(offset) - 3 * n
    return F.when(new <= 0, new).otherwise(nearest_frame(new, frame)).cast("int")


def codons_after(offset, n: int, length, frame: int = 2) -> Column:
    new = col(offset) + 3 * n
    return F.when(new >= col(length), -1).otherwise(nearest_frame(new, frame)).cast("int")


def nearest_frame(offset, frame: int) -> Column:
    """Position of the given frame inside the codon of the offset."""
    o = col(offset)
    return (o - F.pmod(o, F.lit(3)) + frame).cast("int")


def nmd_susceptible(altered, cds_start, boundary) -> Column:
    """A stop between three codons before the variant and the truncation boundary; null without positions."""
    v, s, b = col(altered), col(cds_start), col(boundary)
    lo = F.greatest(codons_before(s, 3, 0), F.lit(0))
    hi = nearest_frame(b, 2)
    hi = F.when(hi > F.length(v), -1).otherwise(hi)
    known = (s >= 0) & b.isNotNull() & (b != 0)
    return F.when(known, F.contains(translate_cds(cut(v, lo, hi)), F.lit("*")))


def nsd_susceptible(altered, cds_start, boundary) -> Column:
    """No stop from three codons before the variant to the end; null when NMD is true or unknown."""
    lo = F.greatest(codons_before(cds_start, 3, 0), F.lit(0))
    stopped = F.contains(translate_cds(cut(altered, lo, F.lit(-1))), F.lit("*"))
    return F.when(~nmd_susceptible(altered, cds_start, boundary), ~stopped)


def near_last_junction(cds_start, cds_end, boundary, junction) -> Column:
    """Either end of the variant lies between the truncation boundary and the last junction; null without them."""
    b, j = col(boundary), col(junction)
    inside = col(cds_start).between(b, j) | col(cds_end).between(b, j)
    return F.when(b.isNotNull() & j.isNotNull(), F.coalesce(inside, F.lit(False)))
