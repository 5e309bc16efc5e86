"""Row-local arithmetic on gene models.

A transcript is one row: ``strand`` and ``exons``, an array in genome order of structs
``start, end, cds_start, cds_end, num, frame, offset`` (0-based half-open; coding part null when there is none;
``offset`` counts the coding bases 5' of the exon).
Everything below works inside that row, so positions are translated without a per-base table and without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    Functions over arrays are not taken together by the optimizer: each mention of such a column runs it again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def introns(exons, strand) -> Column:
    """Gaps between neighbouring exons, numbered from the 5' end."""
    exons, strand = col(exons), col(strand)
    n = F.size(exons)

    def gap(exon, i):
        following = F.get(exons, i + 1)
        num = F.when(strand > 0, i + 1).otherwise(n - 1 - i).cast("int")
        return F.struct(exon["end"].alias("start"), following["start"].alias("end"), num.alias("num"))

    return F.transform(F.slice(exons, F.lit(1), F.greatest(n - 1, F.lit(0))), gap)


def coding(exons) -> Column:
    """Coding parts in genome order, with the frame of their exon."""
    parts = F.filter(col(exons), lambda e: e["cds_start"].isNotNull())
    return F.transform(
        parts,
        lambda e: F.struct(
            e["cds_start"].alias("start"), e["cds_end"].alias("end"), e["num"].alias("num"), e["frame"].alias("frame"),
            e["offset"].alias("offset"),
        ),
    )


def place(position, start, end) -> Column:
    """``exonLeft``, ``exonRight`` or ``withinElem`` for a position in the closed span, else null."""
    p = col(position)
    return (
        F.when(p == start, "exonLeft").when(p == end, "exonRight").when((p > start) & (p < end), "withinElem")
    )


def holding(elements, position, rel_pos: str | None = None) -> Column:
    """Elements whose closed span holds the position, in genome order."""
    p = col(position)
    tests = {
        None: lambda e: (e["start"] <= p) & (p <= e["end"]),
        "exonLeft": lambda e: e["start"] == p,
        "exonRight": lambda e: (e["end"] == p) & (e["start"] != p),
        "withinElem": lambda e: (e["start"] < p) & (p < e["end"]),
    }
    return F.filter(col(elements), tests[rel_pos])


def choose(hits: Column, direction) -> Column:
    """Highest element for a positive direction, else the lowest; null when there is none."""
    d = direction if isinstance(direction, Column) else F.lit(direction)
    return F.try_element_at(hits, F.when(d > 0, -1).otherwise(1))


def numbered(elements, num) -> Column:
    """Element with a given number."""
    wanted = col(num)
    return F.get(F.filter(col(elements), lambda e: e["num"] == wanted), F.lit(0))


def bases_before(parts: Column, strand, position: Column) -> Column:
    """Coding bases 5' of a 1-based position, from the spans alone."""
    zero = F.lit(0).cast("bigint")
    clamp = lambda v, high: F.greatest(zero, F.least(v, high))
    plus = F.aggregate(parts, zero, lambda a, e: a + clamp(position - 1 - e["start"], e["end"] - e["start"]))
    minus = F.aggregate(parts, zero, lambda a, e: a + clamp(e["end"] - position, e["end"] - e["start"]))
    return F.when(col(strand) > 0, plus).otherwise(minus)


def cds_offset(exons, strand, position) -> Column:
    """0-based offset in the coding sequence of a 1-based genome position; -1 outside of it."""
    p, plus = col(position), col(strand) > 0
    hits = F.transform(
        F.filter(col(exons), lambda e: (e["cds_start"] < p) & (p <= e["cds_end"])),
        lambda e: e["offset"] + F.when(plus, p - 1 - e["cds_start"]).otherwise(e["cds_end"] - p),
    )
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1).cast("bigint"))


def cds_length(exons) -> Column:
    return F.aggregate(coding(exons), F.lit(0).cast("bigint"), lambda a, e: a + e["end"] - e["start"])


def genome_position(exons, strand, offset) -> Column:
    """1-based genome position of a 0-based coding offset; null outside the coding sequence."""
    o, plus = col(offset), col(strand) > 0
    hits = F.transform(
        F.filter(col(exons), lambda e: (e["offset"] <= o) & (o < e["offset"] + e["cds_end"] - e["cds_start"])),
        lambda e: F.when(plus, e["cds_start"] + 1 + o - e["offset"]).otherwise(e["cds_end"] - o + e["offset"]),
    )
    return F.get(hits, F.lit(0))


def frame_at(exons, strand, position, direction) -> Column:
    """Frame 0-2 of a position in the coding part picked by direction; -1 without a frame, null outside."""
    p, s = col(position), col(strand)
    hits = F.filter(col(exons), lambda e: (e["cds_start"] <= p) & (p <= e["cds_end"]))

    def frame(part):
        distance = F.when(s > 0, p - part["cds_start"] - 1).otherwise(part["cds_end"] - p)
        return (
            F.when(part["frame"] == -1, -1)
            .when((p > part["cds_start"]) & (p <= part["cds_end"]), F.pmod(distance + part["frame"], F.lit(3)))
            .cast("int")
        )

    return bound(choose(hits, direction), frame)


def spliced_length(parts) -> Column:
    return F.aggregate(col(parts), F.lit(0).cast("bigint"), lambda a, e: a + e["end"] - e["start"])


def spliced_offset(parts, strand, position) -> Column:
    """0-based offset of a 1-based position in the joined spans of any element array; null outside."""
    p, e = col(position), col(parts)
    inside = F.exists(e, lambda x: (x["start"] < p) & (p <= x["end"]))
    return F.when(inside, bases_before(e, strand, p))


def spliced_position(parts, strand, offset) -> Column:
    """1-based genome position of a 0-based offset in the joined spans; null outside."""
    e, o, plus = col(parts), col(offset), col(strand) > 0
    ordered = F.when(plus, e).otherwise(F.reverse(e))
    zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("pos"))

    def step(acc, x):
        size = x["end"] - x["start"]
        local = o - acc["seen"]
        here = F.when(plus, x["start"] + 1 + local).otherwise(x["end"] - local)
        hit = (local >= 0) & (local < size)
        return F.struct((acc["seen"] + size).alias("seen"), F.when(hit, here).otherwise(acc["pos"]).alias("pos"))

    return F.aggregate(ordered, zero, step)["pos"]
