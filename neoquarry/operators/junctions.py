"""Splice junctions against gene models.

``start_pos``/``end_pos`` are intron bounds. Rows that carry a gene model (junction x isoform) are handled
inside the row; only assignment, prevalence and dominance look across rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import models as m
from ..plans.intervals import GENE_BIN, overlap_join
from ..plans.rows import pinned, unroll

START, END, STRAND = "start_pos", "end_pos", "strand"
INTRONIC, EXONIC, FRAMESHIFT = 500, 100, 200  # fixed values: aberration scores
INTERGENIC = 100  # fixed value: length of an exon beyond the gene


def _gaps(df: DataFrame | None = None) -> Column:
    """Introns of the row's isoform; where ``modelled`` has listed them, that list."""
    return F.col("_introns") if df is not None and "_introns" in df.columns else m.introns("exons", STRAND)


def _plus() -> Column:
    return F.col(STRAND) > 0


def assigned_lists(assigned: DataFrame, key: str = "sj_id") -> DataFrame:
    """Per junction ``assigned_isoforms``, sorted; no more than the isoforms of its gene."""
    return assigned.groupBy(key).agg(F.array_sort(F.collect_set("isoform")).alias("assigned_isoforms"))


def junction_models(junctions: DataFrame, transcripts: DataFrame, on: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Junction x isoform rows: every isoform of the junction's gene with its exon array."""
    extra = [c for c in transcripts.columns if c not in junctions.columns or c in on]
    if STRAND in junctions.columns:
        junctions = junctions.drop(STRAND)
        extra = list(dict.fromkeys([*extra, STRAND]))
    return junctions.join(transcripts.select(*extra), list(on))


def modelled(transcripts: DataFrame, bounds: bool = False) -> DataFrame:
    """Transcripts with ``_introns`` and, if asked, ``_bounds``: listed once per isoform, not for every position it meets."""
    return pinned(transcripts, {"_introns": _gaps(), **({"_bounds": acceptor_bounds()} if bounds else {})})


def by_position(
    junctions: DataFrame, transcripts: DataFrame, classify: Callable[[DataFrame], DataFrame], columns: list[str]
) -> DataFrame:
    """Gene-model work once per (gene, start, end) instead of once per sample record.

    ``classify`` gets position x isoform rows with the exon arrays; of its result only ``columns`` are joined back to the
    records, so no exon array is in an exchange after it. Records without a gene or a position give no row.
    """
    where = ["gene", START, END]
    found = classify(junction_models(junctions.select(*where).distinct(), transcripts)).select(*where, *columns)
    return junctions.drop(*columns).join(found, where)


def is_canonical(start=START, end=END, gaps: Column | None = None) -> Column:
    s, e = F.col(start), F.col(end)
    return F.exists(_gaps() if gaps is None else gaps, lambda g: (g["start"] == s) & (g["end"] == e))


def canonical_junction(df: DataFrame) -> DataFrame:
    return pinned(df, {"canonical": is_canonical(gaps=_gaps(df))})


def canonical_sources(junctions: DataFrame, sites: DataFrame) -> DataFrame:
    """Genes per annotation source (db) with an intron at exactly the junction's position."""
    asked = junctions.select("chrom", START, END).distinct()
    genes = F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes")
    return asked.join(sites.select("chrom", START, END, "db", "gene"), ["chrom", START, END]).groupBy(
        "chrom", START, END, "db"
    ).agg(genes)


def exon_at(position, direction: int, rel_pos: str | None = None) -> Column:
    return m.choose(m.holding("exons", position, rel_pos), direction)


def skipped(start: Column, end: Column) -> Column:
    """Exon numbers strictly between the exons at both ends; null if an end is not exonic."""
    ends = F.struct(exon_at(start, -1)["num"].alias("a"), exon_at(end, 1)["num"].alias("b"))
    return m.bound(ends, lambda x: _between(x["a"], x["b"]))


def _between(a: Column, b: Column) -> Column:
    lo, hi = F.least(a, b) + 1, F.greatest(a, b) - 1
    # least/greatest skip nulls, so both ends are tested
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")),
    )


def skipped_exons(df: DataFrame) -> DataFrame:
    return df.withColumn("exon_skip", skipped(F.col(START), F.col(END)))


def frames(df: DataFrame, start: Column, end: Column, **more: Column) -> DataFrame:
    """``rf_start``, ``rf_end`` in reading direction and whether the frame goes on (null if one is missing).

    ``more``: further columns to work out in the same step.
    """
    both = {"_left": m.frame_at("exons", STRAND, start, -1), "_right": m.frame_at("exons", STRAND, end, 1)}
    at = pinned(df, {**both, **more})
    a, b = F.when(_plus(), F.col("_left")).otherwise(F.col("_right")), F.when(_plus(), F.col("_right")).otherwise(F.col("_left"))
    out = at.withColumns({"rf_start": a, "rf_end": b}).drop("_left", "_right")
    return out.withColumn("frame_preserved", F.pmod(F.col("rf_start") + 1, F.lit(3)) == F.col("rf_end"))


def frame_preserved(df: DataFrame) -> DataFrame:
    """The junction end is moved to the first exon base before its frame is read."""
    return frames(df, F.col(START), F.col(END) + 1)


def aberration_class(df: DataFrame, intronic: bool = False, legacy_skip_score: bool = False, shift_end: bool = True) -> DataFrame:
    """Exon labels, skips, frame, effects and score of a junction in one isoform.

    +1 per skipped exon, 500 intronic or else 100 off the exon ends, 200 when the frame is not kept (an
    unknown frame counts). Rows with an intronic end are dropped unless ``intronic``. The end position is
    the first exon base (``shift_end``), as in the assignment.
    """
    s = F.col(START)
    e = F.col(END) + 1 if shift_end else F.col(END)

    def label(position, x, canon):
        return m.bound(m.place(position, x["start"], x["end"]), lambda t: F.when(t == canon, "exon_canon").otherwise(t))

    def told(x):
        # the lowest exon at an end names it; skips are counted from there to the highest one at the other end
        a, b = m.choose(x["a"], 0), m.choose(x["b"], 0)
        skip = m.bound(F.struct(a["num"].alias("a"), m.choose(x["b"], 1)["num"].alias("b")), lambda n: _between(n["a"], n["b"]))
        return F.struct(label(s, a, "exonRight").alias("start"), label(e, b, "exonLeft").alias("end"), skip.alias("skip"))

    held = F.struct(m.holding("exons", s).alias("a"), m.holding("exons", e).alias("b"))
    out = frames(df, s, e, _told=m.bound(held, told)).withColumns(
        {"exon_start": F.col("_told.start"), "exon_end": F.col("_told.end"), "exon_skip": F.col("_told.skip")}
    ).drop("_told")
    off = F.col("exon_start").isNull() | F.col("exon_end").isNull()
    inner = (F.col("exon_start") != "exon_canon") | (F.col("exon_end") != "exon_canon")
    broken = ~F.coalesce("frame_preserved", F.lit(False))
    skips = F.lit(0) if legacy_skip_score else F.coalesce(F.size("exon_skip"), F.lit(0))
    skips = F.when(skips > 0, skips).otherwise(0)
    site = F.when(off, INTRONIC).when(inner, EXONIC).otherwise(0)
    effects = F.array_compact(
        F.array(
            F.when(skips > 0, F.concat(F.lit("exon_skip: "), F.array_join("exon_skip", ","))),
            F.when(off, "intronic").when(inner, "exonic"),
            F.when(broken, "frameshift"),
        )
    )
    out = out.withColumns(
        {"score": (skips + site + F.when(broken, FRAMESHIFT).otherwise(0)).cast("bigint"), "effects": effects}
    )
    return out if intronic else out.where("exon_start is not null and exon_end is not null")


def assign_isoforms(df: DataFrame, key: str = "sj_id", intronic: bool = False) -> DataFrame:
    """Canonical isoforms if there are any (score -1), else the isoforms with the lowest aberration score.

    A junction meets only the isoforms of its gene, so the groups stay small.
    """
    return _lowest(_assignable(df, intronic), [key])


def _assignable(df: DataFrame, intronic: bool) -> DataFrame:
    scored = aberration_class(canonical_junction(df), intronic=True)
    if not intronic:
        scored = scored.where("canonical or (exon_start is not null and exon_end is not null)")
    return scored.withColumn("score", F.when(F.col("canonical"), -1).otherwise(F.col("score")))


def _lowest(scored: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min("score").over(W.partitionBy(*keys))
    return scored.withColumn("_best", best).where("score = _best").drop("_best")


# what an assignment says of a junction in one isoform
ASSIGNMENT = [
    "isoform", "canonical", "score", "exon_start", "exon_end", "exon_skip", "rf_start", "rf_end", "frame_preserved", "effects",
]


def assigned_junctions(junctions: DataFrame, transcripts: DataFrame, intronic: bool = False) -> DataFrame:
    """``assign_isoforms`` with each position of a gene classified once: the records with the ``ASSIGNMENT`` columns."""

    def classify(models):
        scored = _assignable(models, intronic).select("gene", START, END, *ASSIGNMENT)
        return _lowest(scored, ["gene", START, END])

    return by_position(junctions, modelled(transcripts), classify, ASSIGNMENT)


def skipped_by_position(junctions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Records with each exon (``isoform``, ``feat_num``) they skip: the skipped rows of ``missing_exons``, by position."""

    def classify(models):
        out = unroll(models, "feat_num", skipped(F.col(START), F.col(END)))
        known = F.exists("exons", lambda x: x["num"] == F.col("feat_num"))
        return out.where(known)

    return by_position(junctions, transcripts, classify, ["isoform", "feat_num"])


def aberration_text(assigned: DataFrame, key: str = "sj_id") -> DataFrame:
    """One text per junction over its assigned aberrant isoforms."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    kept = F.when(F.col("frame_preserved"), "True").when(~F.col("frame_preserved"), "False").otherwise("None")
    text = F.concat(
        F.lit("isoform_id = "), "isoform", F.lit(";exon_skip = "), F.coalesce(F.array_join("exon_skip", ","), F.lit("")),
        F.lit(";frame_preserved = "), kept, F.lit(";calc_rf = "), shown("rf_start"), F.lit("-"), shown("rf_end"),
        F.lit(";effects = "), F.array_join("effects", ","),
    )
    rows = assigned.where("score >= 0").groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(text)), ">>").alias("_t")
    )
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit("::"), F.col("_t")).alias("aberrations"))


def before_coding(df: DataFrame) -> DataFrame:
    """Does the 5' end of the junction precede the start codon? False for non-coding isoforms."""
    parts = m.coding("exons")
    first = F.when(_plus(), F.get(parts, F.lit(0))["start"]).otherwise(F.element_at(parts, -1)["end"])
    hit = F.when(_plus(), first > F.col(START)).otherwise(first < F.col(END))
    return df.withColumn("before_coding", F.when(F.size(parts) > 0, hit).otherwise(False))


def joined_elements(canonical_edges: bool = False) -> tuple[Column, Column]:
    """Structs (kind, num, start, end) at the junction start and end: exon first, intron as fallback."""

    def at(position, exon_direction, rel_pos):
        def tagged(kind, e):
            def named(x):
                told = F.struct(F.lit(kind).alias("kind"), x["num"].alias("num"), x["start"].alias("start"), x["end"].alias("end"))
                return F.when(x.isNotNull(), told)

            return m.bound(e, named)

        d = F.lit(exon_direction) * F.col(STRAND)
        exon = m.choose(m.holding("exons", position, rel_pos), d)
        intron = m.choose(m.holding(_gaps(), position, rel_pos), F.lit(-1) * F.col(STRAND))
        return F.coalesce(tagged("exon", exon), tagged("intron", intron))

    left, right = ("exonRight", "exonLeft") if canonical_edges else (None, None)
    return at(START, -1, left), at(END, 1, right)


def ligated_elements(df: DataFrame, canonical_edges: bool = False) -> DataFrame:
    a, b = joined_elements(canonical_edges)
    out = pinned(df, {"elem_start": a, "elem_end": b})
    name = lambda c: F.coalesce(F.concat(f"{c}.kind", F.lit("_"), F.col(f"{c}.num").cast("string")), F.lit("None"))
    return out.withColumn("ligated", F.concat(name("elem_start"), F.lit(":"), name("elem_end")))


def modified_exons(df: DataFrame) -> DataFrame:
    """Exons as stretched or cut by the junction; an intronic end extends the neighbouring exon."""
    out = ligated_elements(df)

    def exon(elem, lower):
        own = F.col(f"{elem}.num")
        shifted = F.when(_plus(), own if lower else own + 1).otherwise(own + 1 if lower else own)
        num = F.when(F.col(f"{elem}.kind") == "intron", shifted).otherwise(own)
        return m.numbered("exons", num)

    out = pinned(out, {"_a": exon("elem_start", True), "_b": exon("elem_end", False)})
    span = lambda lo, hi: F.concat("chrom", F.lit(":"), lo.cast("string"), F.lit("-"), hi.cast("string"))
    left = F.coalesce(span(F.col("_a.start"), F.col(START)), F.lit("None"))
    right = F.coalesce(span(F.col(END), F.col("_b.end")), F.lit("None"))
    five_left = F.when(_plus(), F.col(START)).otherwise(F.col("_a.start"))
    five_right = F.when(_plus(), F.col("_b.end")).otherwise(F.col(END))
    return out.withColumns(
        {
            "exon_left": F.col("_a.num"), "exon_right": F.col("_b.num"),
            "exon_positions": F.concat(left, F.lit("*"), right),
            "left_canonical": F.coalesce(F.col("_a.end") == F.col(START), F.lit(False)),
            "right_canonical": F.coalesce(F.col("_b.start") == F.col(END), F.lit(False)),
            "left_frame": F.when(F.col("_a").isNotNull(), m.frame_at("exons", STRAND, five_left, F.col(STRAND))),
            "right_frame": F.when(F.col("_b").isNotNull(), m.frame_at("exons", STRAND, five_right, F.col(STRAND))),
        }
    ).drop("_a", "_b")


def junction_has_exon(df: DataFrame, start: str = "asked_start", end: str = "asked_end", side: int = 3) -> DataFrame:
    """Does the junction join the asked exon at its start (1), its end (2) or either (3)?"""
    same = lambda e: F.coalesce((F.col(f"{e}.kind") == "exon") & (F.col(f"{e}.start") == F.col(start)) & (F.col(f"{e}.end") == F.col(end)), F.lit(False))
    out = df if "elem_start" in df.columns else ligated_elements(df)
    tests = {1: same("elem_start"), 2: same("elem_end"), 3: same("elem_start") | same("elem_end")}
    return out.withColumn("has_exon", tests[side])


def junction_has_exon_modified(df: DataFrame, num: str = "asked") -> DataFrame:
    """As ``junction_has_exon``, for exons that the junction may stretch into an intron or cut.

    ``has_start``: the asked exon (by number) is the one the junction's start belongs to, ``has_end``: its end,
    ``has_exon``: either. An end in an intron belongs to the exon it makes longer; one outside the gene to none.
    """
    out = df if "exon_left" in df.columns else modified_exons(df)
    same = lambda c: F.coalesce(F.col(c) == F.col(num), F.lit(False))
    return out.withColumns(
        {"has_exon": same("exon_left") | same("exon_right"), "has_start": same("exon_left"), "has_end": same("exon_right")}
    )


def missing_exons(df: DataFrame) -> DataFrame:
    """Skipped exons, and the parts cut off when an end lies inside an exon. One row per missing stretch."""
    s, e = F.col(START), F.col(END)
    skips = F.coalesce(skipped(s, e), F.array().cast("array<int>"))
    row = lambda kind, x, lo, hi: F.struct(F.lit(kind).alias("kind"), x["num"].alias("num"), lo.alias("lo"), hi.alias("hi"))
    whole = F.transform(
        m.bound(skips, lambda k: F.filter("exons", lambda x: F.array_contains(k, x["num"]))),
        lambda x: row("skipped", x, x["start"], x["end"]),
    )
    first = F.transform(m.holding("exons", s, "withinElem"), lambda x: row("cut", x, s, x["end"]))
    last = F.transform(m.holding("exons", e, "withinElem"), lambda x: row("cut", x, x["start"], e))
    return unroll(df, "_m", F.concat(whole, first, last)).select(
        *df.columns, F.col("_m.kind").alias("missing_kind"), F.col("_m.num").alias("missing_num"),
        F.col("_m.lo").alias("missing_start"), F.col("_m.hi").alias("missing_end"),
    )


def retained_introns(df: DataFrame) -> DataFrame:
    """Intron parts kept when an end of the junction lies inside an intron; one row per end."""
    s, e = F.col(START), F.col(END)
    row = lambda side, x, lo, hi: F.struct(F.lit(side).alias("side"), x["num"].alias("num"), lo.alias("lo"), hi.alias("hi"))
    first = F.transform(m.holding(_gaps(), s, "withinElem"), lambda x: row("start", x, x["start"], s))
    last = F.transform(m.holding(_gaps(), e, "withinElem"), lambda x: row("end", x, e, x["end"]))
    return unroll(df, "_m", F.concat(first, last)).select(
        *df.columns, F.col("_m.side").alias("retained_side"), F.col("_m.num").alias("retained_num"),
        F.col("_m.lo").alias("retained_start"), F.col("_m.hi").alias("retained_end"),
    )


def anchor_same_feature(df: DataFrame) -> DataFrame:
    """Is the outermost read position in the same element as its junction end? Null when neither is in the gene."""

    def feature(position):
        d = F.lit(-1) * F.col(STRAND)
        exon = m.choose(m.holding("exons", position), d)["num"]
        intron = m.choose(m.holding(_gaps(), position), d)["num"]
        return F.coalesce(F.concat(F.lit("exon_"), exon.cast("string")), F.concat(F.lit("intron_"), intron.cast("string")))

    def same(a, b):
        x, y = feature(a), feature(b)
        return F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)))

    return df.withColumns({"same_start": same(START, "leftmost"), "same_end": same(END, "rightmost")})


def overlap_code(start, end, other_start, other_end) -> Column:
    """Bit 1: the other start lies in [start, end); bit 2: the other end lies in (start, end]."""
    inside = F.when((start <= other_start) & (other_start < end), 1).otherwise(0)
    return inside + F.when((start < other_end) & (other_end <= end), 2).otherwise(0)


def junction_overlap_code(pairs: DataFrame, by_anchors: bool = False) -> DataFrame:
    """Code of the pair (``other_*`` columns); -1 on different chromosomes."""
    s, e = (F.col("leftmost"), F.col("rightmost")) if by_anchors else (F.col(START), F.col(END))
    code = overlap_code(s, e, F.col("other_start"), F.col("other_end"))
    return pairs.withColumn("overlap_code", F.when(F.col("chrom") != F.col("other_chrom"), -1).otherwise(code))


def overlapping_junctions(left: DataFrame, right: DataFrame, width: int = GENE_BIN) -> DataFrame:
    """Pairs of junctions on one chromosome whose spans meet; ``right`` has chrom and ``other_*`` columns."""
    return overlap_join(left, right, (START, END), ("other_start", "other_end"), width=width)


def nearest_canonical_junction(df: DataFrame) -> DataFrame:
    """Next intron of the isoform downstream of (or around) the junction's 5' end."""
    gaps = _gaps()
    s, e = F.col(START), F.col(END)
    ahead = F.get(F.filter(gaps, lambda g: g["end"] > s), F.lit(0))
    behind = F.filter(gaps, lambda g: g["start"] < e)
    pick = F.when(_plus(), ahead).otherwise(F.get(behind, F.size(behind) - 1))
    return df.withColumn("_g", pick).withColumns({"canon_start": F.col("_g.start"), "canon_end": F.col("_g.end")}).drop("_g")


def junctions_in_range(df: DataFrame, low: Column, high: Column, where: str = "both", canonical: int = 0) -> DataFrame:
    """Junctions with start, end or both in a range; canonical 0 = all, 1 = canonical, 2 = aberrant."""
    a, b = F.col(START).between(low, high), F.col(END).between(low, high)
    out = df.where({"start": a, "end": b, "both": a & b}[where])
    return {0: out, 1: out.where("canonical"), 2: out.where("not canonical")}[canonical]


def sample_junctions(junctions: DataFrame, regions: DataFrame, prevalence: DataFrame, min_reads: int = 1, width: int = GENE_BIN) -> DataFrame:
    """Junctions with enough reads in a region (``region_start``, ``region_end``), with their prevalence (0 if unknown)."""
    kept = junctions.where(F.col("read_count") >= min_reads)
    found = overlap_join(kept, regions, (START, END), ("region_start", "region_end"), width=width)
    table = prevalence.select("chrom", START, END, "sample_count", "control_count")
    return found.join(table, ["chrom", START, END], "left").na.fill(0, ["sample_count", "control_count"])


def aberrant_junctions(assigned: DataFrame) -> DataFrame:
    """Non-canonical junctions with the isoforms they were assigned to."""
    return assigned.where(~F.col("canonical"))


def junction_sample_prevalence(
    junctions: DataFrame, controls: list[str], min_reads: int = 1, transcripts: DataFrame | None = None
) -> DataFrame:
    """Samples and control samples that carry each junction; with ``transcripts`` only of genes that have a coding isoform."""
    if transcripts is not None:
        coding = transcripts.where(F.size(m.coding("exons")) > 0).select("gene").distinct()
        junctions = junctions.join(coding, "gene", "left_semi")
    control = F.when(F.col("sample").isin(controls), F.col("sample"))
    return junctions.where(F.col("read_count") >= min_reads).groupBy("chrom", START, END, "gene").agg(
        F.count_distinct("sample").alias("sample_count"), F.count_distinct(control).alias("control_count")
    )


def samples_above_threshold(df: DataFrame, threshold: int, controls: list[str], samples: str = "samples", counts: str = "counts") -> DataFrame:
    """Parallel comma lists to rows with enough reads, controls marked."""
    pairs = F.arrays_zip(F.split(samples, ",").alias("s"), F.split(counts, ",").alias("n"))
    out = unroll(df, "_p", pairs).withColumns(
        {"sample": F.trim(F.col("_p.s")), "reads": F.trim(F.col("_p.n")).try_cast("bigint")}
    )
    return out.where(F.col("reads") >= threshold).withColumn("is_control", F.col("sample").isin(controls)).drop("_p", samples, counts)


def splice_site(side: str = "donor") -> Column:
    donor = F.when(_plus(), F.col(START)).otherwise(F.col(END))
    return donor if side == "donor" else F.when(_plus(), F.col(END)).otherwise(F.col(START))


def group_by_splice_site(df: DataFrame, side: str = "donor", canonical_only: bool = False) -> DataFrame:
    """Per sample, isoform and exact donor or acceptor: junctions, partner sites and reads."""
    kept = df.where("canonical") if canonical_only else df
    other = splice_site("acceptor" if side == "donor" else "donor")
    return kept.withColumns({"site": splice_site(side), "_o": other}).groupBy("sample", "isoform", "site").agg(
        F.count(F.lit(1)).alias("junctions"), F.count_distinct("_o").alias("partner_sites"), F.sum("read_count").alias("reads")
    )


def acceptor_bounds() -> Column:
    """Sorted acceptors of the isoform and the ends of the transcript."""
    acceptor = lambda g: F.when(F.col(STRAND) > 0, g["end"]).otherwise(g["start"])
    return F.array_sort(F.concat(F.transform(_gaps(), acceptor), F.array("tx_start", "tx_end")))


def bracket_of(bounds: Column, start: Column, end: Column, closed_left: bool = False) -> Column:
    """Struct (lo, hi): the bin between neighbouring bounds that holds the donor, else (start, start)."""
    donor = F.when(_plus(), start).otherwise(end)
    below = F.try_element_at(F.filter(bounds, lambda b: b <= donor), F.lit(-1))
    above = F.get(F.filter(bounds, lambda b: b > donor), F.lit(0))

    def pick(x):
        placed = x["lo"].isNotNull() & x["hi"].isNotNull()
        if not closed_left:
            placed = placed & (x["lo"] != donor)
        return F.struct(F.when(placed, x["lo"]).otherwise(start).alias("lo"), F.when(placed, x["hi"]).otherwise(start).alias("hi"))

    return m.bound(F.struct(below.alias("lo"), above.alias("hi")), pick)


def acceptor_brackets(df: DataFrame, closed_left: bool = False) -> DataFrame:
    out = df if "_bounds" in df.columns else pinned(df, {"_bounds": acceptor_bounds()})
    out = pinned(out, {"_b": bracket_of(F.col("_bounds"), F.col(START), F.col(END), closed_left)})
    return out.withColumns({"bracket_start": F.col("_b.lo"), "bracket_end": F.col("_b.hi")}).drop("_b", "_bounds")


def dominance_rows(junctions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Records x isoforms with ``canonical`` and their bracket, worked out once per position."""
    place = lambda models: acceptor_brackets(canonical_junction(models))
    return by_position(junctions, modelled(transcripts, bounds=True), place, ["isoform", "canonical", "bracket_start", "bracket_end"])


def junction_dominance(
    df: DataFrame, canonical_only: bool = False, key: str = "sj_id", assigned: str | None = None, lists: DataFrame | None = None
) -> DataFrame:
    """Reads of a junction over the most reads in its bracket (1 when the bracket has none), and the winner.

    The bracket maximum is a plain aggregate, so a crowded bracket is reduced before it is shuffled. ``assigned`` names a
    column with the isoforms (array) a junction was assigned to; the winner's are then part of its text. With ``lists``
    (``assigned_lists``) the column is looked up there, for winners alone. Rows that carry their bracket already
    (``dominance_rows``) keep it.
    """
    placed = df if "bracket_start" in df.columns else acceptor_brackets(df)
    group = ["sample", "isoform", "bracket_start", "bracket_end"]
    # rows are read for their maximum and for themselves: tests of one reading stay above what both have in common
    shared = [*group, *(["canonical"] if canonical_only else [])]
    placed = pinned(placed, {c: F.col(c) for c in shared}).select(*placed.columns)
    rivals = placed.where("canonical") if canonical_only else placed
    own = assigned if lists is None else None
    top = rivals.groupBy(*group).agg(
        F.max("read_count").alias("max_reads"), F.max_by(key, F.struct(F.col("read_count"), -F.col(key))).alias("max_sj"),
        *([F.max_by(own, F.struct(F.col("read_count"), -F.col(key))).alias("max_isoforms")] if own else []),
    )
    if assigned and lists is not None:
        top = top.join(lists.select(F.col(key).alias("max_sj"), F.col(assigned).alias("max_isoforms")), "max_sj", "left")
    joined = placed.join(top, group, "left")
    told = [F.col("max_reads").cast("string"), F.lit(" - "), F.col("max_sj").cast("string")]
    if assigned:
        told += [F.lit(" - "), F.coalesce(F.array_join("max_isoforms", " | "), F.lit(""))]
    info = F.coalesce(F.concat(*told), F.lit("nothing"))
    return joined.withColumns(
        {"ratio": F.col("read_count") / F.greatest(F.coalesce("max_reads", F.lit(1)), F.lit(1)), "max_sj_info": info}
    )


def junction_evidence_ratios(junctions: DataFrame, introns: DataFrame, support: DataFrame, key: str = "sj_id") -> DataFrame:
    """Reads of a junction against introns of its gene in the same sample.

    ``introns``: gene, intron_start, intron_end, constitutive. ``support``: sample, gene, intron_start,
    intron_end, reads (unseen introns count 0). Without overlapping introns the denominator is 1 and the
    numerator 0; without constitutive ones the denominator is 1.
    """
    counts = junctions.select("sample", "gene").distinct().join(introns, "gene").join(
        support, ["sample", "gene", "intron_start", "intron_end"], "left"
    ).withColumn("reads", F.coalesce("reads", F.lit(0)))
    steady = counts.where("constitutive").groupBy("sample", "gene").agg(F.avg("reads").alias("_steady"))
    meets = (F.col(START) < F.col("intron_end")) & (F.col("intron_start") < F.col(END))
    near = junctions.join(introns, "gene").where(meets).join(
        support, ["sample", "gene", "intron_start", "intron_end"], "left"
    ).groupBy(key).agg(F.avg(F.coalesce("reads", F.lit(0))).alias("_near"))
    base = F.coalesce("_steady", F.lit(1.0))
    return (
        junctions.join(near, key, "left")
        .join(steady, ["sample", "gene"], "left")
        .withColumns(
            {
                "aberrant_canonical": F.try_divide(F.col("read_count"), F.coalesce("_near", F.lit(1.0))),
                "aberrant_constitutive": F.try_divide(F.col("read_count"), base),
                "overlap_constitutive": F.try_divide(F.coalesce("_near", F.lit(0.0)), base),
            }
        )
        .drop("_near", "_steady")
    )


def density_evidence(stretches: DataFrame, constitutive: DataFrame, key: str = "sj_id") -> DataFrame:
    """Mean read density of skipped exons or retained introns over that of constitutive exons (1 when there are none)."""
    top = stretches.groupBy(key, "sample", "gene").agg(F.avg("density").alias("_d"))
    base = constitutive.groupBy("sample", "gene").agg(F.avg("density").alias("_c"))
    return top.join(base, ["sample", "gene"], "left").select(
        key, "sample", "gene", F.try_divide(F.col("_d"), F.coalesce("_c", F.lit(1.0))).alias("density_ratio")
    )


def canonical_present_absent(junctions: DataFrame, sites: DataFrame) -> DataFrame:
    """Introns of every isoform of a gene seen in a sample: with their reads, or -1 when missing."""
    seen = junctions.groupBy("sample", "gene", "chrom", START, END).agg(F.sum("read_count").alias("reads"))
    asked = junctions.select("sample", "gene").distinct().join(sites.select("gene", "isoform", "chrom", START, END), "gene")
    joined = asked.join(seen, ["sample", "gene", "chrom", START, END], "left")
    return joined.withColumns({"present": F.col("reads").isNotNull(), "reads": F.coalesce("reads", F.lit(-1))})


def isoform_present(presence: DataFrame, transcripts: DataFrame, threshold: float = 0.0, start_end: int = 0) -> DataFrame:
    """An isoform is present when fewer introns are missing than floor((exons + 1) * threshold).

    ``start_end``: 1 needs support of the first exon, 2 of the last, 3 of either, 4 of both.
    """
    shape = transcripts.select("gene", "isoform", F.size("exons").alias("n"), STRAND, "tx_start", "tx_end", "exons")
    first = F.when(F.col("num") == 1, F.col("present"))
    numbered = presence.join(shape, ["gene", "isoform"]).withColumn(
        "num", F.get(F.filter(_gaps(), lambda g: g["start"] == F.col(START)), F.lit(0))["num"]
    )
    last = F.when(F.col("num") == F.col("n") - 1, F.col("present"))
    out = numbered.groupBy("sample", "gene", "isoform", "n").agg(
        F.count_if(~F.col("present")).alias("missing"), F.coalesce(F.bool_or(first), F.lit(False)).alias("first_seen"),
        F.coalesce(F.bool_or(last), F.lit(False)).alias("last_seen"),
    )
    ends = {
        0: F.lit(True), 1: F.col("first_seen"), 2: F.col("last_seen"), 3: F.col("first_seen") | F.col("last_seen"),
        4: F.col("first_seen") & F.col("last_seen"),
    }[start_end]
    enough = F.floor((F.col("n") + 1) * threshold) > F.col("missing")
    return out.withColumn("isoform_present", enough & ends).withColumnRenamed("n", "exon_count")


def end_support(df: DataFrame) -> DataFrame:
    """Per sample and isoform: does any junction of the sample join its first, its last exon?

    Every recorded junction counts, canonical or not, on whichever side it meets the exon.
    """
    a, b = exon_at(START, -1)["num"], exon_at(END, 1)["num"]
    meets = lambda n: F.coalesce(a == n, F.lit(False)) | F.coalesce(b == n, F.lit(False))
    return df.groupBy("sample", "gene", "isoform").agg(
        F.bool_or(meets(F.lit(1))).alias("first_met"), F.bool_or(meets(F.size("exons"))).alias("last_met")
    )


def isoform_present_by_ends(presence: DataFrame, transcripts: DataFrame, support: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``isoform_present`` with the ends supported by any junction: one column for each of the modes 0 to 4."""
    counted = isoform_present(presence, transcripts, threshold, 0)
    joined = counted.join(support, ["sample", "gene", "isoform"], "left")
    first, last = (F.coalesce(c, F.lit(False)) for c in ("first_met", "last_met"))
    ends = (F.lit(True), first, last, first | last, first & last)
    return joined.withColumns({f"present_{i}": F.col("isoform_present") & e for i, e in enumerate(ends)})


# ---- transcripts as junction chains -----------------------------------------------------------


def chain_of(gaps: Column) -> Column:
    return F.transform(gaps, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end")))


def canonical_transcript(transcripts: DataFrame) -> DataFrame:
    return transcripts.withColumn("chain", chain_of(_gaps()))


def transcript_with_junction(df: DataFrame, competing: bool = True) -> DataFrame:
    """Canonical chain without the introns the junction overlaps (and, if ``competing``, without others in its bracket), plus the junction."""
    s, e = F.col(START), F.col(END)
    out = pinned(df, {"_gaps": _gaps(), "_bounds": acceptor_bounds()})
    out = pinned(out, {"_own": bracket_of(F.col("_bounds"), s, e)})

    def stays(g):
        free = overlap_code(s, e, g["start"], g["end"]) == 0
        if not competing:
            return free
        return free & (bracket_of(F.col("_bounds"), g["start"], g["end"]) != F.col("_own"))

    kept = F.filter("_gaps", stays)
    chain = F.array_sort(F.concat(chain_of(kept), F.array(F.struct(s.alias("start"), e.alias("end")))))
    return pinned(out, {"chain": chain}).drop("_own", "_gaps", "_bounds")


def walked_transcript(df: DataFrame) -> DataFrame:
    """``chain`` walked from the junction both ways over the canonical introns, from junction x isoform rows.

    Downwards the walk begins at the exon that holds the junction's start, upwards at the one that holds its end, and each
    intron leads to the next exon until none is left. The introns of an isoform form a line, so the arms are the introns
    below the one exon and above the other: no loop. An end in no exon has no arm; the introns the junction spans are left
    out. A junction without a start or an end has a null chain.
    """
    s, e = F.col(START), F.col(END)
    lower, upper = m.choose(m.holding("exons", s, None), -1), m.choose(m.holding("exons", e, None), 1)
    out = df.withColumns({"_gaps": _gaps(), "_floor": lower["start"], "_roof": upper["end"]})
    arms = F.filter(
        "_gaps", lambda g: F.coalesce(g["end"] <= F.col("_floor"), F.lit(False)) | F.coalesce(g["start"] >= F.col("_roof"), F.lit(False))
    )
    chain = F.array_sort(F.concat(chain_of(arms), F.array(F.struct(s.alias("start"), e.alias("end")))))
    return out.withColumn("chain", F.when(s.isNotNull() & e.isNotNull(), chain)).drop("_gaps", "_floor", "_roof")


def junction_transcript(df: DataFrame) -> DataFrame:
    """The longest transcript around one junction: ``chain``, ``reached`` (its last exon), from junction x isoform rows.

    All canonical introns of the isoform count as present. They form a line, one step from each exon to the next, so
    the longest chain from the first exon through the junction is found inside the row: the introns up to the exon the
    junction leaves, the junction, the introns from the exon it enters. Exons may be stretched or cut by the junction. One
    that ends outside the gene ends the chain (``reached`` is null); one that begins outside has none and gives no row.
    """
    out = modified_exons(df)
    left, entered = (
        F.when(_plus(), F.col(a)).otherwise(F.col(b)) for a, b in (("exon_left", "exon_right"), ("exon_right", "exon_left"))
    )
    own = F.struct(F.col(START).alias("start"), F.col(END).alias("end"))
    kept = F.filter(_gaps(), lambda g: (g["num"] < left) | F.coalesce(g["num"] >= entered, F.lit(False)))
    return out.withColumns(
        {
            "chain": F.array_sort(F.concat(chain_of(kept), F.array(own))),
            "reached": F.when(entered.isNotNull(), F.greatest(entered, F.size("exons"))),
        }
    ).where(left.isNotNull())


def collapsed(assigned: DataFrame) -> DataFrame:
    """One record for each position in a sample and isoform: the least ``sj_id``, the reads of all."""
    rest = [c for c in assigned.columns if c not in ("sample", "isoform", START, END, "sj_id", "read_count")]
    kept = F.min_by(F.struct(*rest), "sj_id").alias("_rest")
    rows = assigned.groupBy("sample", "isoform", START, END).agg(
        F.min("sj_id").alias("sj_id"), F.sum("read_count").alias("read_count"), kept
    )
    return rows.select("sample", "isoform", START, END, "sj_id", "read_count", "_rest.*")


def _steps(assigned: DataFrame, stretched: bool) -> DataFrame:
    if stretched:
        assigned = modified_exons(assigned)
        a, b = F.col("exon_left"), F.col("exon_right")
    else:
        a, b = exon_at(START, -1)["num"], exon_at(END, 1)["num"]
    return pinned(
        assigned,
        {
            "from_exon": F.when(_plus(), a).otherwise(b), "to_exon": F.when(_plus(), b).otherwise(a),
            "penalty": F.when(F.col("canonical"), 0).otherwise(1), "exon_count": F.size("exons"),
        },
    )


def transcript_edges(assigned: DataFrame, stretched: bool = False) -> DataFrame:
    """Junctions as steps from the exon at the 5' end to the exon at the 3' end, in reading order.

    ``stretched`` also takes junctions that end in an intron: they make the neighbouring exon longer.
    """
    return _steps(assigned, stretched).where("from_exon is not null and to_exon is not null")


def assigned_edges(junctions: DataFrame, transcripts: DataFrame, stretched: bool = False, key: str = "sj_id") -> DataFrame:
    """``transcript_edges`` of ``assign_isoforms``, each position of a gene worked out once.

    ``stretched`` also takes junctions that end in an intron, and gives one record for each position in a sample and
    isoform (``collapsed``). A key that several records share keeps the lowest score of them all.
    """

    def classify(models):
        return _steps(_lowest(_assignable(models, stretched), ["gene", START, END]), stretched)

    records = junctions.select(key, "sample", "gene", START, END, "read_count")
    told = ["isoform", "canonical", "score", "from_exon", "to_exon", "penalty", "exon_count"]
    rows = _lowest(by_position(records, transcripts, classify, told), [key]).drop("score")
    if stretched:
        rows = collapsed(rows)
    return rows.where("from_exon is not null and to_exon is not null")


def transcript_paths(edges: DataFrame, max_penalty: int = 1) -> DataFrame:
    """All junction chains per (sample, isoform) from the first exon until nothing continues them.

    Each hop joins the open chains with the steps that begin in the exon they reached. Chains with more than
    ``max_penalty`` non-canonical junctions end there and are not reported. The open chains are
    checkpointed after every hop, so the plan stays short and a lost executor costs one hop. No junction occurs
    twice in a chain, so the loop ends by itself.
    """
    from ..session import ensure_checkpoints

    ensure_checkpoints(edges.sparkSession)
    keys = ["sample", "isoform"]
    steps = edges.select(*keys, "sj_id", "from_exon", "to_exon", "penalty").distinct().checkpoint()
    open_ = steps.where("from_exon = 1").select(
        *keys, F.array("sj_id").alias("path"), F.col("to_exon").alias("reached"), F.col("penalty").alias("cost")
    ).where(F.col("cost") <= max_penalty)
    done = None
    while True:
        nxt = steps.select(*keys, F.col("from_exon").alias("reached"), "sj_id", "to_exon", "penalty")
        tried = open_.join(nxt, [*keys, "reached"], "left").checkpoint()
        repeat = F.array_contains("path", F.col("sj_id"))
        ended = tried.where(F.col("sj_id").isNull() | repeat).select(*keys, "path", "reached", "cost").distinct()
        done = ended if done is None else done.union(ended)
        open_ = (
            tried.where(F.col("sj_id").isNotNull() & ~repeat)
            .select(
                *keys, F.concat("path", F.array("sj_id")).alias("path"), F.col("to_exon").alias("reached"),
                (F.col("cost") + F.col("penalty")).alias("cost"),
            )
            .where(F.col("cost") <= max_penalty)
        )
        if open_.isEmpty():
            return done


def longest_with_junction(paths: DataFrame, junction: str = "sj_id") -> DataFrame:
    """Longest chains that contain the asked junction (a column of the rows)."""
    hits = paths.where(F.array_contains("path", F.col(junction)))
    best = hits.groupBy("sample", "isoform", junction).agg(F.max(F.size("path")).alias("_n"))
    return hits.join(best, ["sample", "isoform", junction]).where(F.size("path") == F.col("_n")).drop("_n")


def canonical_matches(chains: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Chains (``gene``, ``isoform``, ``chain`` in genome order) with ``matches``, the isoforms of their gene that have just
    this chain as canonical one, and ``own_match``, whether their own isoform is among them.

    A hash of the ordered chain is the join key; the arrays themselves decide.
    """
    canon = canonical_transcript(transcripts)
    # isoforms with one chain become one row, so a chain meets one row at most
    known = canon.groupBy("gene", "chain").agg(F.array_sort(F.collect_set("isoform")).alias("matches")).select(
        F.col("gene").alias("_gene"), F.xxhash64("chain").alias("_print"), F.col("chain").alias("_chain"), "matches"
    )
    same = (F.col("gene") == F.col("_gene")) & (F.xxhash64("chain") == F.col("_print")) & (F.col("chain") == F.col("_chain"))
    out = chains.join(known, same, "left").drop("_gene", "_print", "_chain")
    return out.withColumn("own_match", F.coalesce(F.array_contains("matches", F.col("isoform")), F.lit(False)))


def canonical_chain_seen(presence: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The canonical chain as a sample's junctions support it: the introns from the first exon up to the first one unseen.

    ``complete`` where none is missing. Samples that lack the first intron of an isoform have no chain of it.
    """
    shape = transcripts.select("gene", "isoform", STRAND, "exons")
    own = F.filter(_gaps(), lambda g: (g["start"] == F.col(START)) & (g["end"] == F.col(END)))
    numbered = presence.join(shape, ["gene", "isoform"]).withColumn("num", F.get(own, F.lit(0))["num"])
    ends = numbered.groupBy("sample", "gene", "isoform").agg(F.min(F.when(~F.col("present"), F.col("num"))).alias("unseen"))
    rows = ends.join(shape, ["gene", "isoform"])
    seen = F.filter(_gaps(), lambda g: F.col("unseen").isNull() | (g["num"] < F.col("unseen")))
    return rows.withColumns({"chain": chain_of(seen), "complete": F.col("unseen").isNull()}).where(F.size("chain") > 0)


def transcript_validity(paths: DataFrame, exon_counts: DataFrame) -> DataFrame:
    """Chains start in exon 1 by construction; valid ones also reach the last exon."""
    return paths.join(exon_counts, "isoform").withColumn("valid", F.col("reached") == F.col("exon_count"))


def transcript_text(df: DataFrame, chain: str = "chain") -> DataFrame:
    """Chain as text by position and by exon numbers, joined with `` >> ``."""
    position = lambda g: F.concat(F.col("chrom"), F.lit(":"), g["start"].cast("string"), F.lit("-"), g["end"].cast("string"))

    def exons(g):
        a, b = (F.get(m.holding("exons", g[x]), F.lit(0))["num"] for x in ("start", "end"))
        show = lambda n: F.coalesce(F.concat(F.lit("exon_"), n.cast("string")), F.lit("None"))
        return F.concat(show(a), F.lit(":"), show(b))

    return df.withColumns(
        {
            "text_positions": F.array_join(F.transform(chain, position), " >> "),
            "text_exons": F.array_join(F.transform(chain, exons), " >> "),
        }
    )


def parse_transcript_text(df: DataFrame, text: str = "text_positions") -> DataFrame:
    """Text by position back to a chain."""
    number = lambda t, i: F.regexp_extract(t, r":(-?\d+)-(-?\d+)$", i).cast("bigint")
    parsed = F.transform(F.split(text, " >> "), lambda t: F.struct(number(t, 1).alias("start"), number(t, 2).alias("end")))
    return df.withColumn("chain", parsed)


def exons_from_junctions(df: DataFrame, chain: str = "chain", name: str = "implied_exons") -> DataFrame:
    """Exons between the junctions of a chain; outer ends beyond the gene end get the gene bound or 100 bases."""
    c = F.col(chain)
    n = F.size(c)
    first_end, last_start = F.get(c, F.lit(0))["start"], F.get(c, n - 1)["end"]
    first_start = F.when(
        first_end <= F.get("exons", F.lit(0))["start"],
        F.when(first_end > F.col("tx_start"), F.col("tx_start")).otherwise(first_end - INTERGENIC),
    ).otherwise(F.get("exons", F.lit(0))["start"])
    tail = F.element_at("exons", -1)["end"]
    last_end = F.when(
        last_start >= tail, F.when(last_start < F.col("tx_end"), F.col("tx_end")).otherwise(last_start + INTERGENIC)
    ).otherwise(tail)
    known = lambda lo, hi: F.exists("exons", lambda x: (x["start"] == lo) & (x["end"] == hi))
    exon = lambda lo, hi: F.struct(lo.alias("start"), hi.alias("end"), known(lo, hi).alias("canonical"))
    inner = F.transform(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), lambda g, i: exon(g["end"], F.get(c, i + 1)["start"]))
    every = F.concat(F.array(exon(first_start, first_end)), inner, F.array(exon(last_start, last_end)))
    implied = F.when(n > 0, F.filter(every, lambda x: x["start"] != x["end"])).otherwise(
        F.transform("exons", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("canonical")))
    )
    return df.withColumn(name, implied)


def fiveprime_aberrant_junction(assigned: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per sample and isoform: the 5'-most aberrant junction, and the 5'-most intron it overlaps, else the nearest upstream one."""
    lead = F.when(_plus(), F.col(START)).otherwise(-F.col(END))
    first = assigned.where(~F.col("canonical")).groupBy("sample", "isoform").agg(
        F.min_by(F.struct("sj_id", "gene", START, END), F.struct(lead, START, END, "sj_id")).alias("_j")
    ).select("sample", "isoform", "_j.*")
    df = first.join(transcripts.select("isoform", "chrom", STRAND, "tx_start", "tx_end", "exons"), "isoform")
    s, e, gaps = F.col(START), F.col(END), _gaps()
    met = F.filter(gaps, lambda g: overlap_code(s, e, g["start"], g["end"]) > 0)
    ends = lambda a: F.when(_plus(), F.get(a, F.lit(0))).otherwise(F.get(a, F.size(a) - 1))
    before = F.filter(gaps, lambda g: F.when(F.col(STRAND) > 0, g["start"] <= s).otherwise(g["end"] >= e))
    nearest = F.when(_plus(), F.get(before, F.size(before) - 1)).otherwise(F.get(before, F.lit(0)))
    return df.withColumn("_g", F.coalesce(ends(met), nearest)).withColumns(
        {"canon_start": F.col("_g.start"), "canon_end": F.col("_g.end")}
    ).drop("_g")
