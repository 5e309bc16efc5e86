"""Transcript and sequence operators. Inputs carry ``cds`` (text), or a gene model row with ``cds_seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coding as c
from ..functions import models as m
from ..functions.sequence import codon_end, codon_start, cut, piece, reverse_complement, translate_cds
from ..plans.rows import unroll
from .genemodels import TRANSCRIPT_KEY

CHUNK = 65_536


def transcript_sequence(
    transcripts: DataFrame, genome: DataFrame, chunk: int = CHUNK, elements: Column | None = None, name: str = "cds_seq",
    keys: list[str] | None = None,
) -> DataFrame:
    """Add the coding sequence on the gene strand. Segments meet genome pieces by (chrom, piece number).

    ``genome`` has chrom, chunk and seq. A transcript with a missing piece gets null. Only the pieces of one
    transcript are gathered together. ``elements`` replaces the coding parts by another span array, ``keys`` (which must
    include chrom) name the rows when a transcript occurs more than once.
    """
    keys = keys or TRANSCRIPT_KEY
    parts = m.coding("exons") if elements is None else elements
    cuts = (
        unroll(transcripts.select(*keys, parts.alias("_parts")), "p", "_parts")
        .select(*keys, F.col("p.start").alias("_s"), F.col("p.end").alias("_e"))
    )
    cuts = unroll(cuts, "chunk", F.sequence(F.floor(F.col("_s") / chunk), F.floor((F.col("_e") - 1) / chunk)))
    first = F.col("chunk") * chunk
    lo = F.greatest(F.col("_s") - first, F.lit(0))
    hi = F.least(F.col("_e") - first, F.lit(chunk))
    pieces = cuts.join(genome.select("chrom", "chunk", "seq"), ["chrom", "chunk"], "left").select(
        *keys, "_s", "chunk", F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_t")
    )
    joined = pieces.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_s", "chunk", F.coalesce("_t", F.lit("")).alias("_t")))).alias("_p"),
        F.bool_and(F.col("_t").isNotNull()).alias("_whole"),
    )
    text = F.upper(F.array_join(F.transform("_p", lambda x: x["_t"]), ""))
    return (
        transcripts.join(joined, keys)
        .withColumn("_text", F.when(F.col("_whole"), text))
        .withColumn(name, F.when(F.col("strand") < 0, reverse_complement("_text")).otherwise(F.col("_text")))
        .drop("_p", "_whole", "_text")
    )


def genome_to_cds_position(df: DataFrame, position: str = "pos") -> DataFrame:
    """0-based coding offset of a genome position (-1 outside), and the way back."""
    out = df.withColumn("cds_position", m.cds_offset("exons", "strand", position))
    return out.withColumn("genome_position", m.genome_position("exons", "strand", "cds_position"))


def feature_number(elements: Column, position) -> Column:
    """Lowest number among elements whose closed span holds the position; -1 if none."""
    nums = F.transform(m.holding(elements, position), lambda e: e["num"])
    return F.coalesce(F.array_min(nums), F.lit(-1))


def position_feature_number(df: DataFrame, start: str = "pos", end: str = "pos_end", kind: str = "cds") -> DataFrame:
    elements = m.coding("exons") if kind == "cds" else F.col("exons")
    return df.withColumns({"feat_start": feature_number(elements, start), "feat_end": feature_number(elements, end)})


def reading_frame_at(df: DataFrame, position: str = "pos", direction: int = 0) -> DataFrame:
    return df.withColumn("frame", m.frame_at("exons", "strand", position, direction))


def codon_window(df: DataFrame, start: str = "cds_start", end: str = "cds_end", codons: int = 3, seq: str = "cds") -> DataFrame:
    """Whole-codon bounds of a range, and the positions some codons before and after it."""
    lo, hi = c.full_codons(start, end, F.length(seq))
    return df.withColumns(
        {
            "rf_start": lo, "rf_end": hi,
            "codons_before": c.codons_before(start, codons), "codons_after": c.codons_after(end, codons, F.length(seq)),
        }
    )


def allele_on_gene_strand(
    df: DataFrame, allele: str = "allele_string", strand: str = "variant_strand", gene_strand: str = "gene_strand"
) -> DataFrame:
    parts = F.split(F.regexp_replace(allele, "-", ""), "/")
    flip = F.col(strand) != F.col(gene_strand)

    def side(i):
        base = F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        return F.when(flip, reverse_complement(F.upper(base))).otherwise(base)

    return df.withColumns({"nuc_orig": side(0), "nuc_alt": side(1)})


def apply_alteration(df: DataFrame, changed: Column | None = None) -> DataFrame:
    """``cds_alt`` from cds, cds_start, cds_end, alt and change_type (1 = insertion).

    ``changed`` false (the protein stays the same) also gives an empty sequence.
    """
    altered = c.apply_alteration("cds", "cds_start", "cds_end", "alt", F.col("change_type") == 1)
    if changed is not None:
        altered = F.when(changed, altered).otherwise("")
    return df.withColumn("cds_alt", altered)


def apply_alterations_multi(
    edits: DataFrame, sequences: DataFrame, keys: tuple[str, ...] = ("case_id", "isoform")
) -> DataFrame:
    """Several alterations of one transcript of one sample applied together.

    ``edits`` has the keys, pos (1-based), len (bases removed, 0 for an insertion before ``pos``) and alt;
    ``sequences`` has at least one of the keys, and a transcript without a sample serves them all. An edit
    that starts inside an earlier one is set aside (``rejected``). Repeated edits collapse map-side, so a
    key gathers no more than the distinct edits of one sample.
    """
    shared = [k for k in keys if k in sequences.columns]
    last = F.col("_e")
    gathered = edits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("pos", "len", "alt"))).alias("_e"))
    nothing = F.filter(last, lambda e: F.lit(False))
    state = F.struct(nothing.alias("kept"), nothing.alias("rejected"), F.lit(0).cast("bigint").alias("reach"))

    def admit(acc, e):
        clash = e["pos"] <= acc["reach"]
        reach = F.greatest(acc["reach"], (e["pos"] + F.greatest(e["len"], F.lit(1)) - 1).cast("bigint"))
        return F.struct(
            F.when(clash, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(e))).alias("kept"),
            F.when(clash, F.concat(acc["rejected"], F.array(e))).otherwise(acc["rejected"]).alias("rejected"),
            reach.alias("reach"),
        )

    def put(seq, e):
        return F.concat(
            piece(seq, 1, (e["pos"] - 1).cast("int")), e["alt"],
            F.substring(seq, (e["pos"] + e["len"]).cast("int"), F.length(seq)),
        )

    sorted_out = gathered.withColumn("_s", F.aggregate(last, state, admit))
    return sequences.join(sorted_out, shared).select(
        *sequences.columns,
        *[k for k in keys if k not in shared],
        F.aggregate(F.reverse(F.col("_s.kept")), F.col("cds"), put).alias("cds_alt"),
        F.size("_s.kept").alias("applied"),
        F.col("_s.rejected").alias("rejected"),
    )


def changed_codon(df: DataFrame) -> DataFrame:
    """Codons before and after in marked form, and in plain form from both sequences."""
    insertion = F.col("change_type") == 1
    marked = c.marked_codons("cds", "cds_start", "cds_end", "alt", insertion)
    removed = F.when(insertion, 0).otherwise(F.col("cds_end") - F.col("cds_start") + 1)
    added = F.when(removed < F.length("alt"), F.length("alt")).otherwise(0)
    plain = c.plain_codons("cds", "cds_alt", "cds_start", "cds_end", added)
    return df.withColumns(
        {"codon_orig_marked": marked[0], "codon_alt_marked": marked[1], "codon_orig": plain[0], "codon_alt": plain[1]}
    )


def changed_amino_acid(df: DataFrame) -> DataFrame:
    names = {"codon_orig_marked": "aa_orig_marked", "codon_alt_marked": "aa_alt_marked", "codon_orig": "aa_orig", "codon_alt": "aa_alt"}
    return df.withColumns({a: translate_cds(codon) for codon, a in names.items()})


def translate(df: DataFrame, seq: str = "cds", name: str = "protein", to_stop: bool = False) -> DataFrame:
    return df.withColumn(name, translate_cds(seq, to_stop))


def longest_orf(df: DataFrame, seq: str = "cds") -> DataFrame:
    """Every start codon translated to the first stop; the longest proteins of a sequence, one row each.

    Each frame is translated once. Between two stops the first start codon gives the longest protein, so
    only that one counts.
    """
    q = F.col(seq)
    none = F.array().cast("array<struct<orf_start:int,orf_protein:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("orfs"))

    def frame(f):
        def take(acc, part):
            m = F.instr(part, "M")
            orf = F.struct(
                (3 * (acc["at"] + m - 1) + f).cast("int").alias("orf_start"),
                F.substring(part, m, F.length(part)).alias("orf_protein"),
            )
            return F.struct(
                (acc["at"] + F.length(part) + 1).cast("int").alias("at"),
                F.when(m > 0, F.array_append(acc["orfs"], orf)).otherwise(acc["orfs"]).alias("orfs"),
            )

        parts = F.split(translate_cds(F.substring(q, F.lit(f), F.length(q))), "[*]")
        return F.aggregate(parts, state, take)["orfs"]

    found = F.concat(*[frame(f) for f in (1, 2, 3)])
    best = F.array_max(F.transform("_orfs", lambda o: F.length(o["orf_protein"])))
    return (
        unroll(df.withColumn("_orfs", found), "_orf", F.filter("_orfs", lambda o: F.length(o["orf_protein"]) == best))
        .select(*df.columns, "_orf.orf_start", "_orf.orf_protein")
    )


def snv_synonymy(df: DataFrame, position: str = "pos", alt: str = "alt", seq: str = "cds_seq") -> DataFrame:
    """Codon around a base, the codon with the base replaced, and whether the amino acid stays. ``alt`` is on the plus strand."""
    offset = m.cds_offset("exons", "strand", position).cast("int")
    base = F.when(F.col("strand") < 0, reverse_complement(alt)).otherwise(F.col(alt))
    inside = F.col("_o") >= 0
    lo = F.col("_o") - F.pmod(F.col("_o"), F.lit(3))
    codon = piece(seq, lo + 1, 3)
    step = F.pmod(F.col("_o"), F.lit(3))
    mutated = F.concat(piece(codon, 1, step), base, piece(codon, step + 2, 2 - step))
    out = df.withColumn("_o", offset).withColumns({"codon": F.when(inside, codon), "codon_mutated": F.when(inside, mutated)})
    return out.withColumn("synonymous", translate_cds("codon") == translate_cds("codon_mutated")).drop("_o")


def reference_base_check(
    df: DataFrame, genome: DataFrame, chunk: int = CHUNK, position: str = "pos", base: str = "ref", strand: str = "gene_strand"
) -> DataFrame:
    """``genome_base`` at a 1-based position and whether the stated base (on the given strand) equals it."""
    number = F.floor((F.col(position) - 1) / chunk)
    offset = F.col(position) - F.col("chunk") * chunk
    joined = df.withColumn("chunk", number).join(genome.select("chrom", "chunk", "seq"), ["chrom", "chunk"], "left")
    stated = F.when(F.col(strand) < 0, reverse_complement(base)).otherwise(F.col(base))
    return (
        joined.withColumn("genome_base", F.substring("seq", offset.cast("int"), F.lit(1)))
        .withColumn("base_matches", F.col("genome_base") == stated)
        .drop("chunk", "seq")
    )


def position_in_cds_exon_intron(df: DataFrame, position: str = "pos", only_containing: bool = False) -> DataFrame:
    """For a variant and each isoform: is the 1-based position coding, exonic, intronic?"""
    p = F.col(position)
    inside = lambda e: (e["start"] < p) & (p <= e["end"])
    out = df.withColumns(
        {
            "in_cds": F.exists(m.coding("exons"), inside), "in_exon": F.exists("exons", inside),
            "in_intron": F.exists(m.introns("exons", "strand"), inside),
        }
    )
    return out.where("in_exon or in_intron") if only_containing else out


def protein_divergence_start(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.withColumn("diverged", c.divergence(first, second))


def protein_reconvergence(df: DataFrame, original: str, altered: str) -> DataFrame:
    out = df.withColumn("_k", c.match_length(original, altered))
    return out.withColumn("reconverged", c.reconvergence(original, altered, "diverged", "_k")).drop("_k")


def altered_region(
    df: DataFrame, peptide: int = c.PEPTIDE, method: str = "protein", keep_proteins: bool = False
) -> DataFrame:
    """``region_orig`` and ``region_alt``: both sequences cut by the window around the difference.

    ``method='nucleotide'`` uses the older base-window comparison. ``keep_proteins`` keeps the proteins of both sequences as
    ``_po`` and ``_pa`` (only the protein method has them), from which the proteins of their parts can be cut.
    """
    if method == "nucleotide":
        out = df.withColumn("diverged", c.divergence("cds", "cds_alt"))
        out = out.withColumn("_first", c.first_window("cds", "cds_alt", "diverged", peptide))
        out = out.withColumn("_hi", c.next_equal_window("cds", "cds_alt", "_first", peptide))
        ok, third = F.col("_first") >= 0, F.pmod(F.col("_first") + 1, F.lit(3))
        out = out.withColumn("_lo", F.col("_first") + 1 - third)
    else:
        out = df.withColumns({"_po": translate_cds("cds"), "_pa": translate_cds("cds_alt")})
        out = out.withColumns({"diverged": c.divergence("_po", "_pa"), "_k": c.match_length("_po", "_pa")})
        out = out.withColumn("reconverged", c.reconvergence("_po", "_pa", "diverged", "_k"))
        stop = F.when(F.col("reconverged") == -1, F.length("_pa")).otherwise(F.col("reconverged"))
        lo, hi = c.altered_window("cds", "cds_alt", F.col("diverged"), stop, peptide)
        out = out.withColumns({"_lo": lo, "_hi": hi})
        ok = F.col("diverged") >= 0
    lo, hi = F.col("_lo"), F.col("_hi")
    return out.withColumns(
        {
            "region_start": F.when(ok, lo), "region_end": F.when(ok, hi),
            "region_orig": F.when(ok, cut("cds", lo, hi)).otherwise(""),
            "region_alt": F.when(ok, cut("cds_alt", lo, hi)).otherwise(""),
        }
    ).drop(*([] if keep_proteins else ["_po", "_pa"]), "_k", "_first", "_lo", "_hi")


def protein_part(protein, first: Column, bases: Column) -> Column:
    """Protein of ``bases`` bases from the 0-based base ``first`` (a codon's first) of the sequence ``protein`` is of."""
    return piece(protein, (F.floor(first / 3) + 1).cast("int"), F.floor(bases / 3).cast("int"))


def comparative_neoepitopes(df: DataFrame) -> DataFrame:
    """Four proteins of the two regions: full, and up to the first stop of the altered one.

    Proteins kept by ``altered_region`` are cut, as its regions begin with a codon; else the regions are translated.
    """
    both = (F.length("region_orig") > 0) & (F.length("region_alt") > 0)

    def protein(whole, region):
        if whole in df.columns:
            return protein_part(whole, F.col("region_start"), F.length(region))
        return translate_cds(region)

    out = df.withColumns(
        {
            "AA_orig_full": F.when(both, protein("_po", "region_orig")).otherwise(""),
            "AA_alt_full": F.when(both, protein("_pa", "region_alt")).otherwise(""),
        }
    ).withColumn("AA_alt_STOP", F.substring_index("AA_alt_full", "*", 1))
    return out.withColumn("AA_orig_STOP", piece("AA_orig_full", 1, F.length("AA_alt_STOP")))


def possible_neoepitope_count(df: DataFrame, peptide: int = c.PEPTIDE) -> DataFrame:
    """Windows per side and whether the counts match; 0, 0 and ``-`` without a difference."""
    empty = F.length("AA_orig_STOP") == 0
    n_orig = F.length("AA_orig_STOP") - (peptide - 1)
    n_alt = F.length("AA_alt_STOP") - (peptide - 1)
    same = F.when(n_orig == n_alt, "True").otherwise("False")
    return df.withColumns(
        {
            "possible_neoep_orig": F.when(empty, 0).otherwise(n_orig), "possible_neoep_alt": F.when(empty, 0).otherwise(n_alt),
            "match_possible_neoep": F.when(empty, "-").otherwise(same),
        }
    )


def peptide_windows(
    df: DataFrame, altered: str = "AA_alt_STOP", original: str = "AA_orig_STOP", size: int = c.PEPTIDE,
    cds_first: str | None = None,
) -> DataFrame:
    """One row per window of the altered protein with the original at the same place.

    ``cds_first`` names a column with the coding offset of the first residue; with a gene model in the row
    each window then gets its genome range.
    """
    last = F.length(altered) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    out = unroll(df, "window_start", starts).withColumns(
        {
            "window_frame": F.concat(
                F.col("window_start").cast("string"), F.lit(":"), (F.col("window_start") + size).cast("string")
            ),
            "peptide_alt": piece(altered, F.col("window_start") + 1, size),
            "peptide_orig": piece(original, F.col("window_start") + 1, size),
        }
    )
    if cds_first:
        out = out.withColumn("_lo", (F.col(cds_first) + F.col("window_start") * 3).cast("bigint"))
        out = out.withColumn("_hi", F.col("_lo") + 3 * size - 1)
        out = out.withColumns({f"_g{x}": m.genome_position("exons", "strand", x) for x in ("_lo", "_hi")})
        out = out.withColumn("window_range", genome_range(F.col("_g_lo"), F.col("_g_hi"))).drop("_lo", "_hi", "_g_lo", "_g_hi")
    return out


def genome_range(a: Column, b: Column) -> Column:
    return F.concat(
        F.col("chrom"), F.lit(":"), F.least(a, b).cast("string"), F.lit("-"), F.greatest(a, b).cast("string")
    )


def flanked_peptide(df: DataFrame, change: str, before: str, after: str, radius: int) -> DataFrame:
    """Last ``radius`` residues before, the changed residue, first ``radius`` after; cut at the first stop."""
    parts = F.split(F.col(change), "/")

    def side(i):
        residue = F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        residue = F.when(residue.contains("-"), "").otherwise(F.regexp_replace(residue, "X", ""))
        head = F.substring(F.col(before), F.length(before) - radius + 1, F.lit(radius))
        text = F.concat(head, residue, piece(after, 1, radius))
        long_enough = (F.length(before) >= radius) & (F.length(after) >= radius)
        return F.when(long_enough, F.substring_index(text, "*", 1))

    return df.withColumns({"neoep_orig": side(0), "neoep_alt": side(1)})


def truncation_boundary(df: DataFrame, distance: int = c.NMD_DISTANCE) -> DataFrame:
    """3' end of the penultimate coding segment and the boundary ``distance`` bases upstream of it."""
    parts = m.coding("exons")
    n = F.size(parts)
    last = F.when(F.col("strand") > 0, F.get(parts, n - 1)).otherwise(F.get(parts, F.lit(0)))
    penultimate = F.when(n >= 2, m.cds_length("exons") - (last["end"] - last["start"]) - 1)
    boundary = F.when(penultimate < distance, -1).otherwise(penultimate - distance)
    out = df.withColumns({"relative_penultimate": penultimate, "relative_boundary": boundary})
    return out.withColumns(
        {
            "genome_penultimate": m.genome_position("exons", "strand", "relative_penultimate"),
            "genome_boundary": F.when(F.col("relative_boundary") == -1, -1).otherwise(
                m.genome_position("exons", "strand", "relative_boundary")
            ),
        }
    )


def nmd_susceptible(df: DataFrame, boundary: str = "boundary") -> DataFrame:
    return df.withColumn("bool_NMD", c.nmd_susceptible("cds_alt", "cds_start", boundary))


def nsd_susceptible(df: DataFrame, boundary: str = "boundary") -> DataFrame:
    return df.withColumn("bool_NSD", c.nsd_susceptible("cds_alt", "cds_start", boundary))


def alt_near_last_junction(df: DataFrame, boundary: str = "boundary", junction: str = "penultimate_end") -> DataFrame:
    return df.withColumn("alt_btwn_tp_penulti", c.near_last_junction("cds_start", "cds_end", boundary, junction))


def stretch(df: DataFrame, prefix: str, lo: Column, hi: Column, seq: str = "cds_seq") -> DataFrame:
    """Genome range, bases and protein of the closed coding offsets lo..hi; null when a bound is null."""
    df = df.withColumns({"_lo": lo, "_hi": hi})
    lo, hi = F.col("_lo"), F.col("_hi")
    a, b = (m.genome_position("exons", "strand", x) for x in ("_lo", "_hi"))
    df = df.withColumns({"_a": a, "_b": b})
    a, b = F.col("_a"), F.col("_b")
    bases = F.when(lo.isNotNull() & hi.isNotNull(), piece(seq, (lo + 1).cast("int"), (hi - lo + 1).cast("int")))
    out = df.withColumns({f"{prefix}_range": genome_range(a, b), f"{prefix}_nuc": bases})
    return out.withColumn(f"{prefix}_aa", translate_cds(f"{prefix}_nuc")).drop("_lo", "_hi", "_a", "_b")


def nmd_regions(df: DataFrame, position: str = "pos", seq: str = "cds_seq") -> DataFrame:
    """NMD-sensitive stretch (variant codon to boundary codon) and NMD-irrelevant stretch (later of the two to the end)."""
    out = truncation_boundary(df).withColumn("_o", m.cds_offset("exons", "strand", position))
    o, b = F.col("_o"), F.col("relative_boundary")
    third = F.lit(3)
    known = (o >= 0) & (b >= 0)
    codon_of = lambda x: x - F.pmod(x, third)
    sensitive = known & (o < b)
    out = stretch(out, "sensitive", F.when(sensitive, codon_of(o)), F.when(sensitive, codon_of(b) + 2), seq)
    later = F.when(o > b, codon_of(o)).otherwise(codon_of(b) + 3)
    out = stretch(out, "irrelevant", F.when(known, later), F.when(known, F.length(seq).cast("bigint") - 1), seq)
    return out.withColumns(
        {
            "sensitive_stop": F.contains("sensitive_aa", F.lit("*")), "irrelevant_stop": F.contains("irrelevant_aa", F.lit("*")),
        }
    ).drop("_o")


def flanking_sequence(
    df: DataFrame, codons: int, before: bool = True, whole: bool = True, nearest: int = 0, position: str = "pos",
    seq: str = "cds_seq",
) -> DataFrame:
    """Range, bases and protein of some codons before or after a genome position.

    A negative count runs to the transcript end. ``nearest`` -1 or 1 moves a position outside the coding
    sequence to the next lower or higher coding base; 0 gives null there.
    """
    p, parts = F.col(position), m.coding("exons")
    lower = F.array_max(F.transform(F.filter(parts, lambda e: e["start"] < p), lambda e: F.least(e["end"], p)))
    higher = F.array_min(F.transform(F.filter(parts, lambda e: e["end"] >= p), lambda e: F.greatest(e["start"] + 1, p)))
    moved = {0: p, -1: lower, 1: higher}[nearest]
    out = df.withColumn("_o", m.cds_offset("exons", "strand", moved))
    o, n = F.col("_o"), F.length(seq).cast("bigint")
    zero = F.lit(0).cast("bigint")
    if before:
        lo, hi = (o - 3 * codons if codons >= 0 else zero), o
    else:
        lo, hi = o, (o + 3 * codons if codons >= 0 else n - 1)
    if whole:
        lo, hi = lo - F.pmod(lo, F.lit(3)), hi - F.pmod(hi, F.lit(3)) + 2
    ok = (o >= 0) & (lo >= 0) & (hi < n)
    return stretch(out, "flank", F.when(ok, lo), F.when(ok, hi), seq).drop("_o")


def inframe_frameshift_sequences(df: DataFrame, codons: int = 3) -> DataFrame:
    """In-frame: mutated codon and some codons after it; frameshift: mutated codon to the end. Original and altered."""
    shift = F.length("cds_alt") - F.length("cds")
    frameshift = F.pmod(shift, F.lit(3)) != 0
    lo, hi = codon_start("cds_start"), codon_end("cds_end") + 3 * codons
    ok = c.usable("cds", "cds_start", "cds_end")
    hi_orig = F.when(frameshift, F.length("cds")).otherwise(hi + 1)
    hi_alt = F.when(frameshift, F.length("cds_alt")).otherwise(hi + 1 + shift)
    out = df.withColumns(
        {
            "frameshift": F.when(ok, frameshift),
            "nuc_region_orig": F.when(ok, cut("cds", lo, hi_orig)), "nuc_region_alt": F.when(ok, cut("cds_alt", lo, hi_alt)),
        }
    )
    return out.withColumns({"aa_region_orig": translate_cds("nuc_region_orig"), "aa_region_alt": translate_cds("nuc_region_alt")})


OUTPUT_COLUMNS = (
    "row case_id chrom start_pos end_pos Hugo_Symbol Variant_Classification Variant_Type file_hgvsc file_hgvsp "
    "file_short_hgvsp file_codon file_amino_acid file_protein_mrna_pos gene_symbol isoform_id gene_strand "
    "express_count express_percentile allele_string nuc_orig nuc_alt codon_change in_frame variant_class "
    "my_change_type alt_genome_range cds_start cds_end alt_consequence bool_alteration my_HGVSc my_HGVSp aa_change "
    "aa_start aa_end codon_orig_alt aa_orig_alt myVEP_codon_orig_alt myVEP_aa_orig_alt mRNA_orig mRNA_alt "
    "AA_orig_full AA_alt_full AA_orig_STOP AA_alt_STOP possible_neoep_orig possible_neoep_alt match_possible_neoep "
    "compare_aa match_aa compare_codon match_codon compare_geneID match_geneID compare_transcriptID "
    "match_transcriptID exon_with_alt_start exon_with_alt_end penultimate_exon alt_btwn_tp_penulti bool_NMD bool_NSD"
).split()


def variant_transcript_table(
    variants: DataFrame, effects: DataFrame, transcripts: DataFrame, expression: DataFrame | None = None,
    named_isoform_only: bool = False,
) -> DataFrame:
    """Variant x isoform rows with sequences, altered proteins and decay calls: the 63 output columns.

    ``variants`` are input rows with a ``row`` id, ``effects`` their consequences per transcript (same
    ``row``), ``transcripts`` gene models with ``cds_seq``.
    """
    from .variants import alteration_type, changes_protein, filter_chromosome

    given = ("Transcript_ID", "HGVSc", "HGVSp", "Codons", "Amino_acids")
    kept = filter_chromosome(variants).withColumnsRenamed({n: f"{n}_given" for n in given})
    tx = transcripts.select(
        F.col("isoform").alias("transcript_id"), F.col("strand").alias("gene_strand"), "strand", "exons",
        F.col("cds_seq").alias("cds"),
    )
    df = kept.join(effects, "row").join(tx, "transcript_id")
    if named_isoform_only:
        df = df.where((F.col("Transcript_ID_given") == "-") | (F.col("Transcript_ID_given") == F.col("transcript_id")))
    df = allele_on_gene_strand(alteration_type(df.withColumn("variant_strand", F.lit(1))))
    df = df.withColumns(
        {
            "bool_alteration": changes_protein("amino_acids"), "alt": F.col("nuc_alt"),
            "change_type": F.when(F.length("nuc_orig") == 0, 1).when(F.length("nuc_alt") == 0, 2).otherwise(0),
        }
    )
    df = apply_alteration(df, F.col("bool_alteration"))
    df = changed_amino_acid(changed_codon(df))
    df = possible_neoepitope_count(comparative_neoepitopes(altered_region(df, keep_proteins=True)))
    df = truncation_boundary(df)
    df = alt_near_last_junction(nsd_susceptible(nmd_susceptible(df, "relative_boundary"), "relative_boundary"),
                                "relative_boundary", "relative_penultimate")
    if expression is None:
        df = df.withColumns({"express_count": F.lit(0.0), "express_percentile": F.lit(0.0)})
    else:
        table = expression.select("gene_symbol", "case_id", F.col("express").alias("express_count"), F.col("percentile").alias("express_percentile"))
        df = df.join(table, ["gene_symbol", "case_id"], "left").na.fill(0.0, ["express_count", "express_percentile"])
    slash = lambda a, b: F.concat_ws("/", F.coalesce(a, F.lit("None")), F.coalesce(b, F.lit("None")))
    pair = lambda a, b: F.concat_ws(" | ", F.coalesce(a, F.lit("nan")), F.coalesce(b, F.lit("nan")))
    df = df.withColumns(
        {
            "codon_orig_alt": slash("codon_orig", "codon_alt"), "aa_orig_alt": slash("aa_orig", "aa_alt"),
            "myVEP_codon_orig_alt": slash("codon_orig_marked", "codon_alt_marked"),
            "myVEP_aa_orig_alt": slash("aa_orig_marked", "aa_alt_marked"),
        }
    )

    def checked(computed, given, blank):
        missing = F.col(given).isNull() | F.contains(computed, F.lit("None"))
        return F.when(missing, blank).otherwise(F.when(F.col(computed) == F.col(given), "True").otherwise("False"))

    text = lambda b: F.when(b, "True").when(~b, "False").otherwise("None")
    penultimate = F.transform(m.coding("exons"), lambda e: e["num"])
    last_num = F.array_max(penultimate)
    values = {
        "chrom": F.col("Chromosome"), "start_pos": F.col("Start_Position"), "end_pos": F.col("End_Position"),
        "file_hgvsc": F.col("HGVSc_given"), "file_hgvsp": F.col("HGVSp_given"), "file_short_hgvsp": F.col("HGVSp_Short"),
        "file_codon": F.col("Codons_given"), "file_amino_acid": F.col("Amino_acids_given"),
        "file_protein_mrna_pos": F.col("Protein_position"), "isoform_id": F.col("transcript_id"),
        "codon_change": F.col("codons"), "alt_genome_range": F.concat(
            F.col("Chromosome"), F.lit(":"), F.col("Start_Position").cast("string"), F.lit("-"), F.col("End_Position").cast("string")),
        "alt_consequence": F.col("most_severe_consequence"), "my_HGVSc": F.col("hgvsc"), "my_HGVSp": F.col("hgvsp"),
        "aa_change": F.col("amino_acids"), "aa_start": F.col("protein_start"), "aa_end": F.col("protein_end"),
        "mRNA_orig": F.col("cds"), "mRNA_alt": F.col("cds_alt"),
        "compare_aa": pair("myVEP_aa_orig_alt", "Amino_acids_given"), "match_aa": checked("myVEP_aa_orig_alt", "Amino_acids_given", "-aa_empty-"),
        "compare_codon": pair("myVEP_codon_orig_alt", "Codons_given"), "match_codon": checked("myVEP_codon_orig_alt", "Codons_given", "-codon_empty-"),
        "compare_geneID": pair("gene_symbol", "Hugo_Symbol"), "match_geneID": text(F.col("gene_symbol") == F.col("Hugo_Symbol")),
        "compare_transcriptID": pair("transcript_id", "Transcript_ID_given"), "match_transcriptID": text(F.col("transcript_id") == F.col("Transcript_ID_given")),
        "exon_with_alt_start": feature_number(m.coding("exons"), "Start_Position"),
        "exon_with_alt_end": feature_number(m.coding("exons"), "End_Position"),
        "penultimate_exon": F.when(F.size(penultimate) >= 2, last_num - 1).otherwise(-1),
    }
    return df.select(*[values.get(n, F.col(n)).alias(n) for n in OUTPUT_COLUMNS])
