"""Gene models: transcripts as rows with an exon array, their elements, and lookups by position, id or gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as m
from ..functions.sequence import col
from ..plans.intervals import GENE_BIN, overlap_join
from ..plans.rows import unroll

TRANSCRIPT_KEY = ["isoform", "chrom", "tx_start"]


def pack_transcripts(features: DataFrame) -> DataFrame:
    """Exon rows to transcript rows. A transcript gathers its own exons only."""
    exon = F.struct(
        F.col("start_pos").cast("bigint").alias("start"), F.col("end_pos").cast("bigint").alias("end"),
        F.col("cds_start").cast("bigint").alias("cds_start"), F.col("cds_end").cast("bigint").alias("cds_end"),
        F.lit(None).cast("int").alias("num"), F.lit(None).cast("int").alias("frame"),
        F.lit(None).cast("bigint").alias("offset"),
    )
    packed = features.groupBy("gene", "isoform", "chrom", "strand", "db").agg(
        F.array_sort(F.collect_list(exon)).alias("exons")
    )
    return number_exons(packed)


def number_exons(df: DataFrame) -> DataFrame:
    """Fill exon numbers (from the 5' end) and frames, and add the transcript span."""
    strand, n = F.col("strand"), F.size("exons")

    def finished(e, i):
        frame = F.when(e["cds_start"].isNull(), -1).otherwise(F.pmod(e["offset"], F.lit(3)))
        num = F.when(strand > 0, i + 1).otherwise(n - i)
        return e.withField("num", num.cast("int")).withField("frame", frame.cast("int"))

    def placed(e):
        first = F.when(strand > 0, e["cds_start"] + 1).otherwise(e["cds_end"])
        before = m.bases_before(F.col("_parts"), strand, first)
        return e.withField("offset", F.when(e["cds_start"].isNotNull(), before))

    spans = F.transform(
        F.filter("exons", lambda e: e["cds_start"].isNotNull()),
        lambda e: F.struct(e["cds_start"].alias("start"), e["cds_end"].alias("end")),
    )
    return (
        df.withColumn("_parts", spans)
        .withColumn("exons", F.transform("exons", placed))
        .withColumn("exons", F.transform("exons", finished))
        .withColumns({"tx_start": F.get("exons", F.lit(0))["start"], "tx_end": F.element_at("exons", -1)["end"]})
        .drop("_parts")
    )


def exon_intron_features(transcripts: DataFrame) -> DataFrame:
    """One row per exon and intron; numbers count from the 5' end."""

    def tagged(elements: Column, kind: str, frame):
        return F.transform(
            elements,
            lambda e: F.struct(
                F.lit(kind).alias("feat_type"), e["num"].alias("feat_num"), e["start"].alias("start_pos"),
                e["end"].alias("end_pos"), frame(e).cast("int").alias("frame"),
            ),
        )

    rows = F.concat(
        tagged(F.col("exons"), "exon", lambda e: e["frame"]),
        tagged(m.introns("exons", "strand"), "intron", lambda e: F.lit(None)),
    )
    return unroll(transcripts, "f", rows).select("gene", "isoform", "chrom", "strand", "db", "f.*")


def cds_segments(transcripts: DataFrame) -> DataFrame:
    """Coding part of each exon, with 0-based and 1-based starts."""
    return unroll(transcripts, "e", "exons").where("e.cds_start is not null").select(
        "gene", "isoform", "chrom", "strand", F.col("e.num").alias("feat_num"), F.col("e.start").alias("exon_start"),
        F.col("e.end").alias("exon_end"), F.col("e.cds_start").alias("cds_start"),
        (F.col("e.cds_start") + 1).alias("cds_start_1"), F.col("e.cds_end").alias("cds_end"),
    )


def coding_boundaries(transcripts: DataFrame) -> DataFrame:
    """Coding span, start codon, transcription start and untranslated spans; null for non-coding transcripts."""
    starts = F.array_min(F.transform(m.coding("exons"), lambda e: e["start"]))
    ends = F.array_max(F.transform(m.coding("exons"), lambda e: e["end"]))
    plus = F.col("strand") > 0
    return transcripts.withColumns({"coding_start": starts, "coding_end": ends}).withColumns(
        {
            "start_codon": F.when(plus, F.col("coding_start")).otherwise(F.col("coding_end")),
            "tss": F.when(plus, F.col("tx_start")).otherwise(F.col("tx_end")),
            "utr_left": F.col("coding_start") - F.col("tx_start"),
            "utr_right": F.col("tx_end") - F.col("coding_end"),
        }
    )


def isoforms_by_position(points: DataFrame, transcripts: DataFrame, span=("start_pos", "end_pos"), width: int = GENE_BIN) -> DataFrame:
    """Every isoform of every gene with an isoform over the span, per annotation source."""
    spans = transcripts.select("chrom", "gene", "db", "tx_start", "tx_end")
    keep = points.columns
    genes = overlap_join(points, spans, span, ("tx_start", "tx_end"), width=width).select(*keep, "gene", "db").distinct()
    return genes.join(transcripts.drop("chrom"), ["gene", "db"])


def isoforms_by_id(wanted: DataFrame, transcripts: DataFrame, first: bool = False) -> DataFrame:
    """Transcripts by isoform id; ``first`` keeps the placement with the lowest (chrom, tx_start)."""
    if first:
        row = F.min_by(F.struct(*transcripts.columns), F.struct("chrom", "tx_start", "tx_end"))
        transcripts = transcripts.groupBy("isoform").agg(row.alias("_row")).select("_row.*")
    return wanted.join(transcripts, "isoform")


def isoforms_by_gene(wanted: DataFrame, transcripts: DataFrame) -> DataFrame:
    return wanted.join(transcripts, "gene")


def closest_isoform_variant(points: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """Placement of the isoform that spans the position with the nearest exon edge, else its first placement.

    ``points`` has ``key``, isoform, chrom and pos; an ``_alt`` suffix of the id is ignored.
    """
    asked = points.withColumn("isoform", F.regexp_replace("isoform", "_alt.*$", ""))
    edges = F.flatten(F.transform("exons", lambda e: F.array(e["start"], e["end"])))
    placed = transcripts.select("isoform", F.col("chrom").alias("tx_chrom"), "tx_start", "tx_end", "exons")
    joined = asked.join(placed, "isoform")
    spans = (F.col("tx_chrom") == F.col("chrom")) & F.col("pos").between(F.col("tx_start"), F.col("tx_end"))
    distance = F.array_min(F.transform(edges, lambda x: F.abs(x - F.col("pos"))))
    order = F.struct(F.when(spans, 0).otherwise(1), F.when(spans, distance), "tx_chrom", "tx_start")
    kept = F.struct("isoform", "chrom", "pos", "tx_chrom", "tx_start", "tx_end", F.when(spans, distance).alias("distance"))
    return joined.groupBy(key).agg(F.min_by(kept, order).alias("_row")).select(key, "_row.*")


def map_gene_ids(wanted: DataFrame, refseq_ucsc: DataFrame, ucsc_transcript: DataFrame, transcript_gene: DataFrame) -> DataFrame:
    """RefSeq id to UCSC name, transcript and gene, first match at each step, and all isoforms of that gene."""

    def first(df, key, value):
        return df.groupBy(key).agg(F.min(value).alias(value))

    gene = (
        wanted.join(first(refseq_ucsc, "refseq", "ucsc"), "refseq")
        .join(first(ucsc_transcript, "ucsc", "transcript"), "ucsc")
        .join(first(transcript_gene, "transcript", "ens_gene"), "transcript")
    )
    isoforms = transcript_gene.select("ens_gene", F.col("transcript").alias("isoform"))
    return gene.join(isoforms, "ens_gene")


def gene_range(transcripts: DataFrame, by: str = "gene") -> DataFrame:
    return transcripts.groupBy(by, "chrom").agg(F.min("tx_start").alias("start_pos"), F.max("tx_end").alias("end_pos"))


def gene_mode_strand_symbol(transcripts: DataFrame, by: str = "locus", symbol: str = "gene") -> DataFrame:
    """Most frequent strand (5 if there is none) and symbol of a set of isoforms; ties go to the smaller value."""
    votes = transcripts.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    strand = transcripts.where("strand is not null").groupBy(by, "strand").count()
    name = transcripts.where(F.col(symbol).isNotNull()).groupBy(by, symbol).count()
    top_strand = strand.groupBy(by).agg(F.min_by("strand", F.struct(-F.col("count"), "strand")).alias("mode_strand"))
    top_name = name.groupBy(by).agg(F.min_by(symbol, F.struct(-F.col("count"), symbol)).alias("mode_symbol"))
    return (
        votes.drop("_n").join(top_strand, by, "left").join(top_name, by, "left")
        .withColumn("mode_strand", F.coalesce("mode_strand", F.lit(5)))
    )


def element_prevalence(features: DataFrame) -> DataFrame:
    """Isoforms that carry each distinct exon or intron of a gene."""
    return features.groupBy("gene", "feat_type", "chrom", "start_pos", "end_pos").agg(
        F.count_distinct("isoform").alias("isoforms")
    )


def constitutive_alternative(features: DataFrame) -> DataFrame:
    """Elements present in all isoforms of the gene, or in fewer."""
    totals = features.groupBy("gene").agg(F.count_distinct("isoform").alias("gene_isoforms"))
    kind = F.when(F.col("isoforms") >= F.col("gene_isoforms"), "constitutive").otherwise("alternative")
    return element_prevalence(features).join(totals, "gene").withColumn("kind", kind)


def overlapping_elements(
    ranges: DataFrame, features: DataFrame, key: str, feat_type: str = "exon", local: bool = True
) -> DataFrame:
    """Distinct elements of the gene that overlap a half-open range.

    ``local=False`` first takes the longest hit and returns everything that overlaps it.
    """
    elements = features.where(F.col("feat_type") == feat_type).select(
        "gene", F.col("start_pos").alias("elem_start"), F.col("end_pos").alias("elem_end")
    ).distinct()
    hits = ranges.join(elements, "gene").where(
        (F.col("start_pos") < F.col("elem_end")) & (F.col("elem_start") < F.col("end_pos"))
    )
    if local:
        return hits.select(key, "gene", "elem_start", "elem_end")
    longest = hits.groupBy(key, "gene").agg(
        F.max_by(
            F.struct("elem_start", "elem_end"),
            F.struct(F.col("elem_end") - F.col("elem_start"), -F.col("elem_start")),
        ).alias("_x")
    ).select(key, "gene", F.col("_x.elem_start").alias("start_pos"), F.col("_x.elem_end").alias("end_pos"))
    return overlapping_elements(longest, features, key, feat_type)


def longest_isoform(transcripts: DataFrame) -> DataFrame:
    """Isoforms with the most exons of their gene."""
    counted = transcripts.withColumn("exon_count", F.size("exons"))
    best = counted.groupBy("gene").agg(F.max("exon_count").alias("exon_count"))
    return counted.join(best, ["gene", "exon_count"])


def elements_of(kind: str) -> Column:
    return {"exon": F.col("exons"), "cds": m.coding("exons"), "intron": m.introns("exons", "strand")}[kind]


def containing_element(
    df: DataFrame, kind: str = "exon", position: str = "pos", direction: int = 0, by_strand: bool = True,
    rel_pos: str | None = None, name: str = "element",
) -> DataFrame:
    """Struct column with the exon, coding part or intron at a position of rows that carry a gene model.

    When two elements touch at the position, the direction (times the strand) picks one.
    """
    d = F.lit(direction) * F.col("strand") if by_strand else F.lit(direction)
    return df.withColumn(name, m.choose(m.holding(elements_of(kind), position, rel_pos), d))


def element_label(position: str = "pos", canonical: bool = False) -> Column:
    """``exon: withinElem`` or ``intron: exonLeft``; null outside the transcript."""

    def text(kind):
        e = m.choose(m.holding(elements_of(kind), position), 0)
        return F.concat(F.lit(f"{kind}: "), m.place(position, e["start"], e["end"]))

    return F.coalesce(text("exon"), text("intron"))


def closest_element(df: DataFrame, kind: str = "exon", position: str = "pos", side: int = 0, name: str = "element") -> DataFrame:
    """Nearest element ending left (-1), starting right (1) or on either side (0); the first element if none."""
    p = F.col(position)
    elements = elements_of(kind)
    fits = {
        -1: lambda e: e["end"] <= p, 1: lambda e: e["start"] >= p, 0: lambda e: F.lit(True),
    }[side]
    gap = {
        -1: lambda e: p - e["end"], 1: lambda e: e["start"] - p,
        0: lambda e: F.least(F.abs(e["start"] - p), F.abs(e["end"] - p)),
    }[side]
    scored = F.transform(F.filter(elements, fits), lambda e: F.struct(gap(e).alias("gap"), e["start"].alias("s"), e.alias("e")))
    return df.withColumn(name, F.coalesce(F.array_min(scored)["e"], F.get(elements, F.lit(0))))


def adjacent_splice_sites(df: DataFrame, position: str = "pos") -> DataFrame:
    """Introns left and right of the exon at a position, or the containing intron twice."""
    exon = m.choose(m.holding("exons", position), 0)
    gaps = m.introns("exons", "strand")
    inside = m.choose(m.holding(gaps, position), 0)
    left = F.get(F.filter(gaps, lambda g: g["end"] == exon["start"]), F.lit(0))
    right = F.get(F.filter(gaps, lambda g: g["start"] == exon["end"]), F.lit(0))
    out = df.withColumns(
        {
            "intron_left": F.when(exon.isNotNull(), left).otherwise(inside),
            "intron_right": F.when(exon.isNotNull(), right).otherwise(inside),
        }
    )
    plus = F.col("strand") > 0
    upstream = F.when(plus, F.col("intron_left")).otherwise(F.col("intron_right"))
    downstream = F.when(plus, F.col("intron_right")).otherwise(F.col("intron_left"))
    return out.withColumns(
        {
            "acceptor": F.when(plus, upstream["end"]).otherwise(upstream["start"]),
            "donor": F.when(plus, downstream["start"]).otherwise(downstream["end"]),
        }
    )


def donor_acceptor_sites(transcripts: DataFrame) -> DataFrame:
    """Every intron as a donor and acceptor pair."""
    plus = F.col("strand") > 0
    return unroll(transcripts, "i", m.introns("exons", "strand")).select(
        "gene", "isoform", "chrom", "strand", "db", F.col("i.num").alias("feat_num"), F.col("i.start").alias("start_pos"),
        F.col("i.end").alias("end_pos"), F.when(plus, F.col("i.start")).otherwise(F.col("i.end")).alias("donor"),
        F.when(plus, F.col("i.end")).otherwise(F.col("i.start")).alias("acceptor"),
    )


def attach_models(df: DataFrame, transcripts: DataFrame, on: list[str] | str = "isoform") -> DataFrame:
    """Rows joined to the gene models they name; the exon arrays come along for row-local arithmetic."""
    keys = [on] if isinstance(on, str) else on
    extra = [c for c in transcripts.columns if c not in df.columns or c in keys]
    return df.join(transcripts.select(*extra), keys)


