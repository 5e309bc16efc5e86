"""Read evidence from alignments: sample, chrom, pos (1-based), cigar, mapq, nh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.intervals import EXON_BIN, overlap_join
from ..plans.rows import unroll
from .genemodels import longest_isoform

UNIQUE_MAPQ = 50  # fixed value: mapping quality of a unique hit


def aligned_parts(reads: DataFrame) -> DataFrame:
    """Add ``ref_start`` (0-based), ``ref_end``, ``gaps`` (skipped spans) and ``blocks`` (aligned spans)."""
    span = "array<struct<start:bigint,end:bigint>>"
    empty = F.array().cast(span)
    ops = F.regexp_extract_all("cigar", F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    zero = F.struct((F.col("pos") - 1).cast("bigint").alias("at"), empty.alias("gaps"), empty.alias("blocks"))

    def step(acc, op):
        kind = F.substring(op, -1, 1)
        size = F.regexp_extract(op, r"^\d+", 0).cast("bigint")
        end = acc["at"] + size
        piece = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(
            F.when(kind.isin("M", "D", "N", "=", "X"), end).otherwise(acc["at"]).alias("at"),
            F.when(kind == "N", F.concat(acc["gaps"], piece)).otherwise(acc["gaps"]).alias("gaps"),
            F.when(kind.isin("M", "=", "X"), F.concat(acc["blocks"], piece)).otherwise(acc["blocks"]).alias("blocks"),
        )

    return reads.withColumn("_p", F.aggregate(ops, zero, step)).withColumns(
        {"ref_start": F.col("pos") - 1, "ref_end": F.col("_p.at"), "gaps": F.col("_p.gaps"), "blocks": F.col("_p.blocks")}
    ).drop("_p")


def gap_counts(reads: DataFrame) -> DataFrame:
    """Reads per sample and gap: all, NH = 1, top quality, distinct placements."""
    gaps = unroll(aligned_parts(reads), "g", "gaps")
    return gaps.groupBy(
        "sample", "chrom", F.col("g.start").alias("start_pos"), F.col("g.end").alias("end_pos")
    ).agg(
        F.count(F.lit(1)).alias("all_count"), F.count_if(F.col("nh") == 1).alias("unique_count"),
        F.count_if(F.col("mapq") == UNIQUE_MAPQ).alias("unique_count_50"),
        F.count_distinct("pos", "cigar").alias("distinct_reads"),
    )


def junction_read_support(junctions: DataFrame, reads: DataFrame) -> DataFrame:
    """Support of each junction (sample, chrom, start_pos, end_pos); 0 when no read has the gap."""
    counts = ["all_count", "unique_count", "unique_count_50", "distinct_reads"]
    return junctions.join(gap_counts(reads), ["sample", "chrom", "start_pos", "end_pos"], "left").na.fill(0, counts)


def junction_block_support(junctions: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads with a block edge at both junction ends. Equal placements are counted once before the join."""
    edges = F.flatten(F.transform("blocks", lambda b: F.array(b["start"], b["end"])))
    shapes = aligned_parts(reads).withColumn("edges", edges).groupBy("sample", "chrom", "edges").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("mapq") == UNIQUE_MAPQ).alias("_top")
    )
    at_start = unroll(shapes, "start_pos", F.array_distinct("edges"))
    places = junctions.select("sample", "chrom", "start_pos", "end_pos").distinct()
    support = (
        places.join(at_start, ["sample", "chrom", "start_pos"])
        .where(F.array_contains("edges", F.col("end_pos")))
        .groupBy("sample", "chrom", "start_pos", "end_pos")
        .agg(F.sum("_all").alias("all_count"), F.sum("_top").alias("unique_count"))
    )
    joined = junctions.join(support, ["sample", "chrom", "start_pos", "end_pos"], "left")
    return joined.na.fill(0, ["all_count", "unique_count"])


def region_read_counts(regions: DataFrame, reads: DataFrame, key: str, width: int = EXON_BIN) -> DataFrame:
    """Reads per region and sample: all, unique, multiple, top quality. Equal placements are counted before the join."""
    spans = aligned_parts(reads).groupBy("sample", "chrom", "ref_start", "ref_end").agg(
        F.count(F.lit(1)).alias("_a"), F.count_if(F.col("nh") == 1).alias("_u"),
        F.count_if(F.col("nh") > 1).alias("_m"), F.count_if(F.col("mapq") == UNIQUE_MAPQ).alias("_t"),
    )
    hits = overlap_join(
        regions.select(key, "chrom", "region_start", "region_end"), spans, ("region_start", "region_end"),
        ("ref_start", "ref_end"), width=width,
    )
    return hits.groupBy(key, "sample").agg(
        F.sum("_a").alias("all_reads"), F.sum("_u").alias("unique_reads"), F.sum("_m").alias("multi_reads"),
        F.sum("_t").alias("top_quality_reads"),
    )


def region_pair_counts(regions: DataFrame, reads: DataFrame, key: str, pair: str = "mate", width: int = EXON_BIN) -> DataFrame:
    """Read pairs with both mates over the region."""
    spans = aligned_parts(reads).select("sample", "chrom", pair, "ref_start", "ref_end")
    hits = overlap_join(
        regions.select(key, "chrom", "region_start", "region_end"), spans, ("region_start", "region_end"),
        ("ref_start", "ref_end"), width=width,
    )
    mates = hits.groupBy(key, "sample", pair).agg(F.count(F.lit(1)).alias("n"))
    return mates.groupBy(key, "sample").agg(F.count_if(F.col("n") >= 2).alias("pairs"))


def library_size(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("chrom").startswith("chr")).groupBy("sample").agg(F.count(F.lit(1)).alias("library"))


def density(reads, library, length):
    """1e9 * reads / (library * length); null when either is 0."""
    return F.try_divide(F.lit(1e9) * reads, library * length)


def read_density(regions: DataFrame, reads: DataFrame, by: list[str], key: str = "region_id", counted: str = "unique_reads") -> DataFrame:
    """Density over the regions of each group ``by`` (an exon, an isoform, an exon list): sums, then one formula."""
    counts = region_read_counts(regions, reads, key)
    lengths = regions.groupBy(*by).agg(F.sum(F.col("region_end") - F.col("region_start")).alias("length"))
    totals = counts.join(regions.select(key, *[b for b in by if b != key]), key).groupBy(*by, "sample").agg(F.sum(counted).alias("reads"))
    return (
        totals.join(lengths, by)
        .join(library_size(reads), "sample")
        .withColumn("density", density(F.col("reads"), F.col("library"), F.col("length")))
    )


def gene_density(regions: DataFrame, reads: DataFrame, transcripts: DataFrame, counted: str = "unique_reads") -> DataFrame:
    """Density of a gene: that of its longest isoform, the one with the most exons (of equals the first by name).

    ``regions``: region_id, isoform, chrom, region_start, region_end of the isoforms' exons. Regions of other isoforms
    are left out before any read is joined.
    """
    first = longest_isoform(transcripts).groupBy("gene").agg(F.min("isoform").alias("isoform"))
    chosen = regions.drop("gene").join(first, "isoform")
    return read_density(chosen, reads, ["gene", "isoform"], counted=counted)
