"""Files to DataFrames. Columns are found by name where a file has a header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.genemodels import number_exons
from ..plans.rows import unroll

CHUNK = 65_536
SOURCES = {1: "RefSeq", 2: "Ensembl", 3: "UCSC", 4: "GENCODE"}


def _typed(df: DataFrame, ddl: str) -> DataFrame:
    """Select by name and cast; absent columns are null, unreadable values too."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in StructType.fromDDL(ddl)
        ]
    )


def _tab(spark: SparkSession, header: bool = True):
    return spark.read.option("sep", "\t").option("header", header).option("quote", "")


def read_tsv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Tab-separated table with a header row."""
    return _typed(_tab(spark).csv(path), ddl)


def read_maf(spark: SparkSession, path: str, ddl: str = schemas.MAF) -> DataFrame:
    """Mutation tables of one or more files, each read by its own header.

    The first physical line of a file is not data and the second is the header; where the first is a comment (``#``), the
    first line that is none is the header. Files may differ in their first lines and in the order of their columns;
    columns a file lacks are null.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    comment = lambda c: F.startswith(F.col(c), F.lit("#"))
    # lines of a file's first block come in order, so its least ids are its first lines
    tops = lines.where("_block = 0")
    first = tops.groupBy("_file").agg(
        F.min_by("value", "_id").alias("_first"), F.min("_id").alias("_top"), F.min(F.when(~comment("value"), F.col("_id"))).alias("_named"),
    )
    place = F.when(comment("_first"), F.col("_named")).otherwise(F.col("_top") + 1)
    heads = tops.join(first, "_file").where(F.col("_id") == place).select("_file", "_first", F.col("value").alias("_header"))
    told = F.when(comment("_first"), comment("value")).otherwise(F.col("value") == F.col("_first"))
    rows = lines.join(heads, "_file").where(~told & (F.col("value") != F.col("_header")))
    rows = rows.select(F.split("_header", "\t").alias("_names"), F.split("value", "\t").alias("_cells"))
    cell = lambda name: F.get("_cells", (F.array_position("_names", name) - 1).cast("int"))
    present = [f.name for f in StructType.fromDDL(ddl)]
    return _typed(rows.select(*[F.nullif(cell(n), F.lit("")).alias(n) for n in present]), ddl)


def _numbers(text: str) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("bigint"))


def read_gene_annotation(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Gene tables of several sources (1 RefSeq, 2 Ensembl, 3 UCSC, 4 GENCODE) as transcripts with exon arrays."""

    def one(db: int, path: str) -> DataFrame:
        df = read_tsv(spark, path, schemas.GENE_PRED)
        gene = F.col("name") if db == 3 else F.coalesce("name2", F.col("name"))
        coding = F.col("cdsStart") < F.col("cdsEnd")

        def exon(p):
            lo, hi = F.greatest(p["s"], F.col("cdsStart")), F.least(p["e"], F.col("cdsEnd"))
            has = coding & (lo < hi)
            return F.struct(
                p["s"].alias("start"), p["e"].alias("end"), F.when(has, lo).alias("cds_start"), F.when(has, hi).alias("cds_end"),
                F.lit(None).cast("int").alias("num"), F.lit(None).cast("int").alias("frame"), F.lit(None).cast("bigint").alias("offset"),
            )

        spans = F.arrays_zip(_numbers("exonStarts").alias("s"), _numbers("exonEnds").alias("e"))
        return df.select(
            gene.alias("gene"), F.col("name").alias("isoform"), "chrom",
            F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"), F.lit(db).alias("db"),
            F.array_sort(F.transform(spans, exon)).alias("exons"),
        )

    return number_exons(reduce(DataFrame.unionByName, [one(db, p) for db, p in paths.items()]))


def read_junction_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED12 rows as introns; the sample is the file name up to its first dot."""
    raw = _tab(spark, False).schema(schemas.BED12).csv(path)
    lengths = F.split("block_lengths", ",")
    part = lambda i: F.get(lengths, F.lit(i)).try_cast("bigint")
    return raw.select(
        F.substring_index("_metadata.file_name", ".", 1).alias("sample"), "chrom", "sj_id", "read_count", "strand",
        "leftmost", "rightmost", (F.col("leftmost") + part(0)).alias("start_pos"), (F.col("rightmost") - part(1)).alias("end_pos"),
    )


def read_unique_junctions(spark: SparkSession, path: str, min_unique: int = 0) -> DataFrame:
    """Annotated junction file of 20 columns."""
    raw = _tab(spark, False).schema(schemas.UNIQUE_JUNCTIONS).csv(path)
    flag = lambda c: F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)
    return raw.where(F.col("unique_count") >= min_unique).withColumns(
        {c: flag(c) for c in ("canonical", "has_skip", "frame_kept")}
    )


def read_junction_prevalence(spark: SparkSession, path: str) -> DataFrame:
    """One row per junction: the one with the larger sample count wins (then the sample list)."""
    raw = _tab(spark, False).schema(schemas.JUNCTION_PREVALENCE).csv(path)
    best = F.max_by(F.struct("sample_count", "control_count", "samples", "gene"), F.struct("sample_count", "samples", "control_count"))
    return raw.groupBy("chrom", "start_pos", "end_pos").agg(best.alias("_b")).select("chrom", "start_pos", "end_pos", "_b.*")


def read_fusions(spark: SparkSession, path: str) -> DataFrame:
    """Caller output; ``chromA-chromB`` becomes two columns and the counts numbers."""
    raw = _tab(spark, False).schema(schemas.FUSIONS).csv(path)
    chroms = F.split("chroms", "-")
    number = {c: F.col(c).try_cast("bigint") for c in ("read_span", "read_mate", "read_break")}
    return raw.withColumns({"chrom_a": F.get(chroms, F.lit(0)), "chrom_b": F.get(chroms, F.lit(1)), **number}).drop("chroms")


def parse_variant_effects(replies: DataFrame, column: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """JSON replies to one row per variant and transcript; of repeated transcripts the last stays, absent texts are ``-``."""
    parsed = replies.withColumn("_r", F.from_json(column, schemas.VARIANT_EFFECT)).where("_r is not null")
    listed = F.coalesce(F.col("_r.transcript_consequences"), F.array())
    # a transcript listed again later replaces the earlier entry
    last = F.filter(
        listed,
        lambda t, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda u: u["transcript_id"] == t["transcript_id"]),
    )
    rows = parsed.withColumn("_t", F.explode_outer(last))
    top = ["id", "seq_region_name", "start", "end", "allele_string", "variant_class", "most_severe_consequence"]
    texts = ["codons", "amino_acids", "hgvsc", "hgvsp"]
    return rows.select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in top],
        *[F.col(f"_t.{c}").alias(c) for c in ("transcript_id", "gene_symbol", "gene_id", "strand", "cds_start", "cds_end", "protein_start", "protein_end")],
        *[F.coalesce(f"_t.{c}", F.lit("-")).alias(c) for c in texts],
    )


def read_variant_effects(spark: SparkSession, path: str) -> DataFrame:
    """One JSON reply per line."""
    return parse_variant_effects(spark.read.text(path))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM text without header lines; sample from the file name."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    return lines.select(
        F.substring_index("_metadata.file_name", ".", 1).alias("sample"), at(0).alias("read_name"), at(2).alias("chrom"),
        at(3).try_cast("bigint").alias("pos"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"),
        F.regexp_extract("value", r"\tNH:i:(\d+)", 1).try_cast("int").alias("nh"),
    )


def read_genome_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """FASTA to (chrom, chunk, seq) pieces of fixed size.

    Lines are read in file splits. Within a split the bases before a line are a running sum; the totals of
    the splits (a few per file) carry the chromosome and offset over to the next split. No chromosome is
    ever held in one row or one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"), F.trim("value").alias("_v"),
    ).where(F.length("_v") > 0)
    header = F.col("_v").startswith(">")
    name = F.regexp_extract("_v", r"^>\s*(\S+)", 1)
    lines = lines.withColumns({"_n": F.when(header, name), "_l": F.when(header, 0).otherwise(F.length("_v"))})
    split = W.partitionBy("_f", "_b").orderBy("_i")
    placed = lines.withColumn("_c", F.sum("_l").over(split) - F.col("_l"))
    last = F.last(F.when(F.col("_n").isNotNull(), F.struct(F.col("_n").alias("n"), F.col("_c").alias("c"))), ignorenulls=True)
    placed = placed.withColumn("_h", last.over(split.rowsBetween(W.unboundedPreceding, 0)))
    # split totals: bases, and the last header with the bases behind it
    totals = placed.groupBy("_f", "_b").agg(
        F.sum("_l").alias("_t"), F.max_by("_h", "_i").alias("_lh")
    )
    files = W.partitionBy("_f").orderBy("_b")
    before = files.rowsBetween(W.unboundedPreceding, -1)
    run = totals.withColumn("_s", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    mark = F.when(F.col("_lh").isNotNull(), F.struct(F.col("_lh.n").alias("n"), (F.col("_s") + F.col("_lh.c")).alias("at")))
    run = run.withColumn("_p", F.last(mark, ignorenulls=True).over(before)).select("_f", "_b", "_s", "_p")
    bases = placed.where("_n is null").join(run, ["_f", "_b"]).select(
        F.coalesce("_h.n", F.col("_p.n")).alias("chrom"),
        F.when(F.col("_h").isNotNull(), F.col("_c") - F.col("_h.c")).otherwise(F.col("_s") + F.col("_c") - F.col("_p.at")).alias("_at"),
        "_v",
    )
    cut = unroll(bases, "chunk", F.sequence(F.floor(F.col("_at") / chunk), F.floor((F.col("_at") + F.length("_v") - 1) / chunk)))
    lo = F.greatest(F.col("chunk") * chunk - F.col("_at"), F.lit(0))
    hi = F.least((F.col("chunk") + 1) * chunk - F.col("_at"), F.length("_v"))
    pieces = cut.select("chrom", "chunk", "_at", F.substring("_v", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda p: p["_x"]), "")
    return pieces.groupBy("chrom", "chunk").agg(F.upper(text).alias("seq"))
