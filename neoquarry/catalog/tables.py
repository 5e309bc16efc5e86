"""Queries on files (written from a projection, read back) and the stage that joins everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..fixtures import ORACLE_ONLY
from ..operators import genemodels as g
from ..operators import sequences as s
from ..plans.rows import unroll
from ..session import shared_dir
from ..sources import readers as r
from ..sources import writers as w
from . import query
from .comparison import labelled
from .genes import transcripts
from .sequences import CHUNK, compared, sql_cut, sql_translate, with_sequence


def written(fx, label, df, header=True):
    """Write a projection as tab-separated text into the shared folder and give its path."""
    path = shared_dir(fx.spark, label)
    df.write.option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)
    return path


_MAF = """select concat('GENE', cast(l_partkey % 40 as string)) as Hugo_Symbol, case l_linestatus when 'O' then 'Missense_Mutation' else 'Frame_Shift_Del' end as Variant_Classification, cast(1 + l_partkey % 22 as string) as Chromosome,
 l_orderkey as Start_Position, l_orderkey + l_linenumber as End_Position, concat('S', cast(l_suppkey % 12 as string)) as Tumor_Sample_Barcode, concat('NM_', cast(l_partkey as string)) as Transcript_ID, cast(l_quantity as int) as n_alt_count from {lineitem}"""


@query(_MAF)
def read_maf(fx):
    rows = fx.sql(_MAF)
    # the first record of every part file carries the version line and the header
    path = shared_dir(fx.spark, "maf")
    header = F.lit("#version 2.4\n" + "\t".join(rows.columns) + "\n")
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns])
    numbered = rows.select(line.alias("value"), F.monotonically_increasing_id().alias("i"))
    first = F.col("i").bitwiseAND(F.lit(2**33 - 1)) == 0
    numbered.select(F.when(first, F.concat(header, "value")).otherwise(F.col("value")).alias("value")).write.text(path)
    return r.read_maf(fx.spark, path, schemas.MAF).select(*rows.columns)


_SCORES = "select allele, peptide_2 as peptide, cast(max(ic50_score_2) as double) as ic50_score, count(*) as rows_seen from {compare} group by 1, 2"


@query(_SCORES)
def read_tsv_tables(fx):
    path = written(fx, "scores", fx.sql(_SCORES))
    return r.read_tsv(fx.spark, path, "allele string, peptide string, ic50_score double, rows_seen bigint")


@query("select gene, isoform, chrom, strand, db, num as feat_num, start_pos, end_pos, cds_start, cds_end, frame from {feat}")
def read_gene_annotation(fx):
    t = transcripts(fx)
    join = lambda field: F.concat(F.array_join(F.transform("exons", lambda e: e[field].cast("string")), ","), F.lit(","))
    lo = F.array_min(F.transform("exons", lambda e: e["cds_start"]))
    hi = F.array_max(F.transform("exons", lambda e: e["cds_end"]))
    table = t.select(
        F.col("isoform").alias("name"), "chrom", F.when(F.col("strand") < 0, "-").otherwise("+").alias("strand"), F.col("tx_start").alias("txStart"),
        F.col("tx_end").alias("txEnd"), F.coalesce(lo, F.col("tx_end")).alias("cdsStart"), F.coalesce(hi, F.col("tx_end")).alias("cdsEnd"),
        F.size("exons").alias("exonCount"), join("start").alias("exonStarts"), join("end").alias("exonEnds"), F.col("gene").alias("name2"), "db",
    )
    path = shared_dir(fx.spark, "genes")
    table.withColumn("source", F.col("db")).drop("db").write.partitionBy("source").option("sep", "\t").option("header", True).option("quote", "").csv(path)
    models = r.read_gene_annotation(fx.spark, {db: f"{path}/source={db}" for db in (1, 2, 3, 4)})
    # source 3 names genes by the transcript; put the gene back for the comparison
    models = models.withColumn("gene", F.when(F.col("db") == 3, F.concat(F.lit("G"), F.regexp_extract("isoform", r"_(\d+)\.", 1))).otherwise(F.col("gene")))
    return unroll(models, "e", "exons").select(
        "gene", "isoform", "chrom", "strand", "db", F.col("e.num").alias("feat_num"), F.col("e.start").alias("start_pos"), F.col("e.end").alias("end_pos"),
        F.col("e.cds_start").alias("cds_start"), F.col("e.cds_end").alias("cds_end"), F.col("e.frame").alias("frame"),
    )


@query("select chrom, cast(sj_id as varchar) as sj_id, read_count, case when strand > 0 then '+' else '-' end as strand, leftmost, rightmost, start_pos, end_pos from {junctions}")
def read_junction_bed(fx):
    lengths = F.concat_ws(",", (F.col("start_pos") - F.col("leftmost")).cast("string"), (F.col("rightmost") - F.col("end_pos")).cast("string"))
    bed = fx.junctions.select(
        "chrom", "leftmost", "rightmost", "sj_id", "read_count", F.when(F.col("strand") > 0, "+").otherwise("-").alias("strand"), F.col("leftmost").alias("a"),
        F.col("rightmost").alias("b"), F.lit("255,0,0").alias("rgb"), F.lit(2).alias("blocks"), lengths.alias("lengths"), F.lit("0,1").alias("starts"),
    )
    return r.read_junction_bed(fx.spark, written(fx, "bed", bed, False)).drop("sample")


@query("select sj_id, chrom, start_pos, end_pos, gene, unique_count, canonical, has_skip, prevalence_control from (select concat('J', sj_id) as sj_id, chrom, start_pos, end_pos, gene, read_count as unique_count, sj_id % 2 = 0 as canonical, case when sj_id % 3 = 0 then null else sj_id % 3 = 1 end as has_skip, sj_id % 5 as prevalence_control from {junctions}) q where unique_count >= 120")
def read_unique_junctions(fx):
    flag = lambda c: F.when(c, "True").when(~c, "False").otherwise("None")
    k = F.col("sj_id")
    table = fx.junctions.select(
        "chrom", "start_pos", "end_pos", "strand", "gene", F.lit("+").alias("gs"), F.col("source_isoform").alias("iso"), F.col("read_count").alias("c1"), F.col("read_count").alias("c2"),
        F.col("read_count").alias("c3"), F.concat(F.lit("J"), k.cast("string")).alias("id"), F.lit("+").alias("ss"), flag(k % 2 == 0).alias("canon"),
        flag(F.when(k % 3 != 0, k % 3 == 1)).alias("skip"), F.lit("2").alias("skips"), F.lit("True").alias("kept"), F.lit("0-1").alias("frames"), "sample", F.lit(3).alias("pa"), (k % 5).alias("pc"),
    )
    out = r.read_unique_junctions(fx.spark, written(fx, "unique", table, False), 120)
    return out.select("sj_id", "chrom", "start_pos", "end_pos", "gene", "unique_count", "canonical", "has_skip", "prevalence_control")


@query("select chrom, start_pos, end_pos, sample_count, control_count, samples, gene from (select *, row_number() over (partition by chrom, start_pos, end_pos order by sample_count desc, samples desc, control_count desc) as n from (select chrom, start_pos, end_pos, read_count as sample_count, sj_id % 4 as control_count, concat(sample, ',S', sj_id) as samples, gene from {junctions}) q) r where n = 1")
def read_junction_prevalence(fx):
    k = F.col("sj_id")
    table = fx.junctions.select(
        "chrom", "start_pos", "end_pos", "gene", F.concat("sample", F.lit(",S"), k.cast("string")).alias("samples"), F.col("read_count").alias("n"), (k % 4).alias("c"), F.lit("1,2").alias("reads")
    )
    return r.read_junction_prevalence(fx.spark, written(fx, "prevalence", table, False))


@query("select chrom_a, chrom_b, pos_a, pos_b, orientation, cast(read_span as bigint) as read_span, cast(read_mate as bigint) as read_mate, cast(read_break as bigint) as read_break from {fusions}")
def read_fusions(fx):
    table = fx.fusions.select(
        F.concat_ws("-", "chrom_a", "chrom_b").alias("chroms"), "pos_a", "pos_b", "orientation", "read_span", "read_mate", "read_break", F.lit(0).alias("x"), F.lit(10).alias("y"), F.lit(20).alias("z")
    )
    return r.read_fusions(fx.spark, written(fx, "fusions", table, False)).drop("contradicting", "bases_left", "bases_right")


def replies(fx):
    q = fx.sequences
    one = lambda tag, codon: F.struct(
        F.concat(F.lit("T"), (F.col("variant_id") % tag).cast("string")).alias("transcript_id"), F.lit("GENE").alias("gene_symbol"), "gene_strand", F.col("gene_strand").alias("strand"),
        "cds_start", "cds_end", codon.alias("codons"), F.lit("A/V").alias("amino_acids"),
    )
    return q.select(
        F.to_json(
            F.struct(
                F.col("variant_id").cast("string").alias("id"), F.lit("7").alias("seq_region_name"), F.col("variant_id").alias("start"), F.col("variant_id").alias("end"),
                F.concat(F.lit("A/"), "alt").alias("allele_string"), F.lit("missense_variant").alias("most_severe_consequence"),
                F.when(F.col("variant_id") % 11 != 0, F.array(one(5, F.lit("gCa/gTa")), one(10, F.lit(None).cast("string")))).alias("transcript_consequences"),
            )
        ).alias("value")
    )


@query("""select id, start, allele_string, transcript_id, cds_start, codons, amino_acids, hgvsc from (select cast(variant_id as varchar) as id, variant_id as start, concat('A/', alt) as allele_string, concat('T', variant_id % 10) as transcript_id, cds_start, '-' as codons, 'A/V' as amino_acids, '-' as hgvsc from {sequences} where variant_id % 11 <> 0
 union all select cast(variant_id as varchar), variant_id, concat('A/', alt), concat('T', variant_id % 5), cds_start, 'gCa/gTa', 'A/V', '-' from {sequences} where variant_id % 11 <> 0 and variant_id % 10 >= 5
 union all select cast(variant_id as varchar), variant_id, concat('A/', alt), null, null, '-', '-', '-' from {sequences} where variant_id % 11 = 0) q""")
def read_variant_effects(fx):
    path = shared_dir(fx.spark, "effects")
    replies(fx).write.text(path)
    return r.read_variant_effects(fx.spark, path).select("id", "start", "allele_string", "transcript_id", "cds_start", "codons", "amino_acids", "hgvsc")


@query("select concat('r', read_id) as read_name, chrom, pos, mapq, cigar, nh from {reads}")
def read_alignments(fx):
    path = shared_dir(fx.spark, "sam")
    fields = [F.concat(F.lit("r"), F.col("read_id").cast("string")), F.lit("0"), "chrom", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*\t0\t0\tACGT\t*"), F.concat(F.lit("NM:i:0\tNH:i:"), F.col("nh").cast("string"))]
    body = fx.reads.select(F.concat_ws("\t", *fields).alias("value"))
    header = fx.features.select("chrom").distinct().select(F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:100000")).alias("value"))
    header.union(body).write.text(path)
    return r.read_alignments(fx.spark, path).drop("sample")


@query("select concat(chrom, '_', chunk) as chrom, i as chunk, substr(seq, cast(i as bigint) * 500 + 1, 500) as seq from {genome}, unnest(range(0, 5)) u(i)")
def read_genome_chunks(fx):
    path = shared_dir(fx.spark, "fasta")
    name = F.concat(F.lit(">"), "chrom", F.lit("_"), F.col("chunk").cast("string"), F.lit(" test contig\n"))
    fx.genome.select(F.concat(name, F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value")).write.text(path)
    return r.read_genome_chunks(fx.spark, path, 500)


@query("select case_id, aff_cat_2, count(*) as n, bool_or(peptide_1 = peptide_2) as same from {labelled} group by 1, 2")
def write_tables(fx):
    df = labelled(fx).groupBy("case_id", "aff_cat_2").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("peptide_1") == F.col("peptide_2")).alias("same"))
    path = shared_dir(fx.spark, "table")
    w.write_table(df, path, ["case_id", "aff_cat_2"])
    return r.read_tsv(fx.spark, path, "case_id string, aff_cat_2 string, n bigint, same boolean")


@query("select 'rows' as section, case_id, count(*) as n, null as mutations from {compare} group by 2 union all select 'mutations', case_id, null, count(distinct genome_pos) from {compare} group by 2")
def write_summary_sections(fx):
    base = fx.compare.groupBy("case_id")
    sections = {"rows": base.agg(F.count(F.lit(1)).alias("n")), "mutations": base.agg(F.count_distinct("genome_pos").alias("mutations"))}
    path = shared_dir(fx.spark, "summary")
    w.write_summary_sections(sections, path)
    return fx.spark.read.parquet(path).select("section", "case_id", "n", "mutations")


@query("select distinct peptide_2 as peptide, allele, case when l = 0 then -1 else 0 end as status from (select peptide_2, allele, order_key % 2 as k, min(order_key % 5) over (partition by peptide_2, allele) as l, min(order_key % 2) over (partition by peptide_2, allele) as m from {compare}) q where m = 1")
def write_error_rows(fx):
    c = fx.compare.select(F.col("peptide_2").alias("peptide"), "allele", "order_key")
    keys = ["peptide", "allele"]
    path = shared_dir(fx.spark, "errors")
    w.write_error_rows(c.select(*keys).distinct(), c.where("order_key % 2 = 0"), keys, path, c.where("order_key % 5 = 0"))
    return r.read_tsv(fx.spark, path, "peptide string, allele string, status int")


@query("select order_key, line_number, case_id, genome_pos from {compare} where concat(case_id, genome_pos) not in (select concat(case_id, genome_pos) from {compare} where line_number = 3)")
def resume_incremental(fx):
    c = fx.compare.select("order_key", "line_number", "case_id", "genome_pos")
    return w.resume_incremental(c, c.where("line_number = 3"), ("case_id", "genome_pos")).select("order_key", "line_number", "case_id", "genome_pos")


@query("""select concat('>neo|', substr(sha256(cast(variant_id as varchar)), 1, 10), '|', tag, i, '|variant|', i, ':', i + 9, '|', i, ' of 1') as title, substr(p, cast(i as bigint) + 1, 9) as peptide from (select variant_id, i, 'm' as tag, aa_alt_stop as p from {neoep}, unnest(range(0, length(aa_alt_stop) - 8)) u(i)
 union all select variant_id, i, 'o', aa_orig_stop from {neoep}, unnest(range(0, length(aa_alt_stop) - 8)) u(i)) q""")
def export_peptide_fasta(fx):
    path = shared_dir(fx.spark, "peptides")
    w.export_peptide_fasta(s.peptide_windows(compared(fx)), ["variant_id"], path, "neo", "variant")
    back = fx.spark.read.option("lineSep", ">").text(path).where(F.length("value") > 0)
    lines = F.split("value", "\n")
    return back.select(F.concat(F.lit(">"), F.get(lines, F.lit(0))).alias("title"), F.get(lines, F.lit(1)).alias("peptide"))


# ---- the variant x isoform table ---------------------------------------------------------------

# one effect per variant inside the coding sequence of its isoform; the reference base is the genome's
ORACLE_ONLY["effects"] = f"""select v.variant_id, v.case_id, v.chrom, v.pos, v.gene, v.isoform, v.alt, v.o + 1 as cds_pos, v.b, v.penult, t.cds_seq, t.strand, case when t.strand > 0 then substr(t.cds_seq, v.o + 1, 1) else translate(substr(t.cds_seq, v.o + 1, 1), 'ACGT', 'TGCA') end as ref,
 case when t.strand > 0 then v.alt else translate(v.alt, 'ACGT', 'TGCA') end as alt_tx from {{placedvar}} v join {{tseq}} t on t.isoform = v.isoform where v.o >= 0"""
ORACLE_ONLY["vtt"] = f"""select *, case when ac <> '' then {sql_translate('cds_seq')} end as po, {sql_translate('ac')} as pa from (select *, case when ref <> alt then concat(substr(cds_seq, 1, cds_pos - 1), alt_tx, substr(cds_seq, cds_pos + 1)) else '' end as ac from {{effects}}) q"""


def variant_rows(fx):
    models = with_sequence(fx)
    v = g.attach_models(fx.variants, models.drop("gene", "chrom"))
    v = s.genome_to_cds_position(v).where("cds_position >= 0")
    base = F.substring("cds_seq", (F.col("cds_position") + 1).cast("int"), F.lit(1))
    ref = F.when(F.col("strand") > 0, base).otherwise(F.translate(base, "ACGT", "TGCA"))
    v = v.withColumn("ref", ref)
    maf = v.select(
        F.col("variant_id").alias("row"), "case_id", F.lit("GENE").alias("Hugo_Symbol"), F.lit("Missense_Mutation").alias("Variant_Classification"), F.lit("SNP").alias("Variant_Type"),
        F.regexp_replace("chrom", "chr", "").alias("Chromosome"), F.col("pos").alias("Start_Position"), F.col("pos").alias("End_Position"), F.col("isoform").alias("Transcript_ID"),
        *[F.lit(None).cast("string").alias(c) for c in ("HGVSc", "HGVSp", "HGVSp_Short", "Codons", "Amino_acids", "Protein_position")],
    )
    effects = v.select(
        F.col("variant_id").alias("row"), F.col("isoform").alias("transcript_id"), F.col("gene").alias("gene_symbol"), F.concat_ws("/", "ref", "alt").alias("allele_string"),
        (F.col("cds_position") + 1).cast("int").alias("cds_start"), (F.col("cds_position") + 1).cast("int").alias("cds_end"),
        F.when(F.col("ref") != F.col("alt"), "A/V").otherwise("A").alias("amino_acids"), F.lit("-").alias("codons"), F.lit("-").alias("hgvsc"), F.lit("-").alias("hgvsp"),
        F.lit(1).alias("protein_start"), F.lit(1).alias("protein_end"), F.lit("missense_variant").alias("most_severe_consequence"), F.lit("SNV").alias("variant_class"),
    )
    return maf, effects, models


@query(f"""select variant_id as row, case_id, isoform as isoform_id, case when strand > 0 then ref else translate(ref, 'ACGT', 'TGCA') end as nuc_orig, alt_tx as nuc_alt, 'mutation' as my_change_type, 'inframe' as in_frame, cds_pos as cds_start, ref <> alt as bool_alteration, cds_seq as mrna_orig, ac as mrna_alt,
 case when ac <> '' and cds_pos > 3 and cds_pos - 1 - (cds_pos - 1) % 3 + 2 < length(cds_seq) then concat(substr(cds_seq, cds_pos - (cds_pos - 1) % 3, 3), '/', substr(ac, cds_pos - (cds_pos - 1) % 3, 3)) when ac = '' and cds_pos > 3 and cds_pos - 1 - (cds_pos - 1) % 3 + 2 < length(cds_seq) then concat(substr(cds_seq, cds_pos - (cds_pos - 1) % 3, 3), '/None') else 'None/None' end as codon_orig_alt,
 case when ac <> '' and b <> 0 then position('*' in {sql_translate(sql_cut('ac', "greatest(0, case when cds_pos - 9 <= 0 then cds_pos - 9 else cds_pos - 9 - (cds_pos - 9) % 3 end)", "case when b - ((b % 3) + 3) % 3 + 2 > length(ac) then -1 else b - ((b % 3) + 3) % 3 + 2 end"))}) > 0 when b <> 0 then false end as bool_nmd from {{vtt}}""")
def variant_transcript_table(fx):
    out = s.variant_transcript_table(*variant_rows(fx))
    assert len(out.columns) == 63
    return out.select(
        "row", "case_id", "isoform_id", "nuc_orig", "nuc_alt", "my_change_type", "in_frame", "cds_start", "bool_alteration", F.col("mRNA_orig").alias("mrna_orig"), F.col("mRNA_alt").alias("mrna_alt"),
        "codon_orig_alt", F.col("bool_NMD").alias("bool_nmd"),
    )
