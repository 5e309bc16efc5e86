"""Queries on the comparison table: scores, labels, expression, cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ORACLE_ONLY
from ..operators import cohort, expression, reports, scoring, variants
from ..operators.cohort import NeoepitopeFilter
from . import query

# the comparison table with the labels the cohort statistics need
ORACLE_ONLY["labelled"] = """
select *, case when ic50_score_2 <= 50 then 'HIGH' when ic50_score_2 <= 500 then 'MID' when ic50_score_2 <= 5000 then 'LOW' else 'none' end as aff_cat_2,
 case when mhc_score_2 > mhc_score_1 then 'higher' when mhc_score_2 < mhc_score_1 then 'lower' else 'equal' end as delta_mhc_score,
 case when proteasome_score_2 > proteasome_score_1 then 'higher' when proteasome_score_2 < proteasome_score_1 then 'lower' else 'equal' end as delta_proteasome_score,
 case when tap_score_2 > tap_score_1 then 'higher' when tap_score_2 < tap_score_1 then 'lower' else 'equal' end as delta_tap_score,
 concat(my_change_type, '_', in_frame) as alt_readframe_type, ic50_score_1 / ic50_score_2 as fold_change from {compare}"""

ROW = "order_key, line_number, peptide_2, allele, ic50_score_1, ic50_score_2"
ROWS = [c.strip() for c in ROW.split(",")]
FILTER = NeoepitopeFilter(2, 0, 2, True, 20, 10, 10, 1)
FRAME_FILTER = NeoepitopeFilter(1, 2, 0, True)
FILTER_SQL = """aff_cat_2 in ('HIGH','MID') and delta_mhc_score in ('higher','equal') and delta_proteasome_score in ('higher','equal')
 and delta_tap_score in ('higher','equal') and bool_nmd = 'False' and express_percentile >= 20 and proteasome_percentile_2 >= 10 and tap_percentile_2 >= 10 and pep_matches_2 <= 1"""
FRAME_SQL = "aff_cat_2 in ('HIGH','MID','LOW') and bool_nmd = 'False'"
TYPES2 = cohort.TYPE_VALUES[2]


def labelled(fx):
    df = scoring.delta_labels(variants.alt_readframe_type(fx.compare))
    return df.withColumns({"aff_cat_2": scoring.affinity_category("ic50_score_2"), "fold_change": reports.fold_change()})


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- mutation table columns -------------------------------------------------------------------

ORACLE_ONLY["maf"] = """
select l_orderkey as order_key, l_linenumber as line_number, concat('S', cast(l_suppkey % 12 as string)) as case_id,
 case l_returnflag when 'A' then 'Somatic' when 'N' then 'putative_somatic' else 'Germline' end as Mutation_Status, cast(l_quantity % 6 as int) as n_alt_count,
 case when l_partkey % 5 = 0 then null when l_partkey % 5 = 1 then '' else concat(substring('ACDEF', 1 + cast(l_partkey % 5 as int), 1), '/', substring('GHIKF', 1 + cast(l_suppkey % 5 as int), 1)) end as Amino_acids,
 case when l_partkey % 25 = 23 then 'X' when l_partkey % 25 = 24 then 'MT' else cast(l_partkey % 25 as string) end as Chromosome,
 case l_linestatus when 'O' then 'Missense_variant' else 'splice_region,FRAMESHIFT_variant' end as Consequence,
 concat(case when l_suppkey % 4 = 0 then 'NR_' else 'NM_' end, cast(l_suppkey as string)) as isoform_id,
 l_orderkey as start_pos, l_orderkey + l_linenumber - 1 as end_pos, case when l_linenumber % 2 = 0 then '-' else 'A' end as ref,
 concat(substring('ACGTA', 1, cast(l_partkey % 4 as int)), '/', case when l_suppkey % 3 = 0 then '-' else substring('TTGCA', 1, cast(l_suppkey % 5 as int)) end) as allele_string
 from {lineitem}"""


def maf(fx):
    return fx.sql(ORACLE_ONLY["maf"])


@query("select order_key, line_number, Mutation_Status, n_alt_count from {maf} where lower(Mutation_Status) like '%somatic%' and n_alt_count < 3")
def filter_somatic(fx):
    return variants.filter_somatic(maf(fx)).select("order_key", "line_number", "Mutation_Status", "n_alt_count")


@query("select order_key, line_number, Amino_acids from {maf} where Amino_acids is not null and Amino_acids <> ''")
def filter_coding_change(fx):
    return variants.filter_coding_change(maf(fx)).select("order_key", "line_number", "Amino_acids")


@query("select order_key, line_number, Chromosome from {maf} where regexp_matches(Chromosome, '^([0-9]+|X|Y)$')")
def filter_chromosome(fx):
    return variants.filter_chromosome(maf(fx)).select("order_key", "line_number", "Chromosome")


@query("select order_key, line_number, Consequence from {maf} where lower(Consequence) like '%frameshift%'")
def filter_consequence(fx):
    return variants.filter_consequence(maf(fx), 2).select("order_key", "line_number", "Consequence")


@query("select order_key, line_number, isoform_id from {maf} where position('NR_' in isoform_id) = 0")
def filter_noncoding_isoform(fx):
    return variants.filter_noncoding_isoform(maf(fx)).select("order_key", "line_number", "isoform_id")


@query("""select order_key, line_number, Amino_acids, isoform_id from {maf}
 where split_part(Amino_acids, '/', 1) <> '' and split_part(Amino_acids, '/', 2) <> '' and split_part(Amino_acids, '/', 1) <> split_part(Amino_acids, '/', 2)""")
def filter_altering_rows(fx):
    df = variants.filter_altering_rows(maf(fx), "Amino_acids", ("isoform_id", "case_id"))
    return df.select("order_key", "line_number", "Amino_acids", "isoform_id")


@query("""select order_key, line_number, genome_pos, concat('chr', Chromosome, ':', start_pos, '-', end_pos) as built, substr(split_part(genome_pos, ':', 1), 4) as chrom,
 cast(split_part(split_part(genome_pos, ':', 2), '-', 1) as bigint) as start_pos, cast(split_part(split_part(genome_pos, ':', 2), '-', 2) as bigint) as end_pos, end_pos - start_pos as span
 from (select order_key, line_number, Chromosome, start_pos, end_pos, concat('chr', Chromosome, ':', start_pos, '-', end_pos) as genome_pos from {maf}) q""")
def genome_pos_key(fx):
    df = maf(fx).withColumn("genome_pos", variants.genome_pos_key("Chromosome", "start_pos", "end_pos"))
    df = variants.parse_genome_pos(df.select("order_key", "line_number", "genome_pos"))
    return df.withColumn("built", variants.genome_pos_key("chrom", "start_pos", "end_pos"))


@query("""select order_key, line_number, ref, case when ref = '-' and end_pos - start_pos = 1 then end_pos else start_pos end as start_pos,
 case when ref = '-' and end_pos - start_pos = 1 then start_pos else end_pos end as end_pos, not (ref = '-' and abs(end_pos - start_pos) > 1) as valid from {maf}""")
def insertion_coordinates(fx):
    return variants.insertion_coordinates(maf(fx).select("order_key", "line_number", "ref", "start_pos", "end_pos"))


@query("select order_key, line_number, concat(case_id, '_WGS') as case_id from {maf}")
def sample_suffix(fx):
    return variants.sample_suffix(maf(fx).select("order_key", "line_number", "case_id"), True)


@query("select order_key, line_number, case_id, isoform_id, '~_~' as cancer_type, '~_~' as my_HGVSc from {maf}")
def fill_missing_columns(fx):
    df = variants.fill_missing_columns(maf(fx), ["case_id", "isoform_id", "cancer_type", "my_HGVSc"])
    return df.select("order_key", "line_number", "case_id", "isoform_id", "cancer_type", "my_HGVSc")


@query("""select p_partkey, coalesce(try_cast(v as double), 0) as v, try_cast(v as double) is not null as v_is_number, coalesce(try_cast(v as double) > 0, false) as v_is_positive
 from (select p_partkey, case when p_size % 4 = 0 then '-' when p_size % 4 = 1 then '0' else cast(p_size as varchar) end as v from {part}) q""")
def clean_expression_values(fx):
    df = fx.sql("select p_partkey, case when p_size % 4 = 0 then '-' when p_size % 4 = 1 then '0' else cast(p_size as string) end as v from {part}")
    return variants.clean_expression_values(df, ["v"])


_DIFF = "length(regexp_replace(split_part(allele_string, '/', 1), '[^ACTG]', '', 'g')) - length(regexp_replace(split_part(allele_string, '/', 2), '[^ACTG]', '', 'g'))"


@query(f"""select order_key, line_number, allele_string, case when d = 0 then 'mutation' when d < 0 then 'insertion' else 'deletion' end as my_change_type,
 case when d % 3 = 0 then 'inframe' else 'frameshift' end as in_frame from (select *, {_DIFF} as d from {{maf}}) q""")
def alteration_type(fx):
    return variants.alteration_type(maf(fx).select("order_key", "line_number", "allele_string"))


@query("select order_key, line_number, concat(my_change_type, '_', in_frame) as alt_readframe_type from {compare}")
def alt_readframe_type(fx):
    return variants.alt_readframe_type(fx.compare).select("order_key", "line_number", "alt_readframe_type")


@query("""select order_key, line_number, case when m then '-codon_empty-' else concat(a, ' | ', b) end as compare_codon, not m and a = b as match_codon,
 concat(case_id, ' | ', isoform_id) as compare_sample, case_id = isoform_id as match_sample
 from (select *, (a is null or a = '') as m, coalesce(a, '') as a2 from (select order_key, line_number, case_id, isoform_id, Amino_acids as a, 'C/G' as b from {maf}) r) q""")
def crosscheck_columns(fx):
    df = maf(fx).withColumn("computed", F.lit("C/G"))
    df = variants.crosscheck_columns(df, {"codon": ("Amino_acids", "computed"), "sample": ("case_id", "isoform_id")})
    return df.select("order_key", "line_number", "compare_codon", "match_codon", "compare_sample", "match_sample")


_HLA = """select c_custkey as "Patient ID", concat('A*0', c_custkey % 5, ':01,A*0', c_custkey % 7, ':02') as "HLA-A.1", concat('B*0', c_custkey % 6, ':01') as "HLA-B.1",
 case when c_custkey % 3 = 0 then null else concat('C*0', c_custkey % 4, ':01,C*0', c_custkey % 8, ':05') end as "HLA-C.1" from {customer}"""


def patients(fx):
    return fx.sql(_HLA.replace('"', "`"))


@query(f"""select "Patient ID" as patient, concat('HLA-', a) as allele, 9 as length from (select "Patient ID", unnest(string_split(concat_ws(',', "HLA-A.1", "HLA-B.1", "HLA-C.1"), ',')) as a from ({_HLA}) q) r""")
def patient_hla_alleles(fx):
    return variants.patient_hla_alleles(patients(fx))


@query("select order_key, line_number, case_id, case when case_id like '%1%' then 'first' when case_id like '%0%' then 'second' else null end as condition, case when case_id in ('S1','S2') then 'clone' else null end as category from {compare}")
def condition_label(fx):
    df = variants.condition_label(fx.compare.select("order_key", "line_number", "case_id"), [("s1", "first"), ("0", "second"), ("1", "first")])
    table = fx.compare.select("case_id").where("case_id in ('S1','S2')").distinct().withColumn("category", F.lit("clone"))
    return variants.condition_lookup(df, table)


_REPORT_ORDER = [
    "line_number", "mhc_score_2", "genome_pos", "peptide_2", "case_id", "gene_symbol", "ic50_score_1", "tap_score_1",
    "tap_score_2", "my_change_type", "in_frame", "bool_nmd",
]
_REPORT_MORE = {
    "proteasome_percentile_1": "cast(floor(proteasome_score_1 * 900) as int)",
    "tap_percentile_1": "cast(floor(tap_score_1 * 700) as int)",
    "aa_change": "concat(substring(peptide_1, 1, 1), '/', substring(peptide_2, 1, 1))",
    "mut_neoep_rank_1": "cast(line_number as double)",
}


@query(f"""select concat(case_id, '_', row_number() over (partition by case_id order by order_key) - 1) as sample_row, case_id, gene_symbol, allele, genome_pos,
 {_REPORT_MORE['aa_change']} as "myVEP_aa_orig_alt", my_change_type, in_frame, alt_readframe_type, peptide_1 as original_peptide, ic50_score_1 as ic50_score_orig,
 case when ic50_score_1 <= 50 then 'HIGH' when ic50_score_1 <= 500 then 'MID' when ic50_score_1 <= 5000 then 'LOW' else 'none' end as aff_cat_orig,
 proteasome_score_1 as proteasome_score_orig, tap_score_1 as tap_score_orig, {_REPORT_MORE['proteasome_percentile_1']} as proteasome_percentile_orig,
 {_REPORT_MORE['tap_percentile_1']} as tap_percentile_orig, peptide_2 as altered_peptide, ic50_score_2 as ic50_score_alt, aff_cat_2 as aff_cat_alt,
 proteasome_score_2 as proteasome_score_alt, tap_score_2 as tap_score_alt, proteasome_percentile_2 as proteasome_percentile_alt,
 tap_percentile_2 as tap_percentile_alt, bool_nmd as "bool_NMD", fold_change as "Fold Change (orig/alt)", {_REPORT_MORE['mut_neoep_rank_1']} as mut_neoep_rank_1
 from (select *, row_number() over (partition by order_key order by {', '.join(_REPORT_ORDER)}) as n from {{labelled}}) q where n = 1""")
def report_projection(fx):
    rows = labelled(fx).withColumn("aff_cat_1", scoring.affinity_category("ic50_score_1"))
    # only what the report shows, is made from or ordered by goes through the exchange
    shown = {c.lower() for c in variants.REPORT_COLUMNS.values()} | {*_REPORT_ORDER, "order_key", "proteasome_score_1", "peptide_1"}
    rows = cohort.first_per_mutation(rows.select(*[c for c in rows.columns if c.lower() in shown]), _REPORT_ORDER, ("order_key",))
    more = {("myVEP_aa_orig_alt" if c == "aa_change" else c): F.expr(e) for c, e in _REPORT_MORE.items()}
    return variants.report_projection(rows.withColumns(more), "case_id", "order_key")


# ---- peptide scores ---------------------------------------------------------------------------

ORACLE_ONLY["scores"] = """
select allele, peptide_2 as peptide, max(ic50_score_2) as ic50_score, max(mhc_score_2) as mhc_score, max(proteasome_score_2) as proteasome_score, max(tap_score_2) as tap_score,
 max(proteasome_score_2 + tap_score_2) as processing_score, max(proteasome_score_2 + tap_score_2 + mhc_score_2) as total_score from {compare} group by allele, peptide_2"""


def scores(fx):
    return fx.sql(ORACLE_ONLY["scores"])


@query("""select w.case_id, w.peptide, a.allele, s.ic50_score, s.mhc_score from (select distinct case_id, peptide_1 as peptide from {compare} union select distinct case_id, peptide_2 from {compare}) w
 join (select distinct case_id, allele from {compare}) a on a.case_id = w.case_id left join {scores} s on s.allele = a.allele and s.peptide = w.peptide""")
def score_peptides(fx):
    c = fx.compare
    windows = c.select("case_id", F.col("peptide_1").alias("peptide")).union(c.select("case_id", "peptide_2")).distinct()
    out = scoring.score_peptides(windows, c.select("case_id", "allele").distinct(), scores(fx))
    return out.select("case_id", "peptide", "allele", "ic50_score", "mhc_score")


_SOURCE = "select l_orderkey as start, l_linenumber as len, l_partkey as allele, l_suppkey as e, l_quantity as score, l_tax as extra from {lineitem}"


@query(f"select a.start, a.len, a.allele, a.e, a.score as score_x, b.score as score_y, a.extra as extra_x, b.extra as extra_y from ({_SOURCE}) a join ({_SOURCE} where l_quantity > 25) b on a.start = b.start and a.len = b.len and a.allele = b.allele and a.e = b.e")
def combine_score_sources(fx):
    df = fx.sql(_SOURCE)
    return scoring.combine_score_sources(df, df.where("score > 25"), ["start", "len", "allele", "e"])


@query("select order_key, line_number, ic50_score_2, aff_cat_2 from {labelled}")
def affinity_category(fx):
    df = fx.compare.withColumn("aff_cat_2", scoring.affinity_category("ic50_score_2"))
    return df.select("order_key", "line_number", "ic50_score_2", "aff_cat_2")


@query("""with ref as (select l_tax * l_quantity as v, count(*) as n from {lineitem} group by 1), cum as (select v, sum(n) over (order by v) - n as below, sum(n) over () as total from ref),
 probe as (select distinct p_size / 100.0 * 2 as v from {part})
 select p.p_partkey, round(100.0 * coalesce((select sum(n) from ref where ref.v < p.p_size / 100.0 * 2), 0) / (select sum(n) from ref), 6) as proteasome_percentile,
 round(100.0 * coalesce((select count(*) from {lineitem} where l_discount < p.p_size / 500.0), 0) / (select count(*) from {lineitem}), 6) as tap_percentile from {part} p""")
def processing_percentile(fx):
    probes = fx.sql("select p_partkey, p_size / 100.0D * 2 as proteasome_score, p_size / 500.0D as tap_score from {part}")
    ref = fx.sql("select l_tax * l_quantity as p, l_discount as t from {lineitem}")
    out = scoring.processing_percentile(probes, ref, {"proteasome_score": "p", "tap_score": "t"})
    return rounded(out.select("p_partkey", "proteasome_percentile", "tap_percentile"), "proteasome_percentile", "tap_percentile")


_PART = "select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity as mhc_score, l_tax as tap_score from {lineitem}"


@query(f"""select a.l_orderkey, a.l_linenumber, a.l_suppkey, a.l_partkey, a.mhc_score as mhc_score_1, b.mhc_score as mhc_score_2, a.tap_score as tap_score_1, b.tap_score as tap_score_2 from ({_PART}) a join ({_PART} where l_discount > 0.05) b
 on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_suppkey = b.l_suppkey and a.l_partkey = b.l_partkey""")
def compare_orig_alt(fx):
    second = fx.sql(_PART + " where l_discount > 0.05")
    return scoring.compare_orig_alt(fx.sql(_PART), second, ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey"])


@query("select order_key, line_number, delta_mhc_score, delta_proteasome_score, delta_tap_score as delta_TAP_score, case when ic50_score_2 > ic50_score_1 then 'lower' when ic50_score_2 < ic50_score_1 then 'higher' else 'equal' end as delta_ic50_score from {labelled}")
def delta_labels(fx):
    df = scoring.delta_labels(fx.compare)
    return df.select("order_key", "line_number", "delta_mhc_score", "delta_proteasome_score", "delta_TAP_score", "delta_ic50_score")


# every allele of the comparison, one per line number
_ALLELES = [f"HLA-{'ABC'[n % 3]}*0{1 + n % 5}:01" for n in range(1, 8)]
_CELLS = ", ".join(f"""max(case when allele = '{a}' then v end) as "{a}\"""" for a in _ALLELES)


@query(f"""select peptide, {_CELLS}
 from (select peptide_2 as peptide, allele, arg_max(ic50_score_2, struct_pack(a := order_key, b := line_number, c := ic50_score_2)) as v from {{compare}} group by 1, 2) q group by peptide""")
def peptide_allele_matrix(fx):
    df = fx.compare.withColumn("peptide", F.col("peptide_2"))
    return scoring.peptide_allele_matrix(df, _ALLELES, ["order_key", "line_number", "ic50_score_2"], "ic50_score_2")


_KMERS = "(select protein_id, accession, substr(protein, cast(i as bigint), 9) as peptide, i as start from {proteome}, unnest(range(1, length(protein) - 7)) t(i))"


@query(f"""select p.peptide, case when length(p.peptide) = 9 then coalesce(n, 0) end as pep_matches, case when length(p.peptide) = 9 then 'ok' else 'error' end as pep_match_qstat
 from (select distinct peptide_2 as peptide from {{compare}} union select distinct substr(peptide_2, 1, 5) from {{compare}}) p left join (select peptide, count(distinct protein_id) as n from {_KMERS} k group by peptide) k on k.peptide = p.peptide""")
def endogenous_match_count(fx):
    peptides = fx.compare.select(F.col("peptide_2").alias("peptide"))
    asked = peptides.union(peptides.select(F.substring("peptide", 1, 5))).distinct()
    return scoring.endogenous_match_count(asked, fx.proteome, [9])


@query(f"select peptide, protein_id, accession, min(start) as match_start, min(start) + 8 as match_end from {_KMERS} k where peptide in (select peptide_2 from {{compare}}) group by peptide, protein_id, accession")
def endogenous_match_positions(fx):
    return scoring.endogenous_match_positions(fx.compare.select(F.col("peptide_2").alias("peptide")), fx.proteome, [9])


def _avg_rank(column, order):
    return f"case when {column} is not null then rank() over (order by {column} {order}) + (count(*) over (partition by {column}) - 1) / 2.0 end"


@query(f"select allele, peptide, a as rank_ic50_score, b as rank_mhc_score, c as rank_proteasome_score, d as rank_tap_score, e as rank_processing_score, f as rank_total_score, b + c + d as rank_sum from (select allele, peptide, {_avg_rank('ic50_score', '')} as a, {_avg_rank('mhc_score', 'desc')} as b, {_avg_rank('proteasome_score', 'desc')} as c, {_avg_rank('tap_score', 'desc')} as d, {_avg_rank('processing_score', 'desc')} as e, {_avg_rank('total_score', 'desc')} as f from (select allele, peptide, ic50_score, mhc_score, proteasome_score, tap_score, round(processing_score, 4) as processing_score, round(total_score, 4) as total_score from {{scores}}) s) q")
def rank_processing_scores(fx):
    rows = scores(fx).withColumns({"processing_score": F.round("processing_score", 4), "total_score": F.round("total_score", 4)})
    out = scoring.rank_processing_scores(rows)
    return out.select("allele", "peptide", *[c for c in out.columns if c.startswith("rank_")])


# ---- labels and reports -----------------------------------------------------------------------


@query(f"select {ROW}, fold_change from {{labelled}}")
def fold_change(fx):
    return fx.compare.select(*ROWS, reports.fold_change().alias("fold_change"))


@query("select order_key, line_number, peptide_1, peptide_2, peptide_1 = peptide_2 as doublecheck_pep_seq from {compare}")
def same_peptide_flag(fx):
    return reports.same_peptide_flag(fx.compare.select("order_key", "line_number", "peptide_1", "peptide_2"))


_BEST = "(select peptide_2, allele from (select peptide_2, allele, mhc_score_2, max(mhc_score_2) over (partition by peptide_2) as best from {compare}) q where mhc_score_2 = best)"


@query(f"select order_key, line_number, c.peptide_2, l.p as preferred_HLA, l.n as preferred_HLA_copies from {{compare}} c join (select peptide_2, string_agg(allele, ',' order by allele) as p, string_agg(cast(n as varchar), ',' order by allele) as n from (select peptide_2, allele, count(*) as n from {_BEST} b group by 1, 2) a group by peptide_2) l on l.peptide_2 = c.peptide_2")
def preferred_hla(fx):
    return reports.preferred_hla(fx.compare.select("order_key", "line_number", "peptide_2", "allele", "mhc_score_2")).drop("allele", "mhc_score_2")


@query(f"select order_key, line_number, c.peptide_2, l.p as preferred_HLA_subgroup from {{compare}} c join (select peptide_2, string_agg(distinct split_part(allele, '*', 1), ',' order by split_part(allele, '*', 1)) as p from {_BEST} b group by peptide_2) l on l.peptide_2 = c.peptide_2")
def preferred_hla_subgroup(fx):
    df = fx.compare.select("order_key", "line_number", "peptide_2", "allele", "mhc_score_2")
    return reports.preferred_hla_subgroup(df).drop("allele", "mhc_score_2")


_MUT_RANK = "rank() over (partition by case_id, genome_pos order by mhc_score_2 desc) + (count(*) over (partition by case_id, genome_pos, mhc_score_2) - 1) / 2.0"


@query(f"select order_key, line_number, case_id, genome_pos, mhc_score_2, {_MUT_RANK} as mut_neoep_rank_1 from {{compare}}")
def mutation_neoepitope_rank(fx):
    df = fx.compare.select("order_key", "line_number", "case_id", "genome_pos", "mhc_score_2")
    return reports.mutation_neoepitope_rank(df)


@query(f"select order_key, line_number, case_id, genome_pos, mhc_score_2, {_MUT_RANK} as mut_neoep_rank_1 from {{compare}}")
def mutation_neoepitope_rank_by_ranges(fx):
    """The same ranks where every mutation of more than three rows is ranked by ranges."""
    df = fx.compare.select("order_key", "line_number", "case_id", "genome_pos", "mhc_score_2")
    return reports.mutation_neoepitope_rank(df, buckets=16, floor=3)


_EXPR = "select concat('GENE', cast(p_partkey % 50 as string)) as gene_symbol, concat('S', cast(p_size % 12 as string)) as condition, max(p_retailprice) as express, cast(max(p_size) as double) as percentile from {part} where p_partkey % 50 < 30 group by 1, 2"


@query(f"select order_key, line_number, c.gene_symbol, case_id as condition, coalesce(e.express, 0) as gene_express, coalesce(e.percentile, 0) as gene_percentile from {{compare}} c left join ({_EXPR}) e on e.gene_symbol = c.gene_symbol and e.condition = c.case_id")
def attach_gene_expression(fx):
    df = fx.compare.select("order_key", "line_number", "gene_symbol", F.col("case_id").alias("condition"))
    return reports.attach_gene_expression(df, fx.sql(_EXPR))


@query(f"""select order_key, line_number, case_id, genome_pos, input, fold_change, aff_cat_2 <> 'none' as binding from (select *, cast(order_key % 2 as int) as input,
 rank() over (partition by order_key % 2, case_id, genome_pos order by mhc_score_2 desc) + (count(*) over (partition by order_key % 2, case_id, genome_pos, mhc_score_2) - 1) / 2.0 as r from {{labelled}}) q
 where r = 1 and bool_nmd = 'False' and peptide_1 <> peptide_2 and line_number % 4 <> 1""")
def rank1_report(fx):
    change = F.when(F.col("line_number") % 4 == 1, "None/None").otherwise("A/V")
    compare = fx.compare.withColumn("myVEP_aa_orig_alt", change)
    inputs = [compare.where(F.col("order_key") % 2 == i) for i in (0, 1)]
    return reports.rank1_report(inputs).select("order_key", "line_number", "case_id", "genome_pos", "input", "fold_change", "binding")


# ---- expression -------------------------------------------------------------------------------


@query("""select condition, gene_id, express, round(case when express > 0 then 100.0 * (rank() over (partition by condition, express > 0 order by express) - 1) / count(*) over (partition by condition, express > 0) else 0 end, 6) as percentile from {expression}""")
def expression_percentile(fx):
    return rounded(expression.expression_percentile(fx.expression.drop("gene_name")), "percentile")


ORACLE_ONLY["genepct"] = "select condition, gene_id, express, case when express > 0 then 100.0 * (rank() over (partition by condition, express > 0 order by express) - 1) / count(*) over (partition by condition, express > 0) else 0 end as percentile from {expression}"
ORACLE_ONLY["gene_variants"] = "select l_orderkey as order_key, l_linenumber as line_number, l_partkey as gene_id, p_brand as condition, case l_linestatus when 'O' then 'missense_variant' else 'frameshift_variant' end as Consequence from {lineitem} join {part} on p_partkey = l_partkey"


def gene_variants(fx):
    return fx.sql(ORACLE_ONLY["gene_variants"])


@query("select v.order_key, v.line_number, v.gene_id, v.condition from {gene_variants} v join {genepct} e on e.gene_id = v.gene_id and e.condition = v.condition where e.percentile >= 60")
def genes_above_percentile(fx):
    table = expression.expression_percentile(fx.expression.drop("gene_name"))
    out = expression.genes_above_percentile(gene_variants(fx), table, 60, ["gene_id", "condition"])
    return out.select("order_key", "line_number", "gene_id", "condition")


_ISO = """select concat('I', cast(p_partkey % 300 as string), ';G', cast(p_partkey % 80 as string), ';', cast(p_partkey as string)) as "isoform;gene;range", case when p_size % 9 = 0 then '-' else cast(p_size as string) end as s1, cast(p_retailprice as string) as s2 from {part}"""
_WANT = "select s_suppkey, concat('I', cast(s_suppkey * 7 as string)) as isoform, concat('G', cast(s_suppkey % 90 as string)) as gene from {supplier}"


@query(f"""with t as (select split_part("isoform;gene;range", ';', 1) as i, split_part("isoform;gene;range", ';', 2) as g, try_cast(s1 as double) as s1, cast(s2 as double) as s2 from ({_ISO}) q)
 select w.*, case when a.i is not null then a.s1 else b.s1 end as s1, case when a.i is not null then a.s2 else b.s2 end as s2 from ({_WANT}) w
 left join (select i, max(s1) as s1, max(s2) as s2 from t group by i) a on a.i = w.isoform left join (select g, max(s1) as s1, max(s2) as s2 from t group by g) b on b.g = w.gene""")
def isoform_expression(fx):
    return expression.isoform_expression(fx.sql(_WANT), fx.sql(_ISO.replace('"', "`")), ["s1", "s2"])


@query("""with r as (select distinct condition, express from {expression} where express > 0), t as (select condition, express, rank() over (partition by condition order by express) - 1 as below, count(*) over (partition by condition) as n from r)
 select e.condition, e.gene_id, e.express, round(case when e.express > 0 then 100.0 * t.below / t.n else 0 end, 6) as percentile from {expression} e left join t on t.condition = e.condition and t.express = e.express""")
def sample_expression_percentile(fx):
    df = fx.expression.select("condition", "gene_id", "express")
    return rounded(expression.sample_expression_percentile(df, "condition"), "percentile")


_COUNTS = """select v.condition, case when Consequence like 'missense%' then 'missense' else 'frameshift' end as kind, count(*) as total, count(*) filter (express > 0) as expressed,
 count(*) filter (percentile >= 25) as percentile_25, count(*) filter (percentile >= 50) as percentile_50, count(*) filter (percentile >= 75) as percentile_75
 from {gene_variants} v left join {genepct} e on e.gene_id = v.gene_id and e.condition = v.condition group by 1, 2"""


@query(_COUNTS)
def mutation_expression_counts(fx):
    table = expression.expression_percentile(fx.expression.drop("gene_name"))
    return expression.mutation_expression_counts(gene_variants(fx), table, ["gene_id", "condition"])


@query("select condition, " + ", ".join(f"cast(coalesce(sum({m}) filter (kind = '{k}'), 0) as bigint) as {k}_{m}" for k in ("missense", "frameshift") for m in ("total", "expressed", "percentile_25", "percentile_50", "percentile_75")) + f" from ({_COUNTS}) q group by condition")
def mutation_summary_table(fx):
    return expression.mutation_summary_table(mutation_expression_counts(fx))


# ---- cohort statistics ------------------------------------------------------------------------


@query(f"select {ROW}, 'MHC affinity >= MID | frame_stat = alteration only | neoep_stat = high-efficacy neoeps | Filter NMD = True | Gene Exp >= 20 | ProtCleav Thres >= 10 | TAP Thres >= 10 | Endogen Freq Thres <= 1' as filter_label from {{labelled}} where {FILTER_SQL}")
def filter_neoepitopes(fx):
    return cohort.filter_neoepitopes(labelled(fx), FILTER).select(*ROWS, "filter_label")


def _pivot(expr, types, column, where):
    cells = ", ".join(f"coalesce({expr.format(t=t, c=column, w=where)}, 0) as \"{t}\"" for t in types)
    return f"select case_id, {cells} from {{labelled}} group by case_id"


@query(_pivot("count(distinct genome_pos) filter ({c} = '{t}' and {w})", cohort.CHANGES, "my_change_type", FILTER_SQL))
def mutation_counts(fx):
    return cohort.mutation_counts(labelled(fx), FILTER)


@query(_pivot("count(distinct peptide_2) filter ({c} = '{t}' and {w})", TYPES2, "alt_readframe_type", FRAME_SQL))
def neoepitope_counts(fx):
    return cohort.neoepitope_counts(labelled(fx), FRAME_FILTER)


@query(f"select distinct case_id, alt_readframe_type as alteration_type, genome_pos from {{labelled}} where {FRAME_SQL}")
def list_mutations(fx):
    return cohort.list_mutations(labelled(fx), FRAME_FILTER)


@query(f"select case_id, genome_pos, count(distinct case when {FRAME_SQL} then peptide_2 end) as peptides from {{labelled}} group by case_id, genome_pos")
def neoepitopes_per_alteration(fx):
    return cohort.neoepitopes_per_alteration(labelled(fx), FRAME_FILTER)


@query("select case_id, " + ", ".join(f"round(avg(n) filter (t = '{t}' and n > 0), 6) as \"{t}:avg\", round(stddev_pop(n) filter (t = '{t}' and n > 0), 6) as \"{t}:std\"" for t in TYPES2)
       + f" from (select case_id, alt_readframe_type as t, genome_pos, count(distinct case when {FRAME_SQL} then peptide_2 end) as n from {{labelled}} group by 1, 2, 3) q group by case_id")
def neoepitope_mean_std(fx):
    out = cohort.neoepitope_mean_std(labelled(fx), FRAME_FILTER)
    return out.select("case_id", *[F.round(f"`{c}`", 6).alias(c) for c in out.columns if c != "case_id"])


_ORDER = ["order_key", "line_number", "mhc_score_2", "ic50_score_1", "peptide_2", "case_id", "proteasome_score_2", "tap_score_2"]
_ORDER_SQL = ", ".join(_ORDER)


@query(f"select genome_pos, order_key, line_number, mhc_score_2, ic50_score_1 from (select *, row_number() over (partition by genome_pos order by {_ORDER_SQL}) as n from {{compare}}) q where n = 1")
def first_per_mutation(fx):
    return cohort.first_per_mutation(fx.compare.select("genome_pos", *_ORDER), _ORDER).select("genome_pos", "order_key", "line_number", "mhc_score_2", "ic50_score_1")


@query("select dataset, count(distinct genome_pos) as mutations from (select case when my_change_type = 'mutation' then 'a' when my_change_type = 'deletion' then 'b' end as dataset, genome_pos from {compare}) q where dataset is not null group by dataset")
def combine_datasets(fx):
    frames = {n: fx.compare.where(F.col("my_change_type") == t) for n, t in (("a", "mutation"), ("b", "deletion"), ("c", "insertion"))}
    return cohort.unique_mutations(cohort.combine_datasets(frames, ("c",)))


@query("""select case_id, count(*) as all_rows, count(*) filter (b) as binders, count(*) filter (b and p) as processed, count(*) filter (b and p and express_percentile > 0) as expressed
 from (select *, aff_cat_2 in ('HIGH','MID') as b, proteasome_percentile_2 >= 50 and tap_percentile_2 >= 50 as p from {labelled}) q group by case_id""")
def efficacy_funnel(fx):
    return cohort.efficacy_funnel(labelled(fx))


@query("""select case_id, aff_cat_2, w as "window", count(*) as n from (select *, concat(cast(lo as bigint), '-', cast(lo as bigint) + 25) as w, row_number() over (partition by case_id, genome_pos, lo order by %s) as rn
 from (select *, floor(proteasome_percentile_2 / 25.0) * 25 as lo from {labelled} where floor(proteasome_percentile_2 / 25.0) = floor(tap_percentile_2 / 25.0) and proteasome_percentile_2 < 100) p) q where rn = 1 group by 1, 2, 3""" % _ORDER_SQL)
def processing_bins(fx):
    return cohort.processing_bins(labelled(fx), _ORDER, 25)


@query("""select case_id, my_change_type, w as "window", count(*) as n from (select *, concat(cast(lo as bigint), '-', cast(lo as bigint) + 50) as w, row_number() over (partition by genome_pos, lo order by %s) as rn
 from (select *, floor(proteasome_percentile_2 / 50.0) * 50 as lo from {labelled} where floor(proteasome_percentile_2 / 50.0) = floor(tap_percentile_2 / 50.0) and proteasome_percentile_2 < 100) p) q where rn = 1 group by 1, 2, 3""" % _ORDER_SQL)
def processing_bins_by_group(fx):
    """A mutation counts once in a window, for the sample and group of its first row."""
    return cohort.processing_bins(labelled(fx), _ORDER, 50, category="my_change_type", key=("genome_pos",))


@query("""select case_id, aff_cat_2, label, cast(v as double) as value from (select case_id, aff_cat_2, 'rows' as label, count(*) as v from {labelled} group by 1, 2 union all select case_id, aff_cat_2, 'mutations', count(distinct genome_pos) from {labelled} group by 1, 2) q""")
def labelled_counts(fx):
    base = labelled(fx).groupBy("case_id", "aff_cat_2")
    frames = [("rows", base.agg(F.count(F.lit(1)).alias("v"))), ("mutations", base.agg(F.count_distinct("genome_pos").alias("v")))]
    return cohort.labelled_counts(frames, "v", ["case_id", "aff_cat_2"])


_TTEST = """with s as (select my_change_type as label, count(*) filter (in_frame = 'inframe') as n_a, count(*) filter (in_frame <> 'inframe') as n_b, avg(ic50_score_2) filter (in_frame = 'inframe') as ma, avg(ic50_score_2) filter (in_frame <> 'inframe') as mb,
 var_samp(ic50_score_2) filter (in_frame = 'inframe') as va, var_samp(ic50_score_2) filter (in_frame <> 'inframe') as vb from {compare} group by 1)
 select label, n_a, n_b, n_a + n_b - 2 as dof, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)), 6) as t_statistic from s"""


def _ttest_rows(fx):
    return fx.compare.select(F.col("my_change_type").alias("label"), F.col("in_frame").alias("category"), F.col("ic50_score_2").alias("value"))


@query(_TTEST)
def condition_ttest(fx):
    return rounded(cohort.condition_ttest(_ttest_rows(fx), "inframe", "frameshift", p_value=False), "t_statistic")


@query(_TTEST.replace("in_frame <> 'inframe'", "true"))
def condition_ttest_overlapping(fx):
    """Sides whose labels overlap: every category text holds the second label, in another case."""
    rows = _ttest_rows(fx).withColumn("category", F.concat(F.lit("Frame: "), "category"))
    return rounded(cohort.condition_ttest(rows, "InFrame", "fRAME", p_value=False), "t_statistic")


@query(None)
def condition_ttest_p_value(fx):
    return rounded(cohort.condition_ttest(_ttest_rows(fx), "inframe", "frameshift"), "t_statistic", "p_value")


@query("select case_id, my_change_type, round(avg(ic50_score_2), 6) as mean, round(stddev_samp(ic50_score_2), 6) as std from {compare} group by 1, 2")
def sample_mean_std(fx):
    return rounded(cohort.sample_mean_std(fx.compare, ("case_id", "my_change_type")), "mean", "std")


@query("select case_id, count(*) filter (fold_change < 1) as below_1, count(*) filter (fold_change = 1) as equal_1, count(*) filter (fold_change > 1) as above_1, count(*) filter (fold_change > 100) as above_100, count(*) filter (fold_change > 500) as above_500 from {labelled} group by 1")
def fold_change_buckets(fx):
    return cohort.fold_change_buckets(labelled(fx))


@query(f"select case_id, genome_pos, order_key, line_number, mhc_score_2, ic50_score_1 from (select *, row_number() over (partition by case_id, genome_pos order by mhc_score_2 desc, {_ORDER_SQL}) as n from {{compare}}) q where n = 1")
def best_row_per_mutation(fx):
    return cohort.best_row_per_mutation(fx.compare.select("genome_pos", *_ORDER), _ORDER).select("case_id", "genome_pos", "order_key", "line_number", "mhc_score_2", "ic50_score_1")


@query("select aff_cat_2 as aff_cat, max(ic50_score_2) as max_ic50, max(mhc_score_2) filter (ic50_score_2 = m) as mhc_score from (select *, max(ic50_score_2) over (partition by aff_cat_2) as m from {labelled}) q where aff_cat_2 <> 'none' group by aff_cat_2")
def category_boundary_values(fx):
    return cohort.category_boundary_values(fx.compare)


_FLAG = """select case_id, count(*) as all_rows, count(*) filter (aff_cat_2 in ('HIGH','MID')) as binders, count(*) filter (aff_cat_2 in ('HIGH','MID') and proteasome_percentile_2 >= 50 and tap_percentile_2 >= 50) as processed,
 count(*) filter (aff_cat_2 in ('HIGH','MID') and proteasome_percentile_2 >= 50 and tap_percentile_2 >= 50 and express_percentile > 0) as expressed
 from (select *, """ + _MUT_RANK + """ as r from {labelled}) q where r = 1 and bool_nmd = 'False' and peptide_1 <> peptide_2 group by case_id"""


@query(_FLAG)
def best_peptide_funnel(fx):
    """Per sample: mutations whose best peptide binds, is processed and is expressed."""
    ranked = reports.mutation_neoepitope_rank(reports.same_peptide_flag(labelled(fx)))
    best = ranked.where((F.col("mut_neoep_rank_1") == 1) & F.lower("bool_nmd").contains("fa") & ~F.col("doublecheck_pep_seq"))
    return cohort.efficacy_funnel(best)
