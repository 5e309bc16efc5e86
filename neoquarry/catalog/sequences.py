"""Queries on coding sequences, alterations and altered proteins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ORACLE_ONLY
from ..functions.sequence import AMINO_ACIDS
from ..operators import genemodels as g
from ..operators import sequences as s
from . import query
from .genes import transcripts

CHUNK = 2048


def sql_translate(x: str) -> str:
    """Checking SQL for a protein of the column ``x``."""
    base = lambda k: f"(instr('TCAG', substr({x}, cast(i as bigint) + {k}, 1)) - 1)"
    return (
        f"array_to_string(list_transform(range(1, length({x}) - 1, 3), lambda i: substr('{AMINO_ACIDS}', "
        f"1 + 16 * {base(0)} + 4 * {base(1)} + {base(2)}, 1)), '')"
    )


def sql_cut(x: str, lo: str, hi: str) -> str:
    return f"substr({x}, ({lo}) + 1, greatest(0, case when ({hi}) < 0 then length({x}) + ({hi}) else ({hi}) end - ({lo})))"


def sql_stop(x: str) -> str:
    return f"split_part({x}, '*', 1)"


_USABLE = "coalesce(cds_start >= 1 and cds_end >= cds_start and cds_end <= length(cds), false)"
ORACLE_ONLY["altered"] = f"""
select *, case when not {_USABLE} then '' when change_type = 1 then concat(substr(cds, 1, cds_start), alt, substr(cds, cds_start + 1))
 else concat(substr(cds, 1, cds_start - 1), alt, substr(cds, cds_end + 1)) end as cds_alt from {{sequences}}"""
ORACLE_ONLY["proteins"] = f"select variant_id, cds, cds_alt, {sql_translate('cds')} as po, {sql_translate('cds_alt')} as pa from {{altered}}"
ORACLE_ONLY["diverged"] = """select *, coalesce(list_min(list_filter(range(0, least(length(po), length(pa))), lambda i: substr(po, cast(i as bigint) + 1, 1) <> substr(pa, cast(i as bigint) + 1, 1))), -1) as d,
 case when greatest(6, cast(ceil(ln(greatest(length(po), length(pa))) / ln(20)) as int)) >= length(pa) then cast(ceil(ln(greatest(length(po), length(pa))) / ln(20)) as int) else greatest(6, cast(ceil(ln(greatest(length(po), length(pa))) / ln(20)) as int)) end as k from {proteins}"""
ORACLE_ONLY["diffregion"] = """
select *, case when d >= 0 then greatest(0, 3 * d - 27) end as lo, case when d >= 0 then case when 3 * (case when r = -1 then length(pa) else r end) + 29 > length(cds_alt) then -1 else 3 * (case when r = -1 then length(pa) else r end) + 29 end end as hi
 from (select *, case when d >= 0 then coalesce(list_min(list_filter(range(d, length(pa) - k + 1), lambda i: position(substr(pa, cast(i as bigint) + 1, k) in po) > 0)), -1) else -1 end as r from {diverged}) q"""
ORACLE_ONLY["cutregion"] = f"select *, case when d >= 0 then {sql_cut('cds', 'lo', 'hi')} else '' end as region_orig, case when d >= 0 then {sql_cut('cds_alt', 'lo', 'hi')} else '' end as region_alt from {{diffregion}}"
ORACLE_ONLY["neoep"] = f"""select *, substr(aa_orig_full, 1, length(aa_alt_stop)) as aa_orig_stop from (select *, {sql_stop('aa_alt_full')} as aa_alt_stop from (
 select *, case when region_orig <> '' and region_alt <> '' then {sql_translate('region_orig')} else '' end as aa_orig_full, case when region_orig <> '' and region_alt <> '' then {sql_translate('region_alt')} else '' end as aa_alt_full from {{cutregion}}) a) b"""
# coding sequence per isoform, from genome pieces
ORACLE_ONLY["tseq"] = f"""select isoform, gene, chrom, strand, case when strand > 0 then t else reverse(translate(t, 'ACGT', 'TGCA')) end as cds_seq from (
 select f.isoform, f.gene, f.chrom, f.strand, string_agg(substr(g.seq, cast(greatest(cds_start - chunk * {CHUNK}, 0) + 1 as bigint), cast(least(cds_end - chunk * {CHUNK}, {CHUNK}) - greatest(cds_start - chunk * {CHUNK}, 0) as bigint)), '' order by cds_start, chunk) as t
 from {{feat}} f join {{genome}} g on g.chrom = f.chrom and g.chunk between floor(f.cds_start / {CHUNK}.0) and floor((f.cds_end - 1) / {CHUNK}.0) where f.cds_start is not null group by 1, 2, 3, 4) q"""
# variants with their coding offset and the gene model totals the decay rules need
ORACLE_ONLY["placedvar"] = """
select v.*, coalesce(case when strand > 0 then c.cds_offset + v.pos - 1 - c.cds_start else c.cds_offset + c.cds_end - v.pos end, -1) as o, t.total, t.last_len, t.parts,
 case when t.parts >= 2 then t.total - t.last_len - 1 end as penult, case when t.parts >= 2 then case when t.total - t.last_len - 1 < 50 then -1 else t.total - t.last_len - 51 end end as b
 from {variants} v left join {feat} c on c.isoform = v.isoform and c.cds_start < v.pos and v.pos <= c.cds_end
 left join (select isoform, cast(sum(cds_end - cds_start) as bigint) as total, arg_max(cds_end - cds_start, cds_offset) as last_len, count(*) as parts from {feat} where cds_start is not null group by 1) t on t.isoform = v.isoform"""


def sql_genome(offset: str, isoform: str) -> str:
    return (
        f"(select case when z.strand > 0 then z.cds_start + 1 + ({offset}) - z.cds_offset else z.cds_end - (({offset}) - z.cds_offset) end from {{feat}} z "
        f"where z.isoform = {isoform} and z.cds_offset <= ({offset}) and ({offset}) < z.cds_offset + z.cds_end - z.cds_start)"
    )


def altered(fx):
    return s.apply_alteration(fx.sequences)


def regions(fx):
    return s.altered_region(altered(fx))


def compared(fx):
    return s.comparative_neoepitopes(s.altered_region(altered(fx), keep_proteins=True))


def modelled(fx):
    return g.attach_models(fx.variants, transcripts(fx).drop("gene", "chrom"))


def with_sequence(fx):
    return s.transcript_sequence(transcripts(fx), fx.genome, CHUNK)


def sequenced(fx):
    return g.attach_models(fx.variants, with_sequence(fx).drop("gene", "chrom"))


@query("select isoform, cds_seq from {tseq}")
def transcript_sequence(fx):
    return with_sequence(fx).select("isoform", "cds_seq")


@query("select variant_id, o as cds_position, case when o >= 0 then pos end as genome_position from {placedvar}")
def genome_to_cds_position(fx):
    return s.genome_to_cds_position(modelled(fx)).select("variant_id", "cds_position", "genome_position")


@query("""select variant_id, coalesce((select min(num) from {feat} f where f.isoform = v.isoform and f.cds_start is not null and v.pos between f.cds_start and f.cds_end), -1) as feat_start,
 coalesce((select min(num) from {feat} f where f.isoform = v.isoform and f.cds_start is not null and v.pos + 350 between f.cds_start and f.cds_end), -1) as feat_end from {variants} v""")
def position_feature_number(fx):
    df = modelled(fx).withColumn("pos_end", F.col("pos") + 350)
    return s.position_feature_number(df).select("variant_id", "feat_start", "feat_end")


@query("""select v.variant_id, case when f.isoform is null then null when f.frame = -1 then -1 when v.pos = f.cds_start then null
 when f.strand > 0 then (v.pos - f.cds_start - 1 + f.frame) % 3 else (f.cds_end - v.pos + f.frame) % 3 end as frame
 from {variants} v left join {feat} f on f.isoform = v.isoform and v.pos between f.cds_start and f.cds_end""")
def reading_frame_at(fx):
    return s.reading_frame_at(modelled(fx)).select("variant_id", "frame")


@query("""select variant_id, case when ok then lo end as rf_start, case when ok then hi end as rf_end, case when cds_start - 9 <= 0 then cds_start - 9 else cds_start - 9 - (cds_start - 9) % 3 end as codons_before,
 case when cds_end + 9 >= length(cds) then -1 when cds_end is null then null else cds_end + 9 - (cds_end + 9) % 3 + 2 end as codons_after
 from (select *, lo >= 0 and hi < length(cds) as ok from (select *, cds_start - 1 - (cds_start - 1) % 3 as lo, cds_end - 1 - (cds_end - 1) % 3 + 2 as hi from {sequences}) q) r""")
def codon_window(fx):
    return s.codon_window(fx.sequences).select("variant_id", "rf_start", "rf_end", "codons_before", "codons_after")


_ALLELE = "case when change_type = 1 then '-' else substring(cds, cds_start, cds_end - cds_start + 1) end || '/' || case when change_type = 2 then '-' else alt end"


@query(f"""select variant_id, case when gene_strand = 1 then a else reverse(translate(a, 'ACGT', 'TGCA')) end as nuc_orig, case when gene_strand = 1 then b else reverse(translate(b, 'ACGT', 'TGCA')) end as nuc_alt
 from (select variant_id, gene_strand, split_part(t, '/', 1) as a, split_part(t, '/', 2) as b from (select *, coalesce(replace({_ALLELE}, '-', ''), '') as t from {{sequences}}) q) r""")
def allele_on_gene_strand(fx):
    df = fx.sql("select *, 1 as variant_strand, " + _ALLELE + " as allele_string from {sequences}")
    return s.allele_on_gene_strand(df).select("variant_id", "nuc_orig", "nuc_alt")


@query("select variant_id, cds_alt from {altered}")
def apply_alteration(fx):
    return altered(fx).select("variant_id", "cds_alt")


_EDITS = """select distinct concat('S', cast(variant_id % 2 as string)) as case_id, concat('I', cast(cast(floor(variant_id / 4.0) as bigint) as string)) as isoform, cds_start as pos, case when change_type = 1 then 0 when change_type = 2 then cds_end - cds_start + 1 else 1 end as len, alt from {sequences} where cds_start is not null"""
_ISO_CDS = "select concat('I', cast(cast(floor(variant_id / 4.0) as bigint) as string)) as isoform, min(cds) as cds from {sequences} group by 1"


@query(f"""with e as (select *, coalesce(max(pos + greatest(len, 1) - 1) over (partition by case_id, isoform order by pos, len, alt rows between unbounded preceding and 1 preceding) >= pos, false) as clash from ({_EDITS}) q),
 k as (select *, coalesce(lag(pos + len) over (partition by case_id, isoform order by pos, len, alt), 1) as prev from e where not clash), s as ({_ISO_CDS})
 select k.case_id, s.isoform, concat(string_agg(concat(substr(s.cds, k.prev, k.pos - k.prev), k.alt), '' order by k.pos), substr(s.cds, max(k.pos + k.len))) as cds_alt, count(*) as applied, (select count(*) from e where e.case_id = k.case_id and e.isoform = s.isoform and clash) as rejected
 from s join k on k.isoform = s.isoform group by k.case_id, s.isoform, s.cds""")
def apply_alterations_multi(fx):
    out = s.apply_alterations_multi(fx.sql(_EDITS), fx.sql(_ISO_CDS))
    return out.select("case_id", "isoform", "cds_alt", "applied", F.size("rejected").alias("rejected"))


ORACLE_ONLY["codons"] = """select variant_id, case when ok then case when change_type = 1 then lower(substr(cds, lo + 1, hi - lo + 1)) else concat(lower(substr(cds, lo + 1, cds_start - 1 - lo)), upper(substr(cds, cds_start, cds_end - cds_start + 1)), lower(substr(cds, cds_end + 1, hi + 1 - cds_end))) end end as codon_orig_marked,
 case when ok then case when change_type = 1 then concat(lower(substr(cds, lo + 1, cds_start - lo)), alt, lower(substr(cds, cds_start + 1, hi + 1 - cds_start))) else concat(lower(substr(cds, lo + 1, cds_start - 1 - lo)), alt, lower(substr(cds, cds_end + 1, hi + 1 - cds_end))) end end as codon_alt_marked,
 case when ok2 then substr(cds, lo + 1, hi2 - lo + 1) end as codon_orig, case when ok2 and lo <= length(cds_alt) and hi2 <= length(cds_alt) then substr(cds_alt, lo + 1, hi2 - lo + 1) end as codon_alt
 from (select *, lo >= 1 and hi < length(cds) as ok, lo >= 1 and hi2 < length(cds) as ok2 from (select *, cds_start - 1 - (cds_start - 1) % 3 as lo, cds_end - 1 - (cds_end - 1) % 3 + 2 as hi,
  cds_end + added - 1 - (cds_end + added - 1) % 3 + 2 as hi2 from (select *, case when case when change_type = 1 then 0 else cds_end - cds_start + 1 end < length(alt) then length(alt) else 0 end as added from {altered}) p) q) r"""


@query("select * from {codons}")
def changed_codon(fx):
    out = s.changed_codon(altered(fx))
    return out.select("variant_id", "codon_orig_marked", "codon_alt_marked", "codon_orig", "codon_alt")


@query("select variant_id, " + ", ".join(f"{sql_translate(c if 'marked' not in c else 'u' + c)} as {c.replace('codon', 'aa')}" for c in ("codon_orig_marked", "codon_alt_marked", "codon_orig", "codon_alt"))
       + " from (select *, upper(codon_orig_marked) as ucodon_orig_marked, upper(codon_alt_marked) as ucodon_alt_marked from {codons}) q")
def changed_amino_acid(fx):
    out = s.changed_amino_acid(s.changed_codon(altered(fx)))
    return out.select("variant_id", "aa_orig_marked", "aa_alt_marked", "aa_orig", "aa_alt")


@query(f"select variant_id, p as protein, {sql_stop('p')} as to_stop from (select variant_id, {sql_translate('cds')} as p from {{sequences}}) q")
def translate_cds(fx):
    return s.translate(s.translate(fx.sequences), name="to_stop", to_stop=True).select("variant_id", "protein", "to_stop")


@query(f"""select variant_id, orf_start, orf_protein from (select *, rank() over (partition by variant_id order by length(orf_protein) desc) as k from (
 select variant_id, orf_start, {sql_stop(sql_translate('t'))} as orf_protein from (select variant_id, i as orf_start, substr(cds, cast(i as bigint)) as t from {{sequences}}, unnest(range(1, length(cds) - 1)) u(i) where substr(cds, cast(i as bigint), 3) = 'ATG') q) r) w where k = 1""")
def longest_orf(fx):
    return s.longest_orf(fx.sequences).select("variant_id", "orf_start", "orf_protein")


@query(f"""select variant_id, codon, codon_mutated, {sql_translate('codon')} = {sql_translate('codon_mutated')} as synonymous from (select *, case when codon is not null then concat(substr(codon, 1, o % 3), base, substr(codon, o % 3 + 2)) end as codon_mutated from (
 select v.variant_id, v.o, case when v.gene_strand < 0 then translate(v.alt, 'ACGT', 'TGCA') else v.alt end as base, case when v.o >= 0 then substr(t.cds_seq, v.o - v.o % 3 + 1, 3) end as codon
 from {{placedvar}} v join {{tseq}} t on t.isoform = v.isoform) q) r""")
def snv_synonymy(fx):
    return s.snv_synonymy(sequenced(fx)).select("variant_id", "codon", "codon_mutated", "synonymous")


@query(f"""select v.variant_id, substr(g.seq, v.pos - g.chunk * {CHUNK}, 1) as genome_base, substr(g.seq, v.pos - g.chunk * {CHUNK}, 1) = case when v.gene_strand < 0 then translate(v.alt, 'ACGT', 'TGCA') else v.alt end as base_matches
 from {{variants}} v left join {{genome}} g on g.chrom = v.chrom and g.chunk = floor((v.pos - 1) / {CHUNK}.0)""")
def reference_base_check(fx):
    out = s.reference_base_check(fx.variants.withColumnRenamed("alt", "ref"), fx.genome, CHUNK)
    return out.select("variant_id", "genome_base", "base_matches")


@query("""select v.variant_id, f.isoform, coalesce(bool_or(f.cds_start < v.pos + 60 and v.pos + 60 <= f.cds_end), false) as in_cds, bool_or(f.start_pos < v.pos + 60 and v.pos + 60 <= f.end_pos) as in_exon,
 coalesce((select bool_or(i.start_pos < v.pos + 60 and v.pos + 60 <= i.end_pos) from {introns} i where i.isoform = f.isoform), false) as in_intron
 from {variants} v join {feat} f on f.gene = v.gene group by v.variant_id, v.pos, f.isoform""")
def position_in_cds_exon_intron(fx):
    moved = fx.variants.select("variant_id", "gene", (F.col("pos") + 60).alias("pos"))
    out = s.position_in_cds_exon_intron(g.attach_models(moved, transcripts(fx), "gene"))
    return out.select("variant_id", "isoform", "in_cds", "in_exon", "in_intron")


@query("select variant_id, d as diverged from {diverged}")
def protein_divergence_start(fx):
    return regions(fx).select("variant_id", "diverged")


@query("select variant_id, r as reconverged from {diffregion}")
def protein_reconvergence(fx):
    return regions(fx).select("variant_id", F.when(F.col("diverged") >= 0, F.col("reconverged")).otherwise(-1).alias("reconverged"))


@query("select variant_id, lo as region_start, hi as region_end, region_orig, region_alt from {cutregion}")
def altered_region(fx):
    return regions(fx).select("variant_id", "region_start", "region_end", "region_orig", "region_alt")


@query("select variant_id, aa_orig_full, aa_alt_full, aa_orig_stop, aa_alt_stop from {neoep}")
def comparative_neoepitopes(fx):
    cols = [F.col(c).alias(c.lower()) for c in ("AA_orig_full", "AA_alt_full", "AA_orig_STOP", "AA_alt_STOP")]
    return compared(fx).select("variant_id", *cols)


_SAME = "substr(cds, cast(i as bigint) + 1, least(n, i + 27) - i) = substr(cds_alt, cast(i as bigint) + 1, least(n, i + 27) - i)"


@query(f"""select variant_id, lo as region_start, hi as region_end, case when lo is not null then {sql_cut('cds', 'lo', 'hi')} else '' end as region_orig, case when lo is not null then {sql_cut('cds_alt', 'lo', 'hi')} else '' end as region_alt
 from (select *, case when f >= 0 then f + 1 - (f + 1) % 3 end as lo, case when f >= 0 then case when again is not null then least(n, again + 27) else -1 end end as hi from (
 select *, list_min(list_filter(range(f, n), lambda i: {_SAME})) as again from (select *, coalesce(list_min(list_filter(range(0, n), lambda i: not ({_SAME}))), -1) as f from (select variant_id, cds, cds_alt, length(cds_alt) as n from {{proteins}}) a) b) c) d""")
def nucleotide_region_diff(fx):
    out = s.altered_region(altered(fx), method="nucleotide")
    return out.select("variant_id", "region_start", "region_end", "region_orig", "region_alt")


@query("""select variant_id, case when aa_orig_stop = '' then 0 else length(aa_orig_stop) - 8 end as possible_neoep_orig, case when aa_orig_stop = '' then 0 else length(aa_alt_stop) - 8 end as possible_neoep_alt,
 case when aa_orig_stop = '' then '-' when length(aa_orig_stop) = length(aa_alt_stop) then 'True' else 'False' end as match_possible_neoep from {neoep}""")
def possible_neoepitope_count(fx):
    return s.possible_neoepitope_count(compared(fx)).select("variant_id", "possible_neoep_orig", "possible_neoep_alt", "match_possible_neoep")


@query("""select variant_id, i as window_start, concat(i, ':', i + 9) as window_frame, substr(aa_alt_stop, cast(i as bigint) + 1, 9) as peptide_alt, substr(aa_orig_stop, cast(i as bigint) + 1, 9) as peptide_orig
 from {neoep}, unnest(range(0, length(aa_alt_stop) - 8)) u(i)""")
def peptide_windows(fx):
    return s.peptide_windows(compared(fx)).select("variant_id", "window_start", "window_frame", "peptide_alt", "peptide_orig")


@query(f"""select isoform, i as window_start, substr(p, cast(i as bigint) + 1, 9) as peptide_alt, concat(chrom, ':', least(x, y), '-', greatest(x, y)) as window_range from (select q.*, i, {sql_genome('3 * i', 'q.isoform')} as x, {sql_genome('3 * i + 26', 'q.isoform')} as y
 from (select isoform, chrom, {sql_stop(sql_translate('cds_seq'))} as p from {{tseq}}) q, unnest(range(0, length(p) - 8)) u(i)) r""")
def peptide_windows_with_range(fx):
    df = s.translate(with_sequence(fx), "cds_seq", "p", to_stop=True).withColumn("first", F.lit(0))
    out = s.peptide_windows(df, "p", "p", cds_first="first")
    return out.select("isoform", "window_start", "peptide_alt", "window_range")


_FLANK = "select protein_id, concat(substring(protein, 5, 1), '/', case when protein_id % 3 = 0 then 'X' when protein_id % 3 = 1 then 'W' else '-' end) as change, substring(protein, 1, 3 + cast(protein_id % 4 as int)) as before, concat(substring(protein, 6, cast(protein_id % 9 as int)), case when protein_id % 2 = 0 then '*' else '' end, 'KL') as after from {proteome}"


@query(f"""select protein_id, case when ok then split_part(concat(h, a, t), '*', 1) end as neoep_orig, case when ok then split_part(concat(h, b, t), '*', 1) end as neoep_alt from (
 select protein_id, length(before) >= 4 and length(after) >= 4 as ok, right(before, 4) as h, substr(after, 1, 4) as t, case when position('-' in split_part(change, '/', 1)) > 0 then '' else replace(split_part(change, '/', 1), 'X', '') end as a,
 case when position('-' in split_part(change, '/', 2)) > 0 then '' else replace(split_part(change, '/', 2), 'X', '') end as b from ({_FLANK}) q) r""")
def flanked_peptide(fx):
    return s.flanked_peptide(fx.sql(_FLANK), "change", "before", "after", 4).select("protein_id", "neoep_orig", "neoep_alt")


@query(f"""select isoform, penult as relative_penultimate, b as relative_boundary, {sql_genome('penult', 'q.isoform')} as genome_penultimate, case when b = -1 then -1 else {sql_genome('b', 'q.isoform')} end as genome_boundary
 from (select t.isoform, k.penult, k.b from {{tx}} t left join (select distinct isoform, penult, b from {{placedvar}}) k on k.isoform = t.isoform) q""")
def truncation_boundary(fx):
    return s.truncation_boundary(transcripts(fx)).select("isoform", "relative_penultimate", "relative_boundary", "genome_penultimate", "genome_boundary")


_RF = "greatest(0, case when cds_start - 9 <= 0 then cds_start - 9 else cds_start - 9 - (cds_start - 9) % 3 end)"
ORACLE_ONLY["decay"] = f"""select *, position('*' in {sql_translate('x')}) > 0 as nmd, position('*' in {sql_translate('y')}) > 0 as any_stop from (
 select *, case when cds_start >= 0 and boundary <> 0 then {sql_cut('cds_alt', _RF, 'case when boundary - boundary % 3 + 2 > length(cds_alt) then -1 else boundary - boundary % 3 + 2 end')} end as x,
 {sql_cut('cds_alt', _RF, '-1')} as y from {{altered}}) q"""


def _decaying(fx):
    return altered(fx)


@query("select variant_id, nmd as bool_NMD from {decay}")
def nmd_susceptible(fx):
    return s.nmd_susceptible(_decaying(fx)).select("variant_id", "bool_NMD")


@query("select variant_id, case when not nmd then not any_stop end as bool_NSD from {decay}")
def nsd_susceptible(fx):
    return s.nsd_susceptible(_decaying(fx)).select("variant_id", "bool_NSD")


@query("select variant_id, coalesce(cds_start between boundary and penultimate_end or cds_end between boundary and penultimate_end, false) as alt_btwn_tp_penulti from {sequences}")
def alt_near_last_junction(fx):
    return s.alt_near_last_junction(fx.sequences).select("variant_id", "alt_btwn_tp_penulti")


def _range_sql(lo, hi, iso="q.isoform", chrom="q.chrom"):
    a, b = sql_genome(lo, iso), sql_genome(hi, iso)
    return f"case when {lo} is not null and {hi} is not null then concat({chrom}, ':', least({a}, {b}), '-', greatest({a}, {b})) end"


@query(f"""select variant_id, sr as sensitive_range, sn as sensitive_nuc, position('*' in {sql_translate('sn')}) > 0 as sensitive_stop, ir as irrelevant_range, nn as irrelevant_nuc, position('*' in {sql_translate('nn')}) > 0 as irrelevant_stop from (
 select variant_id, substr(cds_seq, l1 + 1, h1 - l1 + 1) as sn, substr(cds_seq, l2 + 1, h2 - l2 + 1) as nn, {_range_sql('l1', 'h1')} as sr, {_range_sql('l2', 'h2')} as ir from (
 select v.variant_id, v.isoform, v.chrom, t.cds_seq, cast(case when o >= 0 and b >= 0 and o < b then o - o % 3 end as bigint) as l1, cast(case when o >= 0 and b >= 0 and o < b then b - b % 3 + 2 end as bigint) as h1,
  cast(case when o >= 0 and b >= 0 then case when o > b then o - o % 3 else b - b % 3 + 3 end end as bigint) as l2, case when o >= 0 and b >= 0 then length(cds_seq) - 1 end as h2 from {{placedvar}} v join {{tseq}} t on t.isoform = v.isoform) q) r""")
def nmd_regions(fx):
    out = s.nmd_regions(sequenced(fx))
    return out.select("variant_id", "sensitive_range", "sensitive_nuc", "sensitive_stop", "irrelevant_range", "irrelevant_nuc", "irrelevant_stop")


@query(f"""select variant_id, {_range_sql('lo', 'hi')} as flank_range, case when lo is not null then substr(cds_seq, lo + 1, hi - lo + 1) end as flank_nuc, side from (
 select variant_id, isoform, chrom, cds_seq, side, cast(case when o >= 0 and lo0 >= 0 and hi0 < length(cds_seq) then lo0 end as bigint) as lo, cast(case when o >= 0 and lo0 >= 0 and hi0 < length(cds_seq) then hi0 end as bigint) as hi from (
 select v.variant_id, v.isoform, v.chrom, v.o, t.cds_seq, 'before' as side, o - o % 3 - 12 as lo0, o - o % 3 + 2 as hi0 from {{placedvar}} v join {{tseq}} t on t.isoform = v.isoform union all
 select v.variant_id, v.isoform, v.chrom, v.o, t.cds_seq, 'after', o - o % 3, o - o % 3 + 14 from {{placedvar}} v join {{tseq}} t on t.isoform = v.isoform) p) q""")
def flanking_sequence(fx):
    rows = sequenced(fx)
    both = [s.flanking_sequence(rows, 4, b).select("variant_id", "flank_range", "flank_nuc", F.lit(n).alias("side")) for b, n in ((True, "before"), (False, "after"))]
    return both[0].union(both[1])


@query(f"""select variant_id, fs as frameshift, a as nuc_region_orig, b as nuc_region_alt, {sql_translate('a')} as aa_region_orig, {sql_translate('b')} as aa_region_alt from (select variant_id, fs, {sql_cut('cds', 'lo', "case when fs then length(cds) else hi + 1 end")} as a,
 {sql_cut('cds_alt', 'lo', "case when fs then length(cds_alt) else hi + 1 + length(cds_alt) - length(cds) end")} as b from (select *, case when cds_alt <> '' then (length(cds_alt) - length(cds)) % 3 <> 0 end as fs, cds_start - 1 - (cds_start - 1) % 3 as lo, cds_end - 1 - (cds_end - 1) % 3 + 11 as hi from {{altered}}) q) r""")
def inframe_frameshift_sequences(fx):
    out = s.inframe_frameshift_sequences(altered(fx))
    return out.select("variant_id", "frameshift", "nuc_region_orig", "nuc_region_alt", "aa_region_orig", "aa_region_alt")
