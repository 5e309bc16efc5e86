"""Queries on splice junctions and on transcripts as junction chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ORACLE_ONLY
from ..operators import evidence as ev
from ..operators import genemodels as g
from ..operators import junction_products as jp
from ..operators import junctions as j
from ..plans.rows import unroll
from ..operators import sequences as sequence_ops
from . import query
from .genes import transcripts
from .sequences import CHUNK, sql_translate

CONTROLS = ["S0", "S1"]


def _frame(p, f):
    return f"case when {p} > {f}.cds_start and {p} <= {f}.cds_end then case when {f}.strand > 0 then ({p} - {f}.cds_start - 1 + {f}.frame) % 3 else ({f}.cds_end - {p} + {f}.frame) % 3 end end"


# junction x isoform with what lies at both ends; exons do not touch, so each end meets one exon at most
ORACLE_ONLY["jx"] = f"""
select q.*, case when strand > 0 then fs else fe end as rf_start, case when strand > 0 then fe else fs end as rf_end, case when strand > 0 then (fs + 1) % 3 = fe else (fe + 1) % 3 = fs end as frame_preserved from (
 select v.sj_id, v.sample, v.gene, v.chrom, v.start_pos, v.end_pos, v.leftmost, v.rightmost, v.read_count, t.isoform, t.strand, t.tx_start, t.tx_end, t.coding_start, t.coding_end, t.n_exons,
  a.num as a_num, a.start_pos as a_start, a.end_pos as a_end, b.num as b_num, b.start_pos as b_start, b.end_pos as b_end, b1.num as b1_num, b1.start_pos as b1_start, b1.end_pos as b1_end,
  {_frame('v.start_pos', 'a')} as fs, {_frame('(v.end_pos + 1)', 'b1')} as fe, i.isoform is not null as canonical,
  ga.num as ga_num, ga.start_pos as ga_start, ga.end_pos as ga_end, gb.num as gb_num, gb.start_pos as gb_start, gb.end_pos as gb_end
 from {{junctions}} v join {{tx}} t on t.gene = v.gene left join {{feat}} a on a.isoform = t.isoform and v.start_pos between a.start_pos and a.end_pos
 left join {{feat}} b on b.isoform = t.isoform and v.end_pos between b.start_pos and b.end_pos left join {{feat}} b1 on b1.isoform = t.isoform and v.end_pos + 1 between b1.start_pos and b1.end_pos
 left join {{introns}} i on i.isoform = t.isoform and i.start_pos = v.start_pos and i.end_pos = v.end_pos
 left join {{introns}} ga on ga.isoform = t.isoform and v.start_pos between ga.start_pos and ga.end_pos left join {{introns}} gb on gb.isoform = t.isoform and v.end_pos between gb.start_pos and gb.end_pos) q"""
_SKIPS = "case when a_num is null or {b} is null then null else greatest(greatest(a_num, {b}) - least(a_num, {b}) - 1, 0) end"
ORACLE_ONLY["aberr"] = f"""
select *, coalesce(skips, 0) + case when exon_start is null or exon_end is null then 500 when exon_start <> 'exon_canon' or exon_end <> 'exon_canon' then 100 else 0 end + case when coalesce(frame_preserved, false) then 0 else 200 end as score from (
 select *, case when start_pos = a_start then 'exonLeft' when start_pos = a_end then 'exon_canon' when a_num is not null then 'withinElem' end as exon_start,
  case when end_pos + 1 = b1_start then 'exon_canon' when end_pos + 1 = b1_end then 'exonRight' when b1_num is not null then 'withinElem' end as exon_end, {_SKIPS.format(b='b1_num')} as skips,
  array_to_string(case when a_num is not null and b1_num is not null then range(least(a_num, b1_num) + 1, greatest(a_num, b1_num)) end, ',') as skip_text from {{jx}}) q"""
ORACLE_ONLY["assigned"] = """select * from (select *, min(score) over (partition by sj_id) as best from (select * replace (case when canonical then -1 else score end as score) from {aberr} where canonical or (exon_start is not null and exon_end is not null)) a) q where score = best"""


def pairs(fx):
    return j.junction_models(fx.junctions, transcripts(fx))


def assigned(fx):
    return j.assigned_junctions(fx.junctions, transcripts(fx))


@query("select sj_id, isoform, canonical from {jx}")
def canonical_junction(fx):
    return j.canonical_junction(pairs(fx)).select("sj_id", "isoform", "canonical")


@query("select v.chrom, v.start_pos, v.end_pos, i.db, string_agg(distinct i.gene, ',' order by i.gene) as genes from (select distinct chrom, start_pos, end_pos from {junctions}) v join {introns} i on i.chrom = v.chrom and i.start_pos = v.start_pos and i.end_pos = v.end_pos group by 1, 2, 3, 4")
def canonical_junction_sources(fx):
    return j.canonical_sources(fx.junctions, g.donor_acceptor_sites(transcripts(fx)))


@query("select sj_id, isoform, case when a_num is not null and b_num is not null then array_to_string(range(least(a_num, b_num) + 1, greatest(a_num, b_num)), ',') end as exon_skip from {jx}")
def skipped_exons(fx):
    return j.skipped_exons(pairs(fx)).select("sj_id", "isoform", F.array_join("exon_skip", ",").alias("exon_skip"))


@query("select sj_id, isoform, rf_start, rf_end, frame_preserved from {jx}")
def frame_preserved(fx):
    return j.frame_preserved(pairs(fx)).select("sj_id", "isoform", "rf_start", "rf_end", "frame_preserved")


_EFFECTS = """array_to_string(list_filter([case when skips > 0 then concat('exon_skip: ', skip_text) end, case when exon_start is null or exon_end is null then 'intronic' when exon_start <> 'exon_canon' or exon_end <> 'exon_canon' then 'exonic' end,
 case when not coalesce(frame_preserved, false) then 'frameshift' end], lambda x: x is not null), ',')"""


@query(f"select sj_id, isoform, exon_start, exon_end, score, {_EFFECTS} as effects from {{aberr}}")
def aberration_class(fx):
    out = j.aberration_class(pairs(fx), intronic=True)
    return out.select("sj_id", "isoform", "exon_start", "exon_end", "score", F.array_join("effects", ",").alias("effects"))


@query("select sj_id, isoform, score, canonical from {assigned}")
def assign_isoforms(fx):
    return assigned(fx).select("sj_id", "isoform", "score", "canonical")


@query(f"""select sj_id, concat(sj_id, '::', string_agg(t, '>>' order by t)) as aberrations from (select sj_id, concat('isoform_id = ', isoform, ';exon_skip = ', coalesce(skip_text, ''), ';frame_preserved = ', case when frame_preserved then 'True' when not frame_preserved then 'False' else 'None' end,
 ';calc_rf = ', coalesce(cast(rf_start as varchar), 'None'), '-', coalesce(cast(rf_end as varchar), 'None'), ';effects = ', {_EFFECTS}) as t from {{assigned}} where score >= 0) q group by sj_id""")
def aberration_text(fx):
    return j.aberration_text(assigned(fx))


@query("select sj_id, isoform, coalesce(case when strand > 0 then coding_start > start_pos else coding_end < end_pos end, false) as before_coding from {jx}")
def before_coding(fx):
    return j.before_coding(pairs(fx)).select("sj_id", "isoform", "before_coding")


@query("select sj_id, isoform, concat(coalesce(concat('exon_', a_num), concat('intron_', ga_num), 'None'), ':', coalesce(concat('exon_', b_num), concat('intron_', gb_num), 'None')) as ligated from (select * replace (case when a_num is not null then a_num end as a_num) from {jx}) q".replace("concat('exon_', a_num)", "case when a_num is not null then concat('exon_', a_num) end").replace("concat('intron_', ga_num)", "case when ga_num is not null then concat('intron_', ga_num) end").replace("concat('exon_', b_num)", "case when b_num is not null then concat('exon_', b_num) end").replace("concat('intron_', gb_num)", "case when gb_num is not null then concat('intron_', gb_num) end"))
def ligated_elements(fx):
    return j.ligated_elements(pairs(fx)).select("sj_id", "isoform", "ligated")


# numbers of the exons both ends belong to; an end in an intron belongs to the exon it makes longer
ORACLE_ONLY["mod"] = """select x.*, case when a_num is not null then a_num when ga_num is not null then case when strand > 0 then ga_num else ga_num + 1 end end as na, case when b_num is not null then b_num when gb_num is not null then case when strand > 0 then gb_num + 1 else gb_num end end as nb from {jx} x"""


@query("""select m.sj_id, m.isoform, na as exon_left, nb as exon_right, concat(case when na is null then 'None' else concat(m.chrom, ':', l.start_pos, '-', m.start_pos) end, '*', case when nb is null then 'None' else concat(m.chrom, ':', m.end_pos, '-', r.end_pos) end) as exon_positions,
 coalesce(l.end_pos = m.start_pos, false) as left_canonical, coalesce(r.start_pos = m.end_pos, false) as right_canonical from {mod} m left join {feat} l on l.isoform = m.isoform and l.num = na left join {feat} r on r.isoform = m.isoform and r.num = nb""")
def modified_exons(fx):
    out = j.modified_exons(pairs(fx))
    return out.select("sj_id", "isoform", "exon_left", "exon_right", "exon_positions", "left_canonical", "right_canonical")


def _asked(fx):
    """Every junction x isoform with each exon of the isoform asked for."""
    df = unroll(pairs(fx), "_x", "exons")
    return df.withColumns({"asked": F.col("_x.num"), "asked_start": F.col("_x.start"), "asked_end": F.col("_x.end")}).drop("_x")


@query("select x.sj_id, x.isoform, f.num as asked, coalesce(x.a_num = f.num, false) or coalesce(x.b_num = f.num, false) as has_exon from {jx} x join {feat} f on f.isoform = x.isoform")
def junction_has_exon(fx):
    return j.junction_has_exon(_asked(fx)).select("sj_id", "isoform", "asked", "has_exon")


@query("select x.sj_id, x.isoform, f.num as asked, coalesce(x.na = f.num, false) or coalesce(x.nb = f.num, false) as has_exon, coalesce(x.na = f.num, false) as has_start, coalesce(x.nb = f.num, false) as has_end from {mod} x join {feat} f on f.isoform = x.isoform")
def junction_has_exon_modified(fx):
    # the exons of a row are known before it is unrolled
    df = unroll(j.modified_exons(pairs(fx)), "_x", "exons").withColumn("asked", F.col("_x.num"))
    return j.junction_has_exon_modified(df).select("sj_id", "isoform", "asked", "has_exon", "has_start", "has_end")


@query("""select x.sj_id, x.isoform, 'skipped' as missing_kind, f.num as missing_num, f.start_pos as missing_start, f.end_pos as missing_end from {jx} x join {feat} f on f.isoform = x.isoform and f.num > least(x.a_num, x.b_num) and f.num < greatest(x.a_num, x.b_num) where x.a_num is not null and x.b_num is not null
 union all select sj_id, isoform, 'cut', a_num, start_pos, a_end from {jx} where start_pos > a_start and start_pos < a_end union all select sj_id, isoform, 'cut', b_num, b_start, end_pos from {jx} where end_pos > b_start and end_pos < b_end""")
def missing_exons(fx):
    return j.missing_exons(pairs(fx)).select("sj_id", "isoform", "missing_kind", "missing_num", "missing_start", "missing_end")


@query("""select sj_id, isoform, 'start' as retained_side, ga_num as retained_num, ga_start as retained_start, start_pos as retained_end from {jx} where start_pos > ga_start and start_pos < ga_end
 union all select sj_id, isoform, 'end', gb_num, end_pos, gb_end from {jx} where end_pos > gb_start and end_pos < gb_end""")
def retained_introns(fx):
    return j.retained_introns(pairs(fx)).select("sj_id", "isoform", "retained_side", "retained_num", "retained_start", "retained_end")


def _element(p, n):
    # with the direction towards the 5' end, the exon wins over the intron it touches
    return f"(select case when max(e.num) filter (e.feat_type = 'exon') is not null then concat('exon_', max(e.num) filter (e.feat_type = 'exon')) when max(e.num) is not null then concat('intron_', max(e.num)) end from {{elements}} e where e.isoform = x.isoform and {p} between e.start_pos and e.end_pos) as {n}"


@query(f"""select sj_id, isoform, case when a is not null or b is not null then coalesce(a = b, false) end as same_start, case when c is not null or d is not null then coalesce(c = d, false) end as same_end
 from (select sj_id, isoform, {_element('x.start_pos', 'a')}, {_element('x.leftmost', 'b')}, {_element('x.end_pos', 'c')}, {_element('x.rightmost', 'd')} from {{jx}} x) q""")
def anchor_same_feature(fx):
    return j.anchor_same_feature(pairs(fx)).select("sj_id", "isoform", "same_start", "same_end")


_CODE = "case when a.start_pos <= b.start_pos and b.start_pos < a.end_pos then 1 else 0 end + case when a.start_pos < b.end_pos and b.end_pos <= a.end_pos then 2 else 0 end"


@query(f"select a.sj_id, b.isoform, b.num as feat_num, {_CODE} as overlap_code from {{junctions}} a join {{introns}} b on b.chrom = a.chrom and a.start_pos < b.end_pos and b.start_pos < a.end_pos")
def junction_overlap_code(fx):
    sites = g.donor_acceptor_sites(transcripts(fx)).select(
        "isoform", "feat_num", "chrom", F.col("start_pos").alias("other_start"), F.col("end_pos").alias("other_end")
    )
    met = j.overlapping_junctions(fx.junctions.select("sj_id", "chrom", "start_pos", "end_pos"), sites)
    coded = j.junction_overlap_code(met.withColumn("other_chrom", F.col("chrom")))
    return coded.select("sj_id", "isoform", "feat_num", "overlap_code")


@query("""select sj_id, isoform, canon_start, canon_end from (select x.sj_id, x.isoform, i.start_pos as canon_start, i.end_pos as canon_end, row_number() over (partition by x.sj_id, x.isoform order by case when x.strand > 0 then i.start_pos else -i.end_pos end) as n
 from {jx} x left join {introns} i on i.isoform = x.isoform and case when x.strand > 0 then i.end_pos > x.start_pos else i.start_pos < x.end_pos end) q where n = 1""")
def nearest_canonical_junction(fx):
    return j.nearest_canonical_junction(pairs(fx)).select("sj_id", "isoform", "canon_start", "canon_end")


@query("select sj_id, isoform, canonical, 'both' as mode from {jx} where canonical and start_pos between tx_start + 100 and tx_start + 900 and end_pos between tx_start + 100 and tx_start + 900 union all select sj_id, isoform, canonical, 'start' from {jx} where not canonical and start_pos between tx_start + 100 and tx_start + 900")
def junctions_in_range(fx):
    df = j.canonical_junction(pairs(fx))
    low, high = F.col("tx_start") + 100, F.col("tx_start") + 900
    cols = ["sj_id", "isoform", "canonical"]
    both = j.junctions_in_range(df, low, high, "both", 1).select(*cols, F.lit("both").alias("mode"))
    return both.union(j.junctions_in_range(df, low, high, "start", 2).select(*cols, F.lit("start").alias("mode")))


_PREV = "select chrom, start_pos, end_pos, gene, count(distinct sample) as sample_count, count(distinct case when sample in ('S0', 'S1') then sample end) as control_count from {junctions} where read_count >= 50 group by 1, 2, 3, 4"


@query(f"""select x.sj_id, x.region_id, coalesce(p.sample_count, 0) as sample_count, coalesce(p.control_count, 0) as control_count from (select v.sj_id, v.chrom, v.start_pos, v.end_pos, v.gene, r.pk as region_id from {{junctions}} v join {{features}} r on r.chrom = v.chrom and v.start_pos < r.end_pos and r.start_pos < v.end_pos where v.read_count >= 100) x
 left join ({_PREV}) p on p.chrom = x.chrom and p.start_pos = x.start_pos and p.end_pos = x.end_pos""")
def sample_junctions(fx):
    regions = fx.features.select(F.col("pk").alias("region_id"), "chrom", F.col("start_pos").alias("region_start"), F.col("end_pos").alias("region_end"))
    prevalence = j.junction_sample_prevalence(fx.junctions, CONTROLS, 50)
    return j.sample_junctions(fx.junctions, regions, prevalence, 100).select("sj_id", "region_id", "sample_count", "control_count")


@query("select sj_id, isoform, score from {assigned} where not canonical")
def aberrant_junctions(fx):
    return j.aberrant_junctions(assigned(fx)).select("sj_id", "isoform", "score")


@query(_PREV)
def junction_sample_prevalence(fx):
    return j.junction_sample_prevalence(fx.junctions, CONTROLS, 50)


@query(_PREV.replace(" group by", " and gene in (select gene from {features} where cds_start is not null) group by"))
def junction_sample_prevalence_coding(fx):
    return j.junction_sample_prevalence(fx.junctions, CONTROLS, 50, transcripts(fx))


_LISTS = "select o_orderkey as sj_id, concat('S', cast(o_custkey % 12 as string), ',S', cast(o_custkey % 5 as string), ',S', cast(o_orderkey % 7 as string)) as samples, concat(cast(o_custkey % 40 as string), ',', cast(o_orderkey % 40 as string), ',', cast((o_custkey + o_orderkey) % 40 as string)) as counts from {orders}"


@query(f"select sj_id, sample, cast(reads as bigint) as reads, sample in ('S0', 'S1') as is_control from (select sj_id, unnest(string_split(samples, ',')) as sample, unnest(string_split(counts, ',')) as reads from ({_LISTS}) q) r where cast(reads as bigint) >= 20")
def samples_above_threshold(fx):
    return j.samples_above_threshold(fx.sql(_LISTS), 20, CONTROLS)


@query("select sample, isoform, case when strand > 0 then start_pos else end_pos end as site, count(*) as junctions, count(distinct case when strand > 0 then end_pos else start_pos end) as partner_sites, cast(sum(read_count) as bigint) as reads from {jx} group by 1, 2, 3")
def group_by_splice_site(fx):
    return j.group_by_splice_site(j.canonical_junction(pairs(fx)))


def _bracketed(closed):
    low = "p.b <= x.donor" if closed else "p.b < x.donor"
    guard = "" if closed else "and not exists (select 1 from bounds z where z.isoform = x.isoform and z.b = x.donor)"
    return f"""bounds as (select isoform, case when strand > 0 then end_pos else start_pos end as b from {{introns}} union all select isoform, tx_start from {{tx}} union all select isoform, tx_end from {{tx}}),
 x as (select *, case when strand > 0 then start_pos else end_pos end as donor from {{jx}}), k as (select x.*, (select max(p.b) from bounds p where p.isoform = x.isoform and {low} {guard}) as lo, (select min(p.b) from bounds p where p.isoform = x.isoform and p.b > x.donor) as hi from x),
 br as (select *, case when lo is not null and hi is not null then lo else start_pos end as bracket_start, case when lo is not null and hi is not null then hi else start_pos end as bracket_end from k)"""


@query(f"with {_bracketed(False)} select sj_id, isoform, bracket_start, bracket_end from br")
def acceptor_brackets(fx):
    return j.acceptor_brackets(pairs(fx)).select("sj_id", "isoform", "bracket_start", "bracket_end")


@query(f"with {_bracketed(True)} select sj_id, isoform, bracket_start, bracket_end from br")
def acceptor_brackets_closed(fx):
    return j.acceptor_brackets(pairs(fx), closed_left=True).select("sj_id", "isoform", "bracket_start", "bracket_end")


@query(f"""with {_bracketed(False)}, top as (select sample, isoform, bracket_start, bracket_end, read_count, sj_id, row_number() over (partition by sample, isoform, bracket_start, bracket_end order by read_count desc, sj_id) as n from br where canonical)
 select br.sj_id, br.isoform, round(br.read_count / greatest(coalesce(t.read_count, 1), 1), 6) as ratio, coalesce(concat(t.read_count, ' - ', t.sj_id), 'nothing') as max_sj_info from br left join top t on t.n = 1 and t.sample = br.sample and t.isoform = br.isoform and t.bracket_start = br.bracket_start and t.bracket_end = br.bracket_end""".replace("coalesce(concat(t.read_count, ' - ', t.sj_id), 'nothing')", "case when t.sj_id is null then 'nothing' else concat(t.read_count, ' - ', t.sj_id) end"))
def junction_dominance(fx):
    out = j.junction_dominance(j.dominance_rows(fx.junctions, transcripts(fx)), canonical_only=True)
    return out.select("sj_id", "isoform", F.round("ratio", 6).alias("ratio"), "max_sj_info")


@query(f"""with {_bracketed(False)}, a as (select sj_id, string_agg(distinct isoform, ' | ' order by isoform) as iso from {{assigned}} group by 1), top as (select *, row_number() over (partition by sample, isoform, bracket_start, bracket_end order by read_count desc, sj_id) as n from br)
 select br.sj_id, br.isoform, round(br.read_count / greatest(coalesce(t.read_count, 1), 1), 6) as ratio, case when t.sj_id is null then 'nothing' else concat(t.read_count, ' - ', t.sj_id, ' - ', coalesce(a.iso, '')) end as max_sj_info
 from br left join top t on t.n = 1 and t.sample = br.sample and t.isoform = br.isoform and t.bracket_start = br.bracket_start and t.bracket_end = br.bracket_end left join a on a.sj_id = t.sj_id""")
def junction_dominance_assigned(fx):
    rows = j.dominance_rows(fx.junctions, transcripts(fx))
    out = j.junction_dominance(rows, assigned="assigned_isoforms", lists=j.assigned_lists(assigned(fx)))
    return out.select("sj_id", "isoform", F.round("ratio", 6).alias("ratio"), "max_sj_info")


ORACLE_ONLY["gene_introns"] = "select i.gene, i.start_pos as intron_start, i.end_pos as intron_end, count(distinct isoform) >= n.n as constitutive from {introns} i join (select gene, count(distinct isoform) as n from {introns} group by 1) n on n.gene = i.gene group by 1, 2, 3, n.n"
ORACLE_ONLY["gap_support"] = "select sample, gene, gap_start as intron_start, gap_end as intron_end, count(*) filter (nh = 1) as reads from {spans} group by 1, 2, 3, 4"


@query("""with c as (select a.sample, a.gene, i.intron_start, i.intron_end, i.constitutive, coalesce(s.reads, 0) as reads from (select distinct sample, gene from {junctions}) a join {gene_introns} i on i.gene = a.gene left join {gap_support} s on s.sample = a.sample and s.gene = a.gene and s.intron_start = i.intron_start and s.intron_end = i.intron_end),
 r as (select v.sj_id, v.read_count, (select avg(reads) from c where c.sample = v.sample and c.gene = v.gene and v.start_pos < c.intron_end and c.intron_start < v.end_pos) as near, (select avg(reads) from c where c.sample = v.sample and c.gene = v.gene and c.constitutive) as steady from {junctions} v)
 select sj_id, round(case when coalesce(near, 1) <> 0 then read_count / coalesce(near, 1) end, 6) as aberrant_canonical, round(case when coalesce(steady, 1) <> 0 then read_count / coalesce(steady, 1) end, 6) as aberrant_constitutive, round(case when coalesce(steady, 1) <> 0 then coalesce(near, 0) / coalesce(steady, 1) end, 6) as overlap_constitutive from r""")
def junction_evidence_ratios(fx):
    features = g.exon_intron_features(transcripts(fx)).where("feat_type = 'intron'")
    introns = g.constitutive_alternative(features).select(
        "gene", F.col("start_pos").alias("intron_start"), F.col("end_pos").alias("intron_end"), (F.col("kind") == "constitutive").alias("constitutive")
    )
    support = ev.gap_counts(fx.reads).select("sample", "chrom", F.col("start_pos").alias("intron_start"), F.col("end_pos").alias("intron_end"), F.col("unique_count").alias("reads"))
    named = features.select("gene", "chrom", F.col("start_pos").alias("intron_start"), F.col("end_pos").alias("intron_end")).distinct()
    support = support.join(named, ["chrom", "intron_start", "intron_end"]).drop("chrom")
    out = j.junction_evidence_ratios(fx.junctions, introns, support)
    return out.select("sj_id", *[F.round(c, 6).alias(c) for c in ("aberrant_canonical", "aberrant_constitutive", "overlap_constitutive")])


ORACLE_ONLY["presence"] = """select a.sample, a.gene, i.isoform, i.start_pos, i.end_pos, i.num, coalesce(s.reads, -1) as reads, s.reads is not null as present from (select distinct sample, gene from {junctions}) a join {introns} i on i.gene = a.gene
 left join (select sample, gene, start_pos, end_pos, cast(sum(read_count) as bigint) as reads from {junctions} group by 1, 2, 3, 4) s on s.sample = a.sample and s.gene = a.gene and s.start_pos = i.start_pos and s.end_pos = i.end_pos"""


def presence(fx):
    return j.canonical_present_absent(fx.junctions, g.donor_acceptor_sites(transcripts(fx)))


@query("select sample, isoform, start_pos, end_pos, reads, present from {presence}")
def canonical_present_absent(fx):
    return presence(fx).select("sample", "isoform", "start_pos", "end_pos", "reads", "present")


@query("""select sample, isoform, missing, floor((n_exons + 1) * 0.5) > missing and (f or l) as isoform_present from (select p.sample, p.isoform, t.n_exons, count(*) filter (not present) as missing, bool_or(present and num = 1) as f, bool_or(present and num = t.n_exons - 1) as l
 from {presence} p join {tx} t on t.isoform = p.isoform group by 1, 2, 3) q""")
def isoform_present(fx):
    out = j.isoform_present(presence(fx), transcripts(fx), 0.5, 3)
    return out.select("sample", "isoform", "missing", "isoform_present")


_CHAIN = "string_agg(concat(chrom, ':', start_pos, '-', end_pos), ' >> ' order by start_pos)"


@query(f"select isoform, {_CHAIN} as chain, count(*) as junctions from {{introns}} group by 1")
def canonical_transcript(fx):
    df = j.transcript_text(j.canonical_transcript(transcripts(fx)))
    return df.select("isoform", F.col("text_positions").alias("chain"), F.size("chain").alias("junctions"))


ORACLE_ONLY["rebuilt"] = f"""
with {_bracketed(False)}, own as (select distinct sj_id, isoform, chrom, strand, start_pos, end_pos, bracket_start, bracket_end, tx_start, tx_end from br where not canonical),
 ib as (select i.isoform, i.start_pos, i.end_pos, (select max(p.b) from bounds p where p.isoform = i.isoform and p.b < d and not exists (select 1 from bounds z where z.isoform = i.isoform and z.b = d)) as lo, (select min(p.b) from bounds p where p.isoform = i.isoform and p.b > d) as hi from (select *, case when strand > 0 then start_pos else end_pos end as d from {{introns}}) i),
 ic as (select isoform, start_pos, end_pos, case when lo is not null and hi is not null then lo else start_pos end as bs, case when lo is not null and hi is not null then hi else start_pos end as be from ib)
 select o.sj_id, o.isoform, o.chrom, o.strand, i.start_pos, i.end_pos, o.tx_start, o.tx_end from own o join ic i on i.isoform = o.isoform where ({_CODE.replace('a.', 'o.').replace('b.', 'i.')}) = 0 and not (i.bs = o.bracket_start and i.be = o.bracket_end)
 union all select sj_id, isoform, chrom, strand, start_pos, end_pos, tx_start, tx_end from own"""


def rebuilt(fx):
    return j.transcript_with_junction(j.canonical_junction(pairs(fx)).where("not canonical"))


@query(f"select sj_id, isoform, {_CHAIN} as chain from {{rebuilt}} group by 1, 2")
def transcript_with_junction(fx):
    return j.transcript_text(rebuilt(fx)).select("sj_id", "isoform", F.col("text_positions").alias("chain"))


# from the exon at either end of the junction, intron by intron to the end of the isoform
@query("""with recursive walk(sj_id, isoform, down, s, e, edge) as (select sj_id, isoform, true, start_pos, end_pos, a_start from {jx} where a_num is not null union all select sj_id, isoform, false, start_pos, end_pos, b_end from {jx} where b_num is not null
 union all select w.sj_id, w.isoform, w.down, i.start_pos, i.end_pos, case when w.down then f.start_pos else f.end_pos end from walk w join {introns} i on i.isoform = w.isoform and case when w.down then i.end_pos else i.start_pos end = w.edge
  join {feat} f on f.isoform = w.isoform and case when w.down then f.end_pos = i.start_pos else f.start_pos = i.end_pos end),
 steps as (select sj_id, isoform, s, e from walk union select sj_id, isoform, start_pos, end_pos from {jx})
 select sj_id, isoform, string_agg(concat(s, '-', e), ' >> ' order by s, e) as chain from steps group by 1, 2""")
def walked_transcript(fx):
    steps = F.transform("chain", lambda c: F.concat_ws("-", c["start"].cast("string"), c["end"].cast("string")))
    return j.walked_transcript(pairs(fx)).select("sj_id", "isoform", F.array_join(steps, " >> ").alias("chain"))


def _exon_of(p):
    return f"coalesce((select concat('exon_', min(f.num)) from {{feat}} f where f.isoform = i.isoform and {p} between f.start_pos and f.end_pos having min(f.num) is not null), 'None')"


@query(f"select isoform, string_agg(concat({_exon_of('i.start_pos')}, ':', {_exon_of('i.end_pos')}), ' >> ' order by i.start_pos) as text_exons, count(*) as parsed from {{introns}} i group by 1")
def transcript_text(fx):
    df = j.transcript_text(j.canonical_transcript(transcripts(fx)))
    df = j.parse_transcript_text(df.withColumnRenamed("chain", "given"))
    return df.select("isoform", "text_exons", F.size(F.array_intersect("chain", "given")).alias("parsed"))


@query("""with c as (select *, row_number() over (partition by sj_id, isoform order by start_pos) as k, count(*) over (partition by sj_id, isoform) as n, lead(start_pos) over (partition by sj_id, isoform order by start_pos) as nxt from {rebuilt}),
 e as (select c.sj_id, c.isoform, case when start_pos <= tx_start then case when start_pos > tx_start then tx_start else start_pos - 100 end else tx_start end as lo, start_pos as hi from c where k = 1 union all
  select sj_id, isoform, end_pos, nxt from c where k < n union all select sj_id, isoform, end_pos, case when end_pos >= tx_end then case when end_pos < tx_end then tx_end else end_pos + 100 end else tx_end end from c where k = n)
 select e.sj_id, e.isoform, e.lo as exon_start, e.hi as exon_end, f.isoform is not null as canonical_exon from e left join {feat} f on f.isoform = e.isoform and f.start_pos = e.lo and f.end_pos = e.hi where e.lo <> e.hi""")
def exons_from_junctions(fx):
    df = unroll(j.exons_from_junctions(rebuilt(fx)), "x", "implied_exons")
    return df.select("sj_id", "isoform", F.col("x.start").alias("exon_start"), F.col("x.end").alias("exon_end"), F.col("x.canonical").alias("canonical_exon"))


@query(f"""with a as (select *, row_number() over (partition by sample, isoform order by case when strand > 0 then start_pos else -end_pos end, start_pos, end_pos, sj_id) as n from {{assigned}} where not canonical), o as (select * from a where n = 1),
 m as (select o.sample, o.isoform, o.sj_id, i.start_pos, i.end_pos, ({_CODE.replace('a.', 'o.').replace('b.', 'i.')}) > 0 as met, o.strand, case when o.strand > 0 then i.start_pos <= o.start_pos else i.end_pos >= o.end_pos end as up from o join {{introns}} i on i.isoform = o.isoform)
 select o.sample, o.isoform, o.sj_id, coalesce(case when o.strand > 0 then min(m.start_pos) filter (met) else max(m.start_pos) filter (met) end, case when o.strand > 0 then max(m.start_pos) filter (up) else min(m.start_pos) filter (up) end) as canon_start,
 coalesce(case when o.strand > 0 then min(m.end_pos) filter (met) else max(m.end_pos) filter (met) end, case when o.strand > 0 then max(m.end_pos) filter (up) else min(m.end_pos) filter (up) end) as canon_end from o left join m on m.sample = o.sample and m.isoform = o.isoform and m.sj_id = o.sj_id group by o.sample, o.isoform, o.sj_id, o.strand""")
def fiveprime_aberrant_junction(fx):
    out = j.fiveprime_aberrant_junction(assigned(fx), transcripts(fx))
    return out.select("sample", "isoform", "sj_id", "canon_start", "canon_end")


ORACLE_ONLY["edges"] = """select sample, isoform, sj_id, case when strand > 0 then a_num else b_num end as from_exon, case when strand > 0 then b_num else a_num end as to_exon, case when canonical then 0 else 1 end as penalty, n_exons from {assigned} where a_num is not null and b_num is not null"""
ORACLE_ONLY["grown"] = """
with recursive p as (select sample, isoform, n_exons, [sj_id] as path, to_exon as reached, penalty as cost from {edges} where from_exon = 1 and penalty <= 1 union all
 select p.sample, p.isoform, p.n_exons, list_append(p.path, e.sj_id), e.to_exon, p.cost + e.penalty from p join {edges} e on e.sample = p.sample and e.isoform = p.isoform and e.from_exon = p.reached where not list_contains(p.path, e.sj_id) and p.cost + e.penalty <= 1)
 select p.* from p where not exists (select 1 from {edges} e where e.sample = p.sample and e.isoform = p.isoform and e.from_exon = p.reached and not list_contains(p.path, e.sj_id)) or exists (select 1 from {edges} e where e.sample = p.sample and e.isoform = p.isoform and e.from_exon = p.reached and list_contains(p.path, e.sj_id))"""


def paths(fx):
    return j.transcript_paths(j.assigned_edges(fx.junctions, transcripts(fx)), 1)


@query("select sample, isoform, array_to_string(path, '>') as path, reached, cost from {grown}")
def transcript_paths(fx):
    out = paths(fx)
    return out.select("sample", "isoform", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "reached", "cost")


@query("select sample, isoform, array_to_string(path, '>') as path, reached = n_exons as valid from {grown}")
def transcript_validity(fx):
    counts = transcripts(fx).select("isoform", F.size("exons").alias("exon_count"))
    out = j.transcript_validity(paths(fx), counts)
    return out.select("sample", "isoform", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "valid")


# steps around one aberrant junction: it, and every intron of the isoform
ORACLE_ONLY["around"] = """select sj_id, isoform, n_exons, case when strand > 0 then na else nb end as a, case when strand > 0 then nb else na end as b, start_pos as s, end_pos as e, true as own from {mod} where not canonical
 union all select m.sj_id, m.isoform, m.n_exons, i.num, i.num + 1, i.start_pos, i.end_pos, false from {mod} m join {introns} i on i.isoform = m.isoform where not m.canonical"""


@query("""with recursive p as (select sj_id, isoform, n_exons, [{s: s, e: e}] as path, b as reached, own as hit from {around} where a = 1 union all
 select p.sj_id, p.isoform, p.n_exons, list_append(p.path, {s: x.s, e: x.e}), x.b, p.hit or x.own from p join {around} x on x.sj_id = p.sj_id and x.isoform = p.isoform and x.a = p.reached where not list_contains(p.path, {s: x.s, e: x.e})),
 o as (select *, row_number() over (partition by sj_id, isoform order by len(path) desc) as k from p where hit)
 select sj_id, isoform, array_to_string(list_transform(list_sort(path), lambda g: concat(g.s, '-', g.e)), ' >> ') as chain, reached, len(path)::int as junctions from o where k = 1""")
def junction_transcript(fx):
    out = j.junction_transcript(j.canonical_junction(pairs(fx)).where("not canonical"))
    return out.select("sj_id", "isoform", _spans("chain").alias("chain"), "reached", F.size("chain").alias("junctions"))


def _spans(chain):
    return F.array_join(F.transform(chain, lambda g: F.concat(g["start"].cast("string"), F.lit("-"), g["end"].cast("string"))), " >> ")


ORACLE_ONLY["assigned_all"] = """select * from (select *, min(score) over (partition by sj_id) as best from (select * replace (case when canonical then -1 else score end as score) from {aberr}) a) q where score = best"""
ORACLE_ONLY["long_edges"] = """select sample, gene, isoform, n_exons, start_pos, end_pos, min(sj_id) as sj_id, any_value(case when strand > 0 then na else nb end) as from_exon, any_value(case when strand > 0 then nb else na end) as to_exon, any_value(case when canonical then 0 else 1 end) as penalty
 from (select a.*, m.na, m.nb from {assigned_all} a join {mod} m on m.sj_id = a.sj_id and m.isoform = a.isoform where m.na is not null and m.nb is not null) q group by 1, 2, 3, 4, 5, 6"""
_STEP = "{s: x.start_pos, e: x.end_pos, id: x.sj_id}"
ORACLE_ONLY["long_grown"] = f"""
with recursive p as (select sample, gene, isoform, n_exons, [{_STEP}] as path, to_exon as reached, penalty as cost from {{long_edges}} x where from_exon = 1 and penalty <= 1 union all
 select p.sample, p.gene, p.isoform, p.n_exons, list_append(p.path, {_STEP}), x.to_exon, p.cost + x.penalty from p join {{long_edges}} x on x.sample = p.sample and x.isoform = p.isoform and x.from_exon = p.reached where not list_contains(p.path, {_STEP}) and p.cost + x.penalty <= 1)
 select p.* from p where not exists (select 1 from {{long_edges}} x where x.sample = p.sample and x.isoform = p.isoform and x.from_exon = p.reached and not list_contains(p.path, {_STEP})) or exists (select 1 from {{long_edges}} x where x.sample = p.sample and x.isoform = p.isoform and x.from_exon = p.reached and list_contains(p.path, {_STEP}))"""


def long_paths(fx):
    """Chains over stretched exons, of junctions with and without intronic ends; steps as (start, end, sj_id, aberrant)."""
    steps = j.assigned_edges(fx.junctions, transcripts(fx), stretched=True)
    step = F.struct(
        F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.col("sj_id").alias("id"), (F.col("penalty") > 0).alias("aberrant")
    )
    return j.transcript_paths(steps.withColumn("sj_id", step), 1)


def _ids(path):
    return F.array_join(F.transform(path, lambda x: x["id"].cast("string")), ">")


_PATH = "array_to_string(list_transform(path, lambda g: g.id), '>')"


@query(f"select sample, isoform, {_PATH} as path, reached, cost from {{long_grown}}")
def transcript_paths_stretched(fx):
    return long_paths(fx).select("sample", "isoform", _ids("path").alias("path"), "reached", "cost")


@query(f"""select sample, isoform, sj_id, {_PATH} as path from (select p.*, x.sj_id, max(len(p.path)) over (partition by p.sample, p.isoform, x.sj_id) as longest from {{long_grown}} p join {{long_edges}} x on x.sample = p.sample and x.isoform = p.isoform and x.penalty = 1 and list_contains(p.path, {_STEP})) q where len(path) = longest""")
def longest_path_with_junction(fx):
    paths = long_paths(fx)
    # only chains that hold an aberrant junction have a cost; each is asked for by its own aberrant steps
    asked = unroll(paths.where("cost > 0 and sample is not null"), "junction", "path").where("junction.aberrant")
    out = j.longest_with_junction(asked, "junction")
    return out.select("sample", "isoform", F.col("junction.id").alias("sj_id"), _ids("path").alias("path"))


_OF_CHAIN = "select gene, isoform, string_agg(concat(start_pos, '-', end_pos), ' >> ' order by start_pos) as canon from {introns} group by 1, 2"


@query(f"""with c as ({_OF_CHAIN}), p as (select sample, gene, isoform, {_PATH} as path, array_to_string(list_transform(list_sort(path), lambda g: concat(g.s, '-', g.e)), ' >> ') as chain from {{long_grown}})
 select p.sample, p.isoform, p.path, string_agg(c.isoform, ',' order by c.isoform) as matches, coalesce(bool_or(c.isoform = p.isoform), false) as own_match from p left join c on c.gene = p.gene and c.canon = p.chain group by p.sample, p.isoform, p.path""")
def canonical_transcript_matches(fx):
    models = transcripts(fx)
    chain = F.array_sort(F.transform("path", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    chains = long_paths(fx).join(models.select("isoform", "gene"), "isoform").withColumn("chain", chain)
    out = j.canonical_matches(chains, models)
    return out.select("sample", "isoform", _ids("path").alias("path"), F.array_join("matches", ",").alias("matches"), "own_match")


@query("""with u as (select *, min(case when not present then num end) over (partition by sample, isoform) as unseen from {presence})
 select sample, isoform, string_agg(concat(start_pos, '-', end_pos), ' >> ' order by start_pos) as chain, any_value(unseen) is null as complete from u where unseen is null or num < unseen group by 1, 2""")
def canonical_transcript_seen(fx):
    out = j.canonical_chain_seen(presence(fx), transcripts(fx))
    return out.select("sample", "isoform", _spans("chain").alias("chain"), "complete")


@query("""with s as (select sample, isoform, bool_or(coalesce(a_num = 1, false) or coalesce(b_num = 1, false)) as f, bool_or(coalesce(a_num = n_exons, false) or coalesce(b_num = n_exons, false)) as l from {jx} group by 1, 2),
 p as (select p.sample, p.isoform, floor((t.n_exons + 1) * 0.5) > count(*) filter (not p.present) as enough from {presence} p join {tx} t on t.isoform = p.isoform group by p.sample, p.isoform, t.n_exons)
 select p.sample, p.isoform, enough as present_0, enough and coalesce(f, false) as present_1, enough and coalesce(l, false) as present_2, enough and (coalesce(f, false) or coalesce(l, false)) as present_3, enough and coalesce(f, false) and coalesce(l, false) as present_4
 from p left join s on s.sample = p.sample and s.isoform = p.isoform""")
def isoform_present_by_ends(fx):
    out = j.isoform_present_by_ends(presence(fx), transcripts(fx), j.end_support(pairs(fx)), 0.5)
    return out.select("sample", "isoform", *(f"present_{i}" for i in range(5)))


# ---- products of aberrant junctions -----------------------------------------------------------

ORACLE_ONLY["aex"] = """with c as (select *, row_number() over (partition by sj_id, isoform order by start_pos) as k, count(*) over (partition by sj_id, isoform) as n, lead(start_pos) over (partition by sj_id, isoform order by start_pos) as nxt from {rebuilt})
 select * from (select sj_id, isoform, chrom, strand, case when start_pos <= tx_start then start_pos - 100 else tx_start end as lo, start_pos as hi from c where k = 1 union all select sj_id, isoform, chrom, strand, end_pos, nxt from c where k < n
  union all select sj_id, isoform, chrom, strand, end_pos, case when end_pos >= tx_end then end_pos + 100 else tx_end end from c where k = n) q where lo <> hi"""


def _spliced(table, keys, name):
    cols = ", ".join(keys)
    return f"""{name} as (select {cols}, strand, case when strand > 0 then t else reverse(translate(t, 'ACGT', 'TGCA')) end as s from (select {', '.join('x.' + k for k in keys)}, x.strand,
 string_agg(substr(g.seq, cast(greatest(lo - chunk * {CHUNK}, 0) + 1 as bigint), cast(least(hi - chunk * {CHUNK}, {CHUNK}) - greatest(lo - chunk * {CHUNK}, 0) as bigint)), '' order by lo, chunk) as t, count(*) as pieces, sum(least(hi - chunk * {CHUNK}, {CHUNK}) - greatest(lo - chunk * {CHUNK}, 0)) as got, max(x.total) as total
 from (select *, sum(hi - lo) over (partition by {cols}) as total from {table}) x join {{genome}} g on g.chrom = x.chrom and g.chunk between floor(lo / {CHUNK}.0) and floor((hi - 1) / {CHUNK}.0) group by {', '.join('x.' + k for k in keys)}, x.strand) q where got = total)"""


_BEFORE = "(select sum(greatest(0, least(case when y.strand > 0 then {p} - 1 - y.lo else y.hi - {p} end, y.hi - y.lo))) from {t} y where {w})"
ORACLE_ONLY["jn"] = f"""
with cex as (select isoform, chrom, strand, start_pos as lo, end_pos as hi from {{features}}), {_spliced('cex', ['isoform'], 'cseq')}, {_spliced('{aex}', ['sj_id', 'isoform'], 'aseq')},
 k as (select distinct v.sj_id, v.isoform, v.chrom, v.strand, v.start_pos, v.end_pos, case when v.strand > 0 then v.coding_start + 1 else v.coding_end end as first, case when v.strand > 0 then v.start_pos else v.end_pos + 1 end as donor from {{jx}} v where not v.canonical and v.coding_start is not null),
 o as (select k.*, cs.s as mrna, als.s as mrna_alt, cast({_BEFORE.format(p='k.first', t='cex', w='y.isoform = k.isoform')} as bigint) as oc,
  cast(case when exists (select 1 from {{aex}} z where z.sj_id = k.sj_id and z.isoform = k.isoform and z.lo < k.first and k.first <= z.hi) then {_BEFORE.format(p='k.first', t='{aex}', w='y.sj_id = k.sj_id and y.isoform = k.isoform')} end as bigint) as oa,
  cast({_BEFORE.format(p='k.donor', t='{aex}', w='y.sj_id = k.sj_id and y.isoform = k.isoform')} + 1 as bigint) as oj,
  cast((select sum(y.hi - y.lo) - arg_max(y.hi - y.lo, y.strand * y.lo) - 1 from {{aex}} y where y.sj_id = k.sj_id and y.isoform = k.isoform) as bigint) as pend
  from k join cseq cs on cs.isoform = k.isoform join aseq als on als.sj_id = k.sj_id and als.isoform = k.isoform)
 select *, substr(mrna, oc + 1) as cds, substr(mrna_alt, oa + 1) as cds_alt, oj - 1 - oa as v, pend - 50 - oa as bd from o where oa is not null"""
ORACLE_ONLY["jnp"] = f"""select sj_id, isoform, substr(mrna_alt, greatest(oj - 27, 0) + 1, oj - greatest(oj - 27, 0)) as nuc_before, substr(mrna_alt, oj + 1, 27) as nuc_after, {sql_translate('cds')} as po, {sql_translate('cds_alt')} as pa, cds, cds_alt,
 case when v >= 0 and bd >= 0 and v < bd then substr(cds_alt, v - v % 3 + 1, bd - bd % 3 + 3 - (v - v % 3)) end as sens, case when v >= 0 and bd >= 0 then substr(cds_alt, case when v > bd then v - v % 3 else bd - bd % 3 + 3 end + 1) end as irr from {{jn}}"""


def products(fx):
    return jp.aberrant_products(fx.junctions, transcripts(fx), fx.genome, CHUNK)


@query(f"""select sj_id, isoform, nuc_before, nuc_after, coalesce(list_min(list_filter(range(0, least(length(po), length(pa))), lambda i: substr(po, cast(i as bigint) + 1, 1) <> substr(pa, cast(i as bigint) + 1, 1))), -1) as diverged, {sql_translate('sens')} as sensitive_aa, {sql_translate('irr')} as irrelevant_aa,
 position('*' in {sql_translate('sens')}) > 0 as nmd, position('*' in {sql_translate('irr')}) = 0 as nsd from {{jnp}}""")
def junction_neoepitopes(fx):
    return products(fx).select(
        "sj_id", "isoform", "nuc_before", "nuc_after", "diverged", "sensitive_aa", "irrelevant_aa", F.col("bool_NMD").alias("nmd"), F.col("bool_NSD").alias("nsd")
    )


@query(None)
def junction_neoepitope_windows(fx):
    """Altered and original peptides of the differing windows, with the genome range of the window."""
    out = products(fx)
    windows = sequence_ops.peptide_windows(out)
    return windows.select("sj_id", "isoform", "window_range", "window_start", "peptide_alt", "peptide_orig")


_NOTES = "select distinct concat('S', cast(variant_id % 2 as string)) as case_id, concat('I', cast(cast(floor(variant_id / 4.0) as bigint) as string)) as isoform, cds_start - 1 as position, concat(case change_type when 1 then 'insertion ' when 2 then 'deletion ' else 'mutation ' end, alt) as note from {sequences} where cds_start is not null"
_NOTED = "select concat('I', cast(cast(floor(variant_id / 4.0) as bigint) as string)) as isoform, min(concat(cds, 'A')) as cds from {sequences} group by 1"


@query(f"""with e as (select case_id, isoform, codon, string_agg(note, ',' order by note) as n from (select distinct case_id, isoform, cast(floor(position / 3.0) as bigint) as codon, note from ({_NOTES}) q) r group by 1, 2, 3), s as (select p.case_id, t.isoform, t.cds from ({_NOTED}) t left join (select distinct case_id, isoform from ({_NOTES}) m) p on p.isoform = t.isoform),
 c as (select s.case_id, s.isoform, s.cds, i as codon, substr(s.cds, cast(i as bigint) * 3 + 1, 3) as t from s, unnest(range(0, cast(ceil(length(s.cds) / 3.0) as bigint))) u(i))
 select c.case_id, c.isoform, string_agg(concat(t, case when e.n is not null then concat('[', e.n, ']') else '' end), ' ' order by c.codon) as marked_sequence,
 string_agg(concat({sql_translate('t')}, case when e.n is not null then concat('[', e.n, ']') else '' end), '' order by c.codon) filter (length(t) = 3) as marked_protein from c left join e on e.case_id = c.case_id and e.isoform = c.isoform and e.codon = c.codon group by c.case_id, c.isoform""")
def transcript_event_notes(fx):
    out = jp.transcript_event_notes(fx.sql(_NOTED), fx.sql(_NOTES))
    return out.select("case_id", "isoform", "marked_sequence", "marked_protein")


@query("""with dens as (select r.isoform, r.num, r.gene, s.sample, sum(1) * 1e9 as n, r.end_pos - r.start_pos as len from {elements} r join {spans} s on s.chrom = r.chrom and r.start_pos < s.ref_end and s.ref_start < r.end_pos where r.feat_type = 'exon' group by r.isoform, r.num, r.gene, s.sample, r.end_pos - r.start_pos),
 d as (select dens.isoform, dens.num, dens.gene, dens.sample, n / (l.library * len) as density from dens join (select sample, count(*) as library from {reads} group by 1) l on l.sample = dens.sample),
 t as (select x.sj_id, x.sample, x.gene, avg(d.density) as v from {jx} x join {feat} f on f.isoform = x.isoform and f.num > least(x.a_num, x.b_num) and f.num < greatest(x.a_num, x.b_num) join d on d.isoform = f.isoform and d.num = f.num and d.sample = x.sample where x.a_num is not null and x.b_num is not null group by 1, 2, 3),
 b as (select sample, gene, avg(density) as c from d where num = 1 group by 1, 2)
 select t.sj_id, t.sample, t.gene, round(case when coalesce(c, 1) <> 0 then v / coalesce(c, 1) end, 6) as density_ratio from t left join b on b.sample = t.sample and b.gene = t.gene""")
def density_evidence(fx):
    exons = g.exon_intron_features(transcripts(fx)).where("feat_type = 'exon'")
    regions = exons.select(
        F.concat_ws(":", "isoform", F.col("feat_num").cast("string")).alias("region_id"), "gene", "isoform", "feat_num", "chrom", F.col("start_pos").alias("region_start"), F.col("end_pos").alias("region_end")
    )
    dens = ev.read_density(regions, fx.reads, ["region_id", "gene", "isoform", "feat_num"], counted="all_reads").select("sample", "gene", "isoform", "feat_num", "density")
    skipped = j.skipped_by_position(fx.junctions.select("sj_id", "sample", "gene", "start_pos", "end_pos"), transcripts(fx))
    out = j.density_evidence(skipped.join(dens, ["sample", "gene", "isoform", "feat_num"]), dens.where("feat_num = 1"))
    return out.withColumn("density_ratio", F.round("density_ratio", 6))
