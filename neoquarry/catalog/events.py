"""Queries on read evidence, fusions and kinase domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ORACLE_ONLY
from ..operators import evidence as ev
from ..operators import fusions as fu
from ..operators import genemodels as g
from . import query
from .genes import transcripts

# reads as spans, with their gap; every read of the projection is 20 bases, a gap and 30 bases
ORACLE_ONLY["spans"] = """select *, pos - 1 as ref_start, pos + 19 as gap_start, pos + 19 + n as gap_end, pos + 49 + n as ref_end from (select *, cast(regexp_extract(cigar, 'M([0-9]+)N', 1) as bigint) as n from {reads}) q"""
# kinase table: domain state by exon number, for genes of even number
KINASE = """select gene, isoform, chrom, strand, num as exon_num, start_pos as exon_start, end_pos as exon_end, case when num < 2 then -1 when num <= 3 then 0 else 1 end as state from {feat} where pk % 24 < 12"""
ORACLE_ONLY["kinase"] = KINASE


def kinase(fx):
    exons = g.exon_intron_features(transcripts(fx)).where("feat_type = 'exon'")
    state = F.when(F.col("feat_num") < 2, -1).when(F.col("feat_num") <= 3, 0).otherwise(1)
    even = F.pmod(F.substring("gene", 2, 20).cast("bigint"), F.lit(2)) == 0
    return exons.where(even).select(
        "gene", "isoform", "chrom", "strand", F.col("feat_num").alias("exon_num"), F.col("start_pos").alias("exon_start"), F.col("end_pos").alias("exon_end"), state.alias("state")
    )


_PLACES = "(select sj_id, sample, chrom, start_pos, end_pos from {junctions})"


@query(f"""select j.sj_id, coalesce(a, 0) as all_count, coalesce(u, 0) as unique_count, coalesce(t, 0) as unique_count_50, coalesce(d, 0) as distinct_reads from {_PLACES} j left join (
 select sample, chrom, gap_start, gap_end, count(*) as a, count(*) filter (nh = 1) as u, count(*) filter (mapq = 50) as t, count(distinct concat(pos, cigar)) as d from {{spans}} group by 1, 2, 3, 4) s
 on s.sample = j.sample and s.chrom = j.chrom and s.gap_start = j.start_pos and s.gap_end = j.end_pos""")
def junction_read_support(fx):
    out = ev.junction_read_support(fx.junctions, fx.reads)
    return out.select("sj_id", "all_count", "unique_count", "unique_count_50", "distinct_reads")


@query(f"""select j.sj_id, count(s.read_id) as all_count, count(s.read_id) filter (s.mapq = 50) as unique_count from {_PLACES} j left join {{spans}} s on s.sample = j.sample and s.chrom = j.chrom
 and j.start_pos in (s.ref_start, s.gap_start, s.gap_end, s.ref_end) and j.end_pos in (s.ref_start, s.gap_start, s.gap_end, s.ref_end) group by j.sj_id""")
def junction_block_support(fx):
    return ev.junction_block_support(fx.junctions, fx.reads).select("sj_id", "all_count", "unique_count")


def exon_regions(fx):
    return fx.features.select(
        F.col("pk").alias("region_id"), "gene", "isoform", "chrom", F.col("start_pos").alias("region_start"), F.col("end_pos").alias("region_end")
    )


_REGION_HITS = "from {features} r join {spans} s on s.chrom = r.chrom and r.start_pos < s.ref_end and s.ref_start < r.end_pos"


@query(f"""select c.region_id, c.sample, c.all_reads, c.unique_reads, c.multi_reads, c.top_quality_reads, p.pairs from (select r.pk as region_id, s.sample, count(*) as all_reads, count(*) filter (nh = 1) as unique_reads, count(*) filter (nh > 1) as multi_reads, count(*) filter (mapq = 50) as top_quality_reads {_REGION_HITS} group by 1, 2) c
 join (select region_id, sample, count(*) filter (n >= 2) as pairs from (select r.pk as region_id, s.sample, s.mate, count(*) as n {_REGION_HITS} group by 1, 2, 3) q group by 1, 2) p on p.region_id = c.region_id and p.sample = c.sample""")
def region_read_counts(fx):
    counts = ev.region_read_counts(exon_regions(fx), fx.reads, "region_id")
    pairs = ev.region_pair_counts(exon_regions(fx), fx.reads, "region_id")
    return counts.join(pairs, ["region_id", "sample"])


@query("select sample, count(*) as library from {reads} where chrom like 'chr%' group by 1")
def library_size(fx):
    return ev.library_size(fx.reads)


@query(f"""select q.isoform, q.sample, q.reads, l.length, round(1e9 * q.reads / (b.library * l.length), 6) as density from (select r.isoform, s.sample, count(*) filter (nh = 1) as reads {_REGION_HITS} group by 1, 2) q
 join (select isoform, cast(sum(end_pos - start_pos) as bigint) as length from {{features}} group by 1) l on l.isoform = q.isoform join (select sample, count(*) as library from {{reads}} group by 1) b on b.sample = q.sample""")
def read_density(fx):
    out = ev.read_density(exon_regions(fx), fx.reads, ["isoform"])
    return out.select("isoform", "sample", "reads", "length", F.round("density", 6).alias("density"))


@query(f"""with k as (select gene, min(isoform) as isoform from (select gene, isoform, rank() over (partition by gene order by n_exons desc) as k from {{tx}}) q where k = 1 group by 1)
 select k.gene, q.isoform, q.sample, q.reads, l.length, round(1e9 * q.reads / (b.library * l.length), 6) as density from k join (select r.isoform, s.sample, count(*) filter (nh = 1) as reads {_REGION_HITS} group by 1, 2) q on q.isoform = k.isoform
 join (select isoform, cast(sum(end_pos - start_pos) as bigint) as length from {{features}} group by 1) l on l.isoform = q.isoform join (select sample, count(*) as library from {{reads}} group by 1) b on b.sample = q.sample""")
def gene_density(fx):
    out = ev.gene_density(exon_regions(fx), fx.reads, transcripts(fx))
    return out.select("gene", "isoform", "sample", "reads", "length", F.round("density", 6).alias("density"))


@query("select fusion_id, read_span, read_mate, read_break from {fusions} where least(read_span, read_mate, read_break) >= 3 and greatest(read_span, read_mate, read_break) >= 15")
def fusion_read_filter(fx):
    return fu.fusion_read_filter(fx.fusions).select("fusion_id", "read_span", "read_mate", "read_break")


_AT = "(select f.fusion_id, t.gene, t.isoform from {fusions} f join {tx} t on t.chrom = f.chrom_@ and f.pos_@ between t.tx_start and t.tx_end)"
_AT_A, _AT_B = _AT.replace("@", "a"), _AT.replace("@", "b")


@query(f"""select f.fusion_id, f.chrom_a, f.chrom_b, f.pos_a, f.pos_b from {{fusions}} f where least(read_span, read_mate, read_break) >= 3 and greatest(read_span, read_mate, read_break) >= 15 and (chrom_a <> chrom_b or abs(pos_a - pos_b) >= 100000)
 and f.fusion_id not in (select x.fusion_id from {_AT_A} x join {_AT_B} y on y.fusion_id = x.fusion_id and y.gene = x.gene)""")
def fusion_viability(fx):
    return fu.fusion_viability(fx.fusions, transcripts(fx)).select("fusion_id", "chrom_a", "chrom_b", "pos_a", "pos_b")


@query("""select fusion_id, swap as swapped, case when swap then chrom_b else chrom_a end as chrom_a, case when swap then chrom_a else chrom_b end as chrom_b, case when swap then pos_b else pos_a end as pos_a, case when swap then pos_a else pos_b end as pos_b,
 case when swap and orientation = 'ff' then 'rr' when swap and orientation = 'rr' then 'ff' else orientation end as orientation from (select *, cast(substr(chrom_a, 4) as int) > cast(substr(chrom_b, 4) as int) or (chrom_a = chrom_b and pos_a > pos_b) as swap from {fusions}) q""")
def fusion_order(fx):
    return fu.fusion_order(fx.fusions).select("fusion_id", "swapped", "chrom_a", "chrom_b", "pos_a", "pos_b", "orientation")


@query(f"select x.fusion_id, x.gene as gene_a, x.isoform as isoform_a, y.gene as gene_b, y.isoform as isoform_b from {_AT_A} x join {_AT_B} y on y.fusion_id = x.fusion_id")
def fusion_pairs(fx):
    return fu.fusion_pairs(fx.fusions, transcripts(fx))


@query("select fusion_id, case when sa is null then 'Unknown' when (sa = strand_b) = (substr(orientation, 1, 1) = substr(orientation, 2, 1)) then 'Yes' else 'No' end as compatible from (select *, case when fusion_id % 10 = 0 then null else strand_a end as sa from {fusions}) q")
def fusion_compatibility(fx):
    df = fx.fusions.withColumn("strand_a", F.when(F.col("fusion_id") % 10 != 0, F.col("strand_a")))
    return fu.fusion_compatibility(df).select("fusion_id", "compatible")


_STATUS = "case when gene_a in (select gene from {kinase}) then 1 else 0 end + case when gene_b in (select gene from {kinase}) then 2 else 0 end"


@query(f"select fusion_id, {_STATUS} as kinase_status from {{fusions}}")
def fusion_kinase_status(fx):
    return fu.fusion_kinase_status(fx.fusions, kinase(fx)).select("fusion_id", "kinase_status")


def _feature_sql(s):
    edge = "f.strand > 0" if s == "a" else "f.strand < 0"
    return f"""(select fusion_id, feature, place, state from (select u.fusion_id, concat(f.feat_type, '_', f.num) as feature, case when u.pos_{s} = f.start_pos then 'exonLeft' when u.pos_{s} = f.end_pos then 'exonRight' else 'withinElem' end as place, k.state,
 row_number() over (partition by u.fusion_id order by f.feat_type, case when u.pos_{s} = case when {edge} then f.end_pos else f.start_pos end then 0 else 1 end, f.start_pos) as n
 from {{fusions}} u join {{elements}} f on f.isoform = u.isoform_{s} and u.pos_{s} between f.start_pos and f.end_pos left join {{kinase}} k on k.isoform = f.isoform and k.exon_num = f.num) q where n = 1)"""


@query(f"select f.fusion_id, a.feature as feature_a, a.place as place_a, a.state as domain_a, b.feature as feature_b, b.place as place_b, b.state as domain_b from {{fusions}} f left join {_feature_sql('a')} a on a.fusion_id = f.fusion_id left join {_feature_sql('b')} b on b.fusion_id = f.fusion_id")
def fusion_feature(fx):
    df = fu.fusion_feature(fx.fusions, transcripts(fx), kinase(fx), "a")
    df = fu.fusion_feature(df, transcripts(fx), kinase(fx), "b")
    return df.select("fusion_id", "feature_a", "place_a", "domain_a", "feature_b", "place_b", "domain_b")


ORACLE_ONLY["fexons"] = """select f.fusion_id, f.sample, 'a' as side, x.chrom, x.isoform, x.num as exon_num, x.start_pos as exon_start, x.end_pos as exon_end, case when substr(orientation, 1, 1) = 'r' then x.end_pos between f.pos_a and t.tx_end else x.end_pos between t.tx_start and f.pos_a end as kept
 from {fusions} f join {feat} x on x.isoform = f.isoform_a join {tx} t on t.isoform = x.isoform union all
 select f.fusion_id, f.sample, 'b', x.chrom, x.isoform, x.num, x.start_pos, x.end_pos, case when substr(orientation, 2, 1) = 'r' then x.start_pos between t.tx_start and f.pos_b else x.start_pos between f.pos_b and t.tx_end end
 from {fusions} f join {feat} x on x.isoform = f.isoform_b join {tx} t on t.isoform = x.isoform"""


@query("select fusion_id, side, exon_num, exon_start, exon_end, kept from {fexons}")
def fusion_exons(fx):
    both = [fu.fusion_exons(fx.fusions, transcripts(fx), s).select("fusion_id", "side", "exon_num", "exon_start", "exon_end", "kept") for s in "ab"]
    return both[0].union(both[1])


@query("""with c as (select r.chrom, r.start_pos, r.end_pos, s.sample, count(*) as n from (select distinct chrom, start_pos, end_pos from {features}) r join {spans} s on s.chrom = r.chrom and r.start_pos < s.ref_end and s.ref_start < r.end_pos group by 1, 2, 3, 4),
 t as (select x.fusion_id, cast(sum(coalesce(c.n, 0)) as bigint) as reads, cast(sum(x.exon_end - x.exon_start) as bigint) as length from {fexons} x left join c on c.chrom = x.chrom and c.start_pos = x.exon_start and c.end_pos = x.exon_end and c.sample = x.sample where x.kept group by 1)
 select f.fusion_id, f.sample, coalesce(t.reads, 0) as reads, coalesce(t.length, 0) as length, round(coalesce(1e9 * t.reads / (l.library * t.length), -1), 6) as density from {fusions} f left join t on t.fusion_id = f.fusion_id left join (select sample, count(*) as library from {reads} group by 1) l on l.sample = f.sample""")
def fusion_density(fx):
    out = fu.fusion_density(fx.fusions, transcripts(fx), fx.reads)
    return out.withColumn("density", F.round("density", 6))


@query("select v.variant_id, k.gene from {variants} v join (select gene, chrom, min(exon_start) as s, max(exon_end) as e from {kinase} group by 1, 2) k on k.chrom = v.chrom and v.pos between k.s and k.e")
def kinase_genes_at_position(fx):
    return fu.kinase_genes_at_position(fx.variants, kinase(fx), "variant_id")


@query("""select c.isoform, c.domain_exons, c.before_domain, c.after_domain, i.n as introns, i.len as intron_bases, coalesce(k.n, 0) as kept_domain from (select isoform, count(*) filter (state = 0) as domain_exons, count(*) filter (state = -1) as before_domain, count(*) filter (state = 1) as after_domain from {kinase} group by 1) c
 join (select isoform, count(*) as n, cast(sum(end_pos - start_pos) as bigint) as len from {introns} group by 1) i on i.isoform = c.isoform left join (select x.isoform, count(*) as n from {fexons} x join {kinase} k on k.isoform = x.isoform and k.exon_num = x.exon_num where x.kept and k.state = 0 group by 1) k on k.isoform = c.isoform""")
def kinase_exons(fx):
    table = kinase(fx)
    counts = fu.kinase_exon_counts(table).drop("gene")
    gaps = fu.kinase_introns(table).groupBy("isoform").agg(
        F.count(F.lit(1)).alias("introns"), F.sum(F.col("intron_end") - F.col("intron_start")).alias("intron_bases")
    )
    exons = [fu.fusion_exons(fx.fusions, transcripts(fx), s).withColumn("isoform", F.col(f"isoform_{s}")) for s in "ab"]
    kept = fu.kept_kinase_exons(exons[0].unionByName(exons[1]).withColumn("side", F.col("isoform")), table, "isoform")
    return counts.join(gaps, "isoform").join(kept.select("isoform", F.col("kept_domain_exons").alias("kept_domain")), "isoform", "left").na.fill(0, ["kept_domain"])


_IDS = "select distinct gene, isoform as refseq, case when pk % 3 = 0 then concat('CCDS', cast(pk % 40 as string)) end as ccds, concat('P', cast(pk % 50 as string)) as uniprot from {features}"
_ASK = "select s_suppkey as ask_id, case when s_suppkey % 3 = 0 then concat('CCDS', cast(s_suppkey % 40 as string)) when s_suppkey % 3 = 1 then concat('P', cast(s_suppkey % 50 as string)) else concat('NM_', cast(s_suppkey % 16 as string), '.1') end as id from {supplier}"


@query(f"""with s as (select distinct gene, 1 as id_type, refseq as isoform_id from ({_IDS}) q union select distinct gene, 2, ccds from ({_IDS}) q where ccds is not null union select distinct gene, 3, uniprot from ({_IDS}) q)
 select a.ask_id, a.id, a.id_type, s.gene, r.isoform_id from (select *, case when id like 'NM%' then 1 when id like 'CCDS%' then 2 else 3 end as id_type from ({_ASK}) q) a join s on s.id_type = a.id_type and s.isoform_id = a.id join s r on r.gene = s.gene and r.id_type = s.id_type""")
def kinase_id_lookup(fx):
    return fu.kinase_id_lookup(fx.sql(_ASK), fx.sql(_IDS)).select("ask_id", "id", "id_type", "gene", "isoform_id")


_STATES = "select fusion_id, orientation, case when fusion_id % 7 = 0 then '?' else cast(fusion_id % 3 - 1 as string) end as domain_a, cast(read_span % 3 - 1 as string) as domain_b, cast(read_mate % 4 as int) as kinase_status from {fusions}"


@query(f"""select fusion_id, case kinase_status when 1 then a when 2 then b when 3 then a or b else false end as kinase_kept from (select *, case substr(orientation, 1, 1) when 'f' then domain_a in ('0', '1') else domain_a in ('-1', '0') end as a,
 case substr(orientation, 2, 1) when 'f' then domain_b in ('-1', '0') else domain_b in ('0', '1') end as b from ({_STATES}) q) r""")
def kinase_domain_kept(fx):
    return fu.kinase_domain_kept(fx.sql(_STATES)).select("fusion_id", "kinase_kept")


_NAMED = "select fusion_id, read_span as line_id, sample, gene_a, gene_b, concat(gene_a, '-', gene_b, '-', cast(read_mate % 3 as string)) as fusion_name from {fusions}"


@query(f"select fusion_id, line_id, sample, gene_a, gene_b from (select *, row_number() over (partition by line_id, fusion_id order by gene_a, gene_b, sample) as n from ({_NAMED}) q where sample not in ('S0', 'S1') and gene_a <> gene_b and fusion_name not in (select fusion_name from ({_NAMED}) c where sample in ('S0', 'S1'))) r where n = 1")
def remove_control_fusions(fx):
    return fu.remove_control_fusions(fx.sql(_NAMED), ["S0", "S1"]).select("fusion_id", "line_id", "sample", "gene_a", "gene_b")


@query("""select point_id, case when num is not null then coalesce(cast(state as varchar), 'no_kinase_domain') end as relative_domain from (select p.point_id, e.num, k.state, row_number() over (partition by p.point_id order by e.feat_type, e.start_pos) as n
 from {points} p left join {elements} e on e.isoform = p.isoform and p.pos between e.start_pos and e.end_pos left join {kinase} k on k.isoform = p.isoform and k.exon_num = e.num) q where n = 1""")
def position_vs_kinase_domain(fx):
    from .genes import pointed

    return fu.position_vs_kinase_domain(pointed(fx), kinase(fx)).select("point_id", "relative_domain")
