"""Queries on gene models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ORACLE_ONLY
from ..functions import models as m
from ..operators import genemodels as g
from . import query

# exons and introns in one flat table, as the checking SQL sees them
ORACLE_ONLY["elements"] = """
select gene, isoform, chrom, strand, db, 'exon' as feat_type, num, start_pos, end_pos, frame from {feat}
union all select gene, isoform, chrom, strand, db, 'intron', num, start_pos, end_pos, null from {introns}"""
ORACLE_ONLY["tx"] = "select gene, isoform, chrom, strand, db, min(start_pos) as tx_start, max(end_pos) as tx_end, min(cds_start) as coding_start, max(cds_end) as coding_end, count(*) as n_exons from {features} group by 1, 2, 3, 4, 5"
# positions around exon edges of every isoform
POINTS = """select pk as point_id, gene, isoform, chrom, start_pos + case when pk % 5 = 0 then 0 when pk % 5 = 1 then end_pos - start_pos when pk % 5 = 2 then 40 when pk % 5 = 3 then end_pos - start_pos + 30 else -60 end as pos from {features}"""
ORACLE_ONLY["points"] = POINTS


def transcripts(fx):
    return g.pack_transcripts(fx.features)


def points(fx):
    return fx.sql(POINTS)


def pointed(fx):
    return g.attach_models(points(fx), transcripts(fx).drop("gene", "chrom"))


_PLACE = "case when p.pos = e.start_pos then 'exonLeft' when p.pos = e.end_pos then 'exonRight' else 'withinElem' end"
_HIT = "from {points} p join {elements} e on e.isoform = p.isoform and p.pos between e.start_pos and e.end_pos"


@query("select gene, isoform, chrom, strand, db, feat_type, num as feat_num, start_pos, end_pos, frame from {elements}")
def exon_intron_features(fx):
    return g.exon_intron_features(transcripts(fx))


@query("select gene, isoform, chrom, strand, num as feat_num, start_pos as exon_start, end_pos as exon_end, cds_start, cds_start + 1 as cds_start_1, cds_end from {feat} where cds_start is not null")
def cds_segments(fx):
    return g.cds_segments(transcripts(fx))


@query("""select isoform, coding_start, coding_end, case when strand > 0 then coding_start else coding_end end as start_codon, case when strand > 0 then tx_start else tx_end end as tss,
 coding_start - tx_start as utr_left, tx_end - coding_end as utr_right from {tx}""")
def coding_boundaries(fx):
    return g.coding_boundaries(transcripts(fx)).select("isoform", "coding_start", "coding_end", "start_codon", "tss", "utr_left", "utr_right")


@query("""select distinct v.variant_id, t.gene, t.isoform, t.db from (select variant_id, chrom, pos - 300 as s, pos + 200 as e from {variants}) v join {tx} h on h.chrom = v.chrom and v.s < h.tx_end and h.tx_start < v.e join {tx} t on t.gene = h.gene and t.db = h.db""")
def isoforms_by_position(fx):
    spans = fx.variants.select("variant_id", "chrom", (F.col("pos") - 300).alias("start_pos"), (F.col("pos") + 200).alias("end_pos"))
    return g.isoforms_by_position(spans, transcripts(fx)).select("variant_id", "gene", "isoform", "db")


@query("select v.variant_id, 'id' as lookup, t.isoform, t.tx_start from {variants} v join {tx} t on t.isoform = v.isoform union all select v.variant_id, 'gene', t.isoform, t.tx_start from {variants} v join {tx} t on t.gene = v.gene")
def isoforms_by_id_or_gene(fx):
    v, t = fx.variants.select("variant_id", "isoform", "gene"), transcripts(fx)
    by_id = g.isoforms_by_id(v.drop("gene"), t, first=True).withColumn("lookup", F.lit("id"))
    by_gene = g.isoforms_by_gene(v.drop("isoform"), t).withColumn("lookup", F.lit("gene"))
    cols = ["variant_id", "lookup", "isoform", "tx_start"]
    return by_id.select(*cols).union(by_gene.select(*cols))


# every isoform placed twice: as it is, and shifted by 90 bases on a second copy
ORACLE_ONLY["placed"] = """select isoform, chrom, start_pos, end_pos, 0 as shift from {features} union all select isoform, chrom, start_pos + 90, end_pos + 90, 90 from {features}"""


@query("""select point_id, isoform, chrom, pos, tx_chrom, tx_start, tx_end, distance from (select q.*, row_number() over (partition by point_id order by case when spans then 0 else 1 end, distance, tx_chrom, tx_start) as n
 from (select p.point_id, p.isoform, p.chrom, p.pos, t.chrom as tx_chrom, min(start_pos) as tx_start, max(end_pos) as tx_end, p.chrom = t.chrom and p.pos between min(start_pos) and max(end_pos) as spans,
   case when p.chrom = t.chrom and p.pos between min(start_pos) and max(end_pos) then min(least(abs(start_pos - p.pos), abs(end_pos - p.pos))) end as distance
  from {points} p join {placed} t on t.isoform = p.isoform group by 1, 2, 3, 4, 5, t.shift) q) r where n = 1""")
def closest_isoform_variant(fx):
    t = transcripts(fx)
    moved = F.transform("exons", lambda e: e.withField("start", e["start"] + 90).withField("end", e["end"] + 90))
    copies = t.unionByName(t.withColumns({"exons": moved, "tx_start": F.col("tx_start") + 90, "tx_end": F.col("tx_end") + 90}))
    asked = points(fx).withColumn("isoform", F.concat("isoform", F.lit("_alt1")))
    return g.closest_isoform_variant(asked.select("point_id", "isoform", "chrom", "pos"), copies, "point_id")


_XREF = {
    "refseq_ucsc": "select isoform as refseq, concat('uc', cast(pk % 150 as string)) as ucsc from {features}",
    "ucsc_transcript": "select distinct concat('uc', cast(pk % 150 as string)) as ucsc, concat('T', cast(pk % 60 as string)) as transcript from {features}",
    "transcript_gene": "select distinct concat('T', cast(pk % 60 as string)) as transcript, concat('E', cast(pk % 20 as string)) as ens_gene from {features}",
}


@query(f"""with a as ({_XREF['refseq_ucsc']}), b as ({_XREF['ucsc_transcript']}), c as ({_XREF['transcript_gene']}),
 j as (select v.variant_id, a.refseq, a.ucsc, b.transcript, c.ens_gene from {{variants}} v join (select refseq, min(ucsc) as ucsc from a group by 1) a on a.refseq = v.isoform
  join (select ucsc, min(transcript) as transcript from b group by 1) b on b.ucsc = a.ucsc join (select transcript, min(ens_gene) as ens_gene from c group by 1) c on c.transcript = b.transcript)
 select j.*, c.transcript as isoform from j join c on c.ens_gene = j.ens_gene""")
def map_gene_ids(fx):
    tables = [fx.sql(q) for q in _XREF.values()]
    wanted = fx.variants.select("variant_id", F.col("isoform").alias("refseq"))
    return g.map_gene_ids(wanted, *tables)


@query("select gene, chrom, min(tx_start) as start_pos, max(tx_end) as end_pos from {tx} group by 1, 2")
def gene_range(fx):
    return g.gene_range(transcripts(fx))


@query("""with v as (select cast(floor(pk / 40.0) as bigint) as locus, case when strand > 0 and pk % 3 = 0 then null else strand end as strand, gene from {features})
 select l.locus, coalesce(s.strand, 5) as mode_strand, n.gene as mode_symbol from (select distinct locus from v) l
 left join (select locus, strand, row_number() over (partition by locus order by count(*) desc, strand) as k from v where strand is not null group by 1, 2) s on s.locus = l.locus and s.k = 1
 left join (select locus, gene, row_number() over (partition by locus order by count(*) desc, gene) as k from v group by 1, 2) n on n.locus = l.locus and n.k = 1""")
def gene_mode_strand_symbol(fx):
    rows = fx.sql("select cast(floor(pk / 40.0) as bigint) as locus, case when strand > 0 and pk % 3 = 0 then null else strand end as strand, gene from {features}")
    return g.gene_mode_strand_symbol(rows)


_PREV = "select gene, feat_type, chrom, start_pos, end_pos, count(distinct isoform) as isoforms from {elements} group by 1, 2, 3, 4, 5"


@query(_PREV)
def element_prevalence(fx):
    return g.element_prevalence(g.exon_intron_features(transcripts(fx)))


@query(f"select p.*, t.n as gene_isoforms, case when isoforms >= n then 'constitutive' else 'alternative' end as kind from ({_PREV}) p join (select gene, count(distinct isoform) as n from {{elements}} group by 1) t on t.gene = p.gene")
def constitutive_alternative(fx):
    return g.constitutive_alternative(g.exon_intron_features(transcripts(fx)))


_OVER = "from (select sj_id, gene, start_pos - 30 as s, end_pos + 30 as e from {junctions}) j join (select distinct gene, start_pos, end_pos from {elements} where feat_type = 'exon') x on x.gene = j.gene and j.s < x.end_pos and x.start_pos < j.e"


def _ranges(fx):
    return fx.junctions.select("sj_id", "gene", (F.col("start_pos") - 30).alias("start_pos"), (F.col("end_pos") + 30).alias("end_pos"))


@query(f"""select j.sj_id, j.gene, x.start_pos as elem_start, x.end_pos as elem_end, 'local' as mode {_OVER} union all
 select l.sj_id, l.gene, y.start_pos, y.end_pos, 'longest' from (select j.sj_id, j.gene, x.start_pos, x.end_pos, row_number() over (partition by j.sj_id order by x.end_pos - x.start_pos desc, x.start_pos) as n {_OVER}) l
 join (select distinct gene, start_pos, end_pos from {{elements}} where feat_type = 'exon') y on y.gene = l.gene and l.start_pos < y.end_pos and y.start_pos < l.end_pos where l.n = 1""")
def overlapping_elements(fx):
    features = g.exon_intron_features(transcripts(fx))
    near = g.overlapping_elements(_ranges(fx), features, "sj_id").withColumn("mode", F.lit("local"))
    wide = g.overlapping_elements(_ranges(fx), features, "sj_id", local=False).withColumn("mode", F.lit("longest"))
    return near.unionByName(wide)


@query("select gene, isoform, n_exons as exon_count from (select *, rank() over (partition by gene order by n_exons desc) as k from {tx}) q where k = 1")
def longest_isoform(fx):
    return g.longest_isoform(transcripts(fx)).select("gene", "isoform", "exon_count")


@query(f"""select point_id, feat_type, num, start_pos, end_pos, place, feat_type = 'exon' and place = 'withinElem' as strict from (select p.point_id, e.feat_type, e.num, e.start_pos, e.end_pos, {_PLACE} as place,
 row_number() over (partition by p.point_id, e.feat_type order by -e.strand * e.start_pos) as n {_HIT}) q where n = 1""")
def containing_element(fx):
    rows = pointed(fx)
    parts = []
    for kind in ("exon", "intron"):
        one = g.containing_element(rows, kind, direction=1).where("element is not null")
        strict = m.holding(g.elements_of(kind), "pos", "withinElem") if kind == "exon" else F.array()
        parts.append(one.select(
            "point_id", F.lit(kind).alias("feat_type"), "element.num", F.col("element.start").alias("start_pos"), F.col("element.end").alias("end_pos"),
            m.place("pos", F.col("element.start"), F.col("element.end")).alias("place"), (F.size(strict) > 0).alias("strict"),
        ))
    return parts[0].union(parts[1])


@query(f"""select point_id, isoform, pos, label from (select p.point_id, p.isoform, p.pos, case when e.isoform is null then null else concat(e.feat_type, ': ', {_PLACE}) end as label,
 row_number() over (partition by p.point_id order by e.feat_type, e.start_pos) as n {_HIT.replace('join {elements}', 'left join {elements}')}) q where n = 1""")
def containing_element_label(fx):
    return pointed(fx).select("point_id", "isoform", "pos", g.element_label().alias("label"))


@query("""select point_id, side, num, start_pos, end_pos from (select *, row_number() over (partition by point_id, side order by gap nulls last, start_pos) as n from (
 select p.point_id, s.side, e.num, e.start_pos, e.end_pos, case when s.side = -1 and e.end_pos <= p.pos then p.pos - e.end_pos when s.side = 1 and e.start_pos >= p.pos then e.start_pos - p.pos
  when s.side = 0 then least(abs(e.start_pos - p.pos), abs(e.end_pos - p.pos)) end as gap
 from {points} p join {elements} e on e.isoform = p.isoform and e.feat_type = 'exon', (values (-1), (0), (1)) s(side)) q) r where n = 1""")
def closest_element(fx):
    rows = pointed(fx)
    parts = [
        g.closest_element(rows, "exon", side=s).select(
            "point_id", F.lit(s).alias("side"), "element.num", F.col("element.start").alias("start_pos"), F.col("element.end").alias("end_pos")
        )
        for s in (-1, 0, 1)
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("""with hit as (select p.point_id, p.isoform, p.pos, min(e.start_pos) filter (feat_type = 'exon') as xs, min(e.end_pos) filter (feat_type = 'exon') as xe,
  min(e.start_pos) filter (feat_type = 'intron') as gs, min(e.end_pos) filter (feat_type = 'intron') as ge, max(strand) as strand from {points} p join {elements} e on e.isoform = p.isoform and p.pos between e.start_pos and e.end_pos group by 1, 2, 3),
 s as (select h.point_id, h.strand, case when xs is not null then l.start_pos else gs end as ls, case when xs is not null then l.end_pos else ge end as le, case when xs is not null then r.start_pos else gs end as rs, case when xs is not null then r.end_pos else ge end as re
  from hit h left join {introns} l on l.isoform = h.isoform and l.end_pos = h.xs left join {introns} r on r.isoform = h.isoform and r.start_pos = h.xe)
 select p.point_id, case when strand > 0 then le else rs end as acceptor, case when strand > 0 then rs else le end as donor from {points} p left join s on s.point_id = p.point_id""")
def adjacent_splice_sites(fx):
    out = g.adjacent_splice_sites(pointed(fx))
    return out.select("point_id", "acceptor", "donor")


@query("select gene, isoform, chrom, strand, db, num as feat_num, start_pos, end_pos, case when strand > 0 then start_pos else end_pos end as donor, case when strand > 0 then end_pos else start_pos end as acceptor from {introns}")
def donor_acceptor_sites(fx):
    return g.donor_acceptor_sites(transcripts(fx))
