"""Projections of the given tables onto the schemas the operators read.

Every text runs unchanged in Spark SQL and in the checking database. ``{name}`` stands for a given table or
for another projection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .plans.rows import pinned
from .session import spread

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

PROJECTIONS = {
    # original and altered peptide scores, with repeated peptides and tied scores
    "compare": """
select concat('S', cast(l_suppkey % 12 as string)) as case_id,
 concat('chr', cast(1 + l_partkey % 22 as string), ':', cast(l_orderkey as string), '-', cast(l_orderkey as string)) as genome_pos,
 concat('GENE', cast(l_partkey % 40 as string)) as gene_symbol,
 concat('HLA-', substring('ABC', 1 + cast(l_linenumber % 3 as int), 1), '*0', cast(1 + l_linenumber % 5 as string), ':01') as allele,
 substring(translate(md5(concat('o', cast(l_partkey as string))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, 9) as peptide_1,
 substring(translate(md5(concat(case when l_linenumber = 7 then 'o' else 'm' end, cast(l_partkey as string))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, 9) as peptide_2,
 l_extendedprice / 10 as ic50_score_1, l_quantity * l_quantity * 4 as ic50_score_2,
 -l_extendedprice / 10 as mhc_score_1, -(l_quantity * l_quantity * 4) as mhc_score_2,
 l_discount as proteasome_score_1, l_tax as proteasome_score_2, l_tax as tap_score_1, l_discount as tap_score_2,
 cast(floor(l_discount * 1000) as int) as proteasome_percentile_2, cast(floor(l_tax * 1200) as int) as tap_percentile_2,
 cast(l_partkey % 101 as int) as express_percentile, cast(l_partkey % 3 as int) as pep_matches_2,
 case l_returnflag when 'A' then 'mutation' when 'N' then 'insertion' else 'deletion' end as my_change_type,
 case l_linestatus when 'O' then 'inframe' else 'frameshift' end as in_frame,
 case when l_suppkey % 5 = 0 then 'True' when l_suppkey % 5 = 1 then 'None' else 'False' end as bool_nmd,
 l_orderkey as order_key, l_linenumber as line_number
 from {lineitem}""",
    # gene x condition values, some zero
    "expression": """
select p_brand as condition, concat(p_name, ' ', cast(p_partkey as string)) as gene_name, cast(p_partkey as bigint) as gene_id,
 case when p_size % 7 = 0 then 0.0 else p_retailprice end as express from {part}""",
    # coding sequences with one alteration
    "sequences": """
select o_orderkey as variant_id, concat('S', cast(o_custkey % 12 as string)) as case_id,
 concat('ATG', translate(md5(concat('a', cast(o_orderkey as string))), '0123456789abcdef', 'ACGTACGTACGTACGT'), translate(md5(concat('b', cast(o_orderkey as string))), '0123456789abcdef', 'ACGTACGTACGTACGT'), translate(md5(concat('c', cast(o_orderkey as string))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 'TAA') as cds,
 case when o_custkey % 97 = 0 then null else 4 + cast(o_custkey % 60 as int) end as cds_start,
 case when o_custkey % 97 = 0 then null when o_orderkey % 3 = 2 then 4 + cast(o_custkey % 60 as int) + cast(o_custkey % 5 as int) else 4 + cast(o_custkey % 60 as int) end as cds_end,
 cast(o_orderkey % 3 as int) as change_type,
 case when o_orderkey % 3 = 2 then '' when o_orderkey % 3 = 1 then substring('ACGTT', 1, 1 + cast(o_custkey % 5 as int)) else substring('ACGT', 1 + cast(o_custkey % 4 as int), 1) end as alt,
 case when o_orderkey % 2 = 0 then 1 else -1 end as gene_strand,
 cast(40 + o_custkey % 30 as int) as boundary, cast(90 + o_custkey % 30 as int) as penultimate_end
 from {orders}""",
    # exons of four-exon isoforms, three isoforms to a gene, on both strands
    "features": """
select pk, concat('G', cast(g as string)) as gene, concat(case when g % 5 = 0 and i = 2 then 'NR_' else 'NM_' end, cast(g as string), '.', cast(i as string)) as isoform,
 concat('chr', cast(1 + g % 22 as string)) as chrom, case when g % 2 = 0 then 1 else -1 end as strand, cast(1 + g % 4 as int) as db, start_pos, end_pos,
 case when g % 5 = 0 and i = 2 then null else start_pos + case when j = 0 then 30 else 0 end end as cds_start,
 case when g % 5 = 0 and i = 2 then null else end_pos - case when j = 3 then 30 else 0 end end as cds_end
 from (select pk, g, i, j, base + case when p_size % 13 = 0 then 6 else 0 end as start_pos,
   base + 90 + 3 * ((g + j) % 20) + case when p_size % 7 = 0 then -9 when p_size % 11 = 0 then 4 else 0 end as end_pos
  from (select pk, g, i, j, p_size, 1000 + 10000 * cast(floor(g / 22.0) as bigint) + 400 * j as base
   from (select p_partkey as pk, cast(floor(p_partkey / 12.0) as bigint) as g, cast(floor(p_partkey / 4.0) as bigint) % 3 as i, p_partkey % 4 as j, p_size from {part}) q0) q1) q2""",
    # junctions on those exons: exact, skipping, cutting into an exon or ending in an intron
    "junctions": """
select o.sj_id, o.sample, a.gene, a.isoform as source_isoform, a.chrom, a.strand, a.end_pos + o.shift_start as start_pos, b.start_pos + o.shift_end as end_pos,
 a.end_pos + o.shift_start - 25 - o.sj_id % 60 as leftmost, b.start_pos + o.shift_end + 25 + o.sj_id % 70 as rightmost, o.read_count
 from (select o_orderkey as sj_id, concat('S', cast(o_custkey % 12 as string)) as sample,
   4 * cast(floor((o_orderkey % (select count(*) from {part})) / 4.0) as bigint) + o_custkey % 3 as pk_a,
   4 * cast(floor((o_orderkey % (select count(*) from {part})) / 4.0) as bigint) + case when o_orderkey % 4 = 1 and o_custkey % 3 < 2 then o_custkey % 3 + 2 else o_custkey % 3 + 1 end as pk_b,
   case when o_orderkey % 7 = 2 then -5 else 0 end as shift_start, case when o_orderkey % 7 = 3 then -20 when o_orderkey % 7 = 4 then 5 else 0 end as shift_end,
   cast(floor(o_totalprice / 1000) as bigint) as read_count from {orders}) o
 join {features} a on a.pk = o.pk_a join {features} b on b.pk = o.pk_b""",
    # gapped alignments over neighbouring exons
    "reads": """
select e.read_id, e.sample, a.gene, a.chrom, a.end_pos - 20 + 1 as pos,
 concat('20M', cast(b.start_pos - a.end_pos as string), 'N30M') as cigar, e.mapq, e.nh, e.mate
 from (select event_id as read_id, concat('S', cast(user_id % 12 as string)) as sample,
   4 * cast(floor((event_id % (select count(*) from {part})) / 4.0) as bigint) + user_id % 3 as pk_a, 4 * cast(floor((event_id % (select count(*) from {part})) / 4.0) as bigint) + user_id % 3 + 1 as pk_b,
   case when event_type = 'error' then 3 else 50 end as mapq, case when event_type = 'error' then 2 else 1 end as nh, cast(floor(event_id / 2.0) as bigint) as mate
   from {events}) e
 join {features} a on a.pk = e.pk_a join {features} b on b.pk = e.pk_b""",
    # fusion calls between exon ends, and within one gene
    "fusions": """
select o.fusion_id, o.sample, a.chrom as chrom_a, b.chrom as chrom_b, a.end_pos - o.fusion_id % 3 as pos_a, b.start_pos + o.fusion_id % 4 as pos_b, a.gene as gene_a, b.gene as gene_b,
 a.isoform as isoform_a, b.isoform as isoform_b, a.strand as strand_a, b.strand as strand_b, o.orientation, o.read_span, o.read_mate, o.read_break
 from (select o_orderkey as fusion_id, concat('S', cast(o_custkey % 12 as string)) as sample, o_orderkey % (select count(*) from {part}) as pk_a, (o_custkey * 7 + case when o_custkey % 9 = 0 then 0 else 50 end + o_orderkey) % (select count(*) from {part}) as pk_b,
   case when o_orderkey % 4 = 0 then 'ff' when o_orderkey % 4 = 1 then 'fr' when o_orderkey % 4 = 2 then 'rf' else 'rr' end as orientation,
   cast(o_custkey % 40 as int) as read_span, cast(o_orderkey % 31 as int) as read_mate, cast((o_custkey + o_orderkey) % 23 as int) as read_break
   from {orders}) o
 join {features} a on a.pk = o.pk_a join {features} b on b.pk = o.pk_b""",
    # genome pieces of 2048 bases under the genes
    "genome": """
select chrom, chunk, substring(repeat(translate(md5(concat(chrom, ':', cast(chunk as string))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 64), 1, 2048) as seq
 from (select distinct chrom, cast(floor(p / 2048.0) as bigint) as chunk from (select chrom, start_pos as p from {features} union all select chrom, end_pos as p from {features}) u) c""",
    # single-base variants inside exons
    "variants": """
select o.variant_id, o.case_id, a.gene, a.isoform, a.chrom, a.strand as gene_strand, a.start_pos + 1 + o.offset_base % (a.end_pos - a.start_pos) as pos, substring('ACGT', 1 + cast(o.variant_id % 4 as int), 1) as alt
 from (select o_orderkey as variant_id, concat('S', cast(o_custkey % 12 as string)) as case_id, o_orderkey % (select count(*) from {part}) as pk, o_custkey as offset_base from {orders}) o
 join {features} a on a.pk = o.pk""",
    # proteins; half of each holds the altered peptides of the comparison when ids meet
    "proteome": """
select s_suppkey as protein_id, concat('P', cast(s_suppkey as string)) as accession,
 concat(translate(md5(concat('p', cast(s_suppkey as string))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), translate(md5(concat('m', cast(s_suppkey as string))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS')) as protein from {supplier}""",
}

# Flat forms only the checking SQL needs.
ORACLE_ONLY = {
    "feat": """
select f.*, case when strand > 0 then rn else n - rn + 1 end as num, n as n_exons,
 case when cds_start is null then -1 else cast(coalesce(cum, 0) % 3 as bigint) end as frame, cast(coalesce(cum, 0) as bigint) as cds_offset
 from (select f.*, row_number() over (partition by isoform order by start_pos) as rn, count(*) over (partition by isoform) as n,
   sum(cds_end - cds_start) over (partition by isoform order by strand * start_pos rows between unbounded preceding and 1 preceding) as cum from {features} f) f""",
    "introns": """
select gene, isoform, chrom, strand, db, end_pos as start_pos, nxt as end_pos, case when strand > 0 then rn else n - rn end as num
 from (select *, lead(start_pos) over (partition by isoform order by start_pos) as nxt, row_number() over (partition by isoform order by start_pos) as rn,
   count(*) over (partition by isoform) as n from {features}) q where nxt is not null""",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", text)))


class Fixtures:
    """Projections of one folder of tables as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in BASE_TABLES:
                frame = spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
            else:
                frame = self.sql(PROJECTIONS[name])
                if name == "sequences":
                    # a stored column in real tables: compute it once per row, not once per use
                    frame = pinned(frame, {"cds": frame["cds"]})
            self._frames[name] = frame
        return self._frames[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})


def oracle(text: str) -> str:
    """Turn ``{name}`` references into leading WITH clauses."""
    chain: dict[str, str] = {}

    def visit(body: str) -> str:
        for name in _names(body):
            if name in BASE_TABLES:
                body = body.replace("{%s}" % name, name)
                continue
            if name not in chain:
                inner = visit({**PROJECTIONS, **ORACLE_ONLY}[name])
                chain[name] = inner
            body = body.replace("{%s}" % name, f"fx_{name}")
        return body

    main = visit(text)
    clauses = [f"fx_{n} as ({b})" for n, b in chain.items()]
    if not clauses:
        return main
    body = main.lstrip()
    if body[:5].lower() == "with ":
        head, rest = body[:5], body[5:]
        if rest.lower().startswith("recursive "):
            return "with recursive " + ", ".join(clauses) + ", " + rest[10:]
        return head + ", ".join(clauses) + ", " + rest
    return "with " + ", ".join(clauses) + " " + main
