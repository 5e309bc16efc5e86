"""Gene fusions and kinase domains.

A fusion row has two sides (``_a``, ``_b``) with chromosome and position, a two-letter orientation and three
read counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as m
from ..plans.intervals import GENE_BIN, overlap_join
from ..plans.rows import unroll
from .evidence import library_size, region_read_counts

COUNTS = ("read_span", "read_mate", "read_break")
# Read support and distance a fusion needs.
MIN_EACH, MIN_BEST, MIN_DISTANCE = 3, 15, 100_000
SIDES = ("a", "b")

SPREAD = 32  # parts over which the genes of an asked id are dealt
TASKS_PER_CORE = 16  # tasks the pairs of asked rows and genes are dealt over, whose rows are many times what a task reads


def fusion_read_filter(df: DataFrame) -> DataFrame:
    """Every count at least 3 and one of them at least 15."""
    counts = [F.col(c).cast("bigint") for c in COUNTS]
    return df.where((F.least(*counts) >= MIN_EACH) & (F.greatest(*counts) >= MIN_BEST))


def isoforms_at(fusions: DataFrame, transcripts: DataFrame, side: str, key: str = "fusion_id", width: int = GENE_BIN) -> DataFrame:
    """(key, gene, isoform, strand) of the isoforms over one break point."""
    points = fusions.select(key, F.col(f"chrom_{side}").alias("chrom"), F.col(f"pos_{side}").alias("_p"))
    spans = transcripts.select("chrom", "gene", "isoform", "strand", "tx_start", "tx_end")
    hits = overlap_join(points, spans, ("_p", "_p"), ("tx_start", "tx_end"), width=width, closed=True)
    return hits.select(key, "gene", "isoform", "strand")


def fusion_viability(fusions: DataFrame, transcripts: DataFrame, key: str = "fusion_id") -> DataFrame:
    """Supported fusions between different genes; on one chromosome the break points lie at least 100000 apart."""
    kept = fusion_read_filter(fusions).where(
        (F.col("chrom_a") != F.col("chrom_b")) | (F.abs(F.col("pos_a") - F.col("pos_b")) >= MIN_DISTANCE)
    )
    genes = [isoforms_at(kept, transcripts, s, key).select(key, "gene").distinct() for s in SIDES]
    return kept.join(genes[0].join(genes[1], [key, "gene"]).select(key).distinct(), key, "left_anti")


def chromosome_number(chrom) -> Column:
    """``chr9``, ``9`` or ``chr9_..._alt`` as 9; null for other names."""
    return F.regexp_extract(F.col(chrom), r"^(?:chr)?([0-9]+)(?:_.*)?$", 1).try_cast("int")


def fusion_order(df: DataFrame) -> DataFrame:
    """Sides in genome order; swapped sides turn ff into rr and back. Unknown chromosomes stay as they are."""
    a, b = chromosome_number("chrom_a"), chromosome_number("chrom_b")
    swap = F.coalesce((a > b) | ((a == b) & (F.col("pos_a") > F.col("pos_b"))), F.lit(False))
    out = {"swapped": swap}
    for name in ("chrom", "pos"):
        out[f"{name}_a"] = F.when(swap, F.col(f"{name}_b")).otherwise(F.col(f"{name}_a"))
        out[f"{name}_b"] = F.when(swap, F.col(f"{name}_a")).otherwise(F.col(f"{name}_b"))
    turned = F.when(F.col("orientation") == "ff", "rr").when(F.col("orientation") == "rr", "ff").otherwise(F.col("orientation"))
    out["orientation"] = F.when(swap, turned).otherwise(F.col("orientation"))
    return df.withColumns(out)


def fusion_pairs(fusions: DataFrame, transcripts: DataFrame, level: str = "isoform", key: str = "fusion_id") -> DataFrame:
    """Isoform (or gene) pairs across the two break points of each fusion."""
    name = ["gene", "isoform"] if level == "isoform" else ["gene"]

    def side(s):
        hits = isoforms_at(fusions, transcripts, s, key).select(key, *name).distinct()
        return hits.select(key, *[F.col(n).alias(f"{n}_{s}") for n in name])

    return side("a").join(side("b"), key)


def fusion_compatibility(df: DataFrame) -> DataFrame:
    known = F.col("strand_a").isNotNull() & F.col("strand_b").isNotNull() & (F.col("strand_a") != 0) & (F.col("strand_b") != 0)
    o = F.lower("orientation")
    agree = (F.col("strand_a") == F.col("strand_b")) == (F.substring(o, 1, 1) == F.substring(o, 2, 1))
    return df.withColumn("compatible", F.when(~known, "Unknown").when(agree, "Yes").otherwise("No"))


def fusion_kinase_status(df: DataFrame, kinase_exons: DataFrame) -> DataFrame:
    """0 no kinase, 1 first gene, 2 second gene, 3 both."""
    genes = kinase_exons.select("gene").distinct()
    out = df
    for s in SIDES:
        out = out.join(genes.select(F.col("gene").alias(f"gene_{s}"), F.lit(True).alias(f"_k{s}")), f"gene_{s}", "left")
    code = F.when(F.col("_ka"), 1).otherwise(0) + F.when(F.col("_kb"), 2).otherwise(0)
    return out.withColumn("kinase_status", code).drop("_ka", "_kb")


def pack_kinase_exons(kinase_exons: DataFrame) -> DataFrame:
    """(isoform, ``domain``): exon number -> domain state, one row per isoform."""
    return kinase_exons.groupBy("isoform").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("exon_num", "state")))).alias("domain")
    )


def fusion_feature(df: DataFrame, transcripts: DataFrame, kinase_exons: DataFrame, side: str) -> DataFrame:
    """Exon or intron at one break point, the place in it, and its kinase-domain state.

    The first gene prefers the exon that ends there in reading direction, the second the one that begins
    there; then any exon, then the intron.
    """
    models = transcripts.select(F.col("isoform").alias(f"isoform_{side}"), "strand", "exons")
    states = pack_kinase_exons(kinase_exons).withColumnRenamed("isoform", f"isoform_{side}")
    rows = df.join(models, f"isoform_{side}").join(states, f"isoform_{side}", "left")
    pos, plus = f"pos_{side}", F.col("strand") > 0
    right, left = (m.choose(m.holding("exons", pos, r), 0) for r in ("exonRight", "exonLeft"))
    edge = F.when(plus, right if side == "a" else left).otherwise(left if side == "a" else right)
    exon = F.coalesce(edge, m.choose(m.holding("exons", pos), 0))
    intron = m.choose(m.holding(m.introns("exons", "strand"), pos), 0)
    shape = lambda kind, e: F.when(
        e.isNotNull(), F.struct(F.lit(kind).alias("kind"), e["num"].alias("num"), m.place(pos, e["start"], e["end"]).alias("place"))
    )
    found = rows.withColumn("_f", F.coalesce(shape("exon", exon), shape("intron", intron)))
    return found.withColumns(
        {
            f"feature_{side}": F.concat("_f.kind", F.lit("_"), F.col("_f.num").cast("string")),
            f"place_{side}": F.col("_f.place"),
            f"domain_{side}": F.try_element_at("domain", F.col("_f.num")),
        }
    ).drop("_f", "strand", "exons", "domain")


def fusion_exons(df: DataFrame, transcripts: DataFrame, side: str) -> DataFrame:
    """Exons of one side, kept or lost by the fusion. The first gene is judged by exon ends, the second by exon starts."""
    models = transcripts.select(F.col("isoform").alias(f"isoform_{side}"), "tx_start", "tx_end", "exons")
    rows = df.join(models, f"isoform_{side}")
    pos = F.col(f"pos_{side}")
    turned = F.lower(F.substring("orientation", 1 if side == "a" else 2, 1)) == "r"
    upper = turned if side == "a" else ~turned
    lo = F.when(upper, pos).otherwise(F.col("tx_start"))
    hi = F.when(upper, F.col("tx_end")).otherwise(pos)
    edge = "_x.end" if side == "a" else "_x.start"
    return unroll(rows, "_x", "exons").select(
        *df.columns, F.lit(side).alias("side"), F.col("_x.num").alias("exon_num"), F.col("_x.start").alias("exon_start"),
        F.col("_x.end").alias("exon_end"), F.col(edge).between(lo, hi).alias("kept"),
    )


def fusion_density(df: DataFrame, transcripts: DataFrame, reads: DataFrame, key: str = "fusion_id") -> DataFrame:
    """Read density over the kept exons of both sides in the fusion's sample; -1 when length or library is 0."""
    exons = [
        fusion_exons(df, transcripts, s).where("kept").select(
            key, "sample", F.col(f"chrom_{s}").alias("chrom"), F.col("exon_start").alias("region_start"), F.col("exon_end").alias("region_end")
        )
        for s in SIDES
    ]
    kept = exons[0].unionByName(exons[1])
    # one count per distinct exon, shared by all fusions that keep it
    place = F.concat_ws(":", "chrom", F.col("region_start").cast("string"), F.col("region_end").cast("string"))
    kept = kept.withColumn("region_id", place)
    regions = kept.select("region_id", "chrom", "region_start", "region_end").distinct()
    counts = region_read_counts(regions, reads, "region_id").select("region_id", "sample", "all_reads")
    totals = kept.join(counts, ["region_id", "sample"], "left").groupBy(key, "sample").agg(
        F.sum(F.coalesce("all_reads", F.lit(0))).alias("reads"), F.sum(F.col("region_end") - F.col("region_start")).alias("length")
    )
    joined = totals.join(library_size(reads), "sample", "left")
    value = F.try_divide(F.lit(1e9) * F.col("reads"), F.col("library") * F.col("length"))
    out = df.select(key, "sample").join(joined, [key, "sample"], "left")
    return out.select(key, "sample", F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("length", F.lit(0)).alias("length"),
                      F.coalesce(value, F.lit(-1.0)).alias("density"))


def kinase_genes_at_position(points: DataFrame, kinase_exons: DataFrame, key: str, width: int = GENE_BIN) -> DataFrame:
    """Kinase genes whose exons span the position."""
    spans = kinase_exons.groupBy("gene", "chrom").agg(F.min("exon_start").alias("gene_start"), F.max("exon_end").alias("gene_end"))
    hits = overlap_join(points.select(key, "chrom", "pos"), spans, ("pos", "pos"), ("gene_start", "gene_end"), width=width, closed=True)
    return hits.select(key, "gene")


def kinase_exon_counts(kinase_exons: DataFrame) -> DataFrame:
    """Per isoform: exons of the kinase domain, and exons before and after it."""
    return kinase_exons.groupBy("gene", "isoform").agg(
        F.count_if(F.col("state") == 0).alias("domain_exons"), F.count_if(F.col("state") == -1).alias("before_domain"),
        F.count_if(F.col("state") == 1).alias("after_domain"),
    )


def kept_kinase_exons(exons: DataFrame, kinase_exons: DataFrame, key: str = "fusion_id") -> DataFrame:
    """Kinase-domain exons inside the kept part of a side (rows of ``fusion_exons``)."""
    domain = kinase_exons.where("state = 0").select("isoform", "exon_num")
    kept = exons.where("kept").join(domain, ["isoform", "exon_num"], "left_semi")
    return kept.groupBy(key, "side").agg(F.count(F.lit(1)).alias("kept_domain_exons"))


def kinase_introns(kinase_exons: DataFrame) -> DataFrame:
    """Introns between neighbouring exons of one isoform's kinase table; an intron carries the state of the exon before it."""
    exon = F.struct("exon_num", "exon_start", "exon_end", "state")
    packed = kinase_exons.groupBy("gene", "isoform", "chrom").agg(F.array_sort(F.collect_set(exon)).alias("_x"))

    falling = F.get("_x", F.lit(0))["exon_start"] > F.element_at("_x", -1)["exon_start"]

    def gap(x, i):
        # on the minus strand the next exon in reading order lies lower
        nxt = F.get(F.col("_x"), i + 1)
        return F.struct(
            x["exon_num"].alias("intron_num"), F.when(falling, nxt["exon_end"]).otherwise(x["exon_end"]).alias("intron_start"),
            F.when(falling, x["exon_start"]).otherwise(nxt["exon_start"]).alias("intron_end"), x["state"].alias("state"),
        )

    inner = F.slice("_x", 1, F.greatest(F.size("_x") - 1, F.lit(0)))
    gaps = F.transform(inner, gap)
    return unroll(packed, "g", gaps).select("gene", "isoform", "g.*")


def id_type(column) -> Column:
    """1 RefSeq, 2 CCDS, 3 UniProt."""
    c = F.upper(F.col(column))
    return F.when(c.startswith("NM_") | c.startswith("NR_"), 1).when(c.startswith("CCDS"), 2).otherwise(3)


def kinase_id_lookup(wanted: DataFrame, kinase_ids: DataFrame, id_column: str = "id") -> DataFrame:
    """Gene of an isoform id of any of the three kinds, and all isoform ids of that gene of the same kind.

    The ids of a gene stay one list until the last step, so the join has a row per asked id and gene. An id may be asked
    often and name many genes: its genes are dealt over ``SPREAD`` parts, an asked row goes to the parts that hold genes of
    its id, and no task holds all pairs of one id. Spark reckons rows made by exploding with the size of those before, so
    both joins of such rows are merge joins: else these would be gathered on the driver and broadcast. Asked rows are
    streamed past the genes of a part. The result grows with asked rows times genes, not with the bytes that a task reads,
    so the number of tasks follows the cores and adaptive execution leaves it as it is.
    """
    stacked = kinase_ids.select(
        "gene", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("id_type"), F.col(c).alias("isoform_id")) for i, c in enumerate(("refseq", "ccds", "uniprot"))])).alias("s")
    ).select("gene", "s.*").where("isoform_id is not null")
    keys = ["id_type", id_column]
    asked = wanted.withColumn("id_type", id_type(id_column))
    own = stacked.where("gene is not null").groupBy("gene", "id_type").agg(F.collect_set("isoform_id").alias("_ids"))
    used = own.withColumn(id_column, F.explode("_ids")).join(asked.select(*keys).distinct(), keys, "left_semi")
    genes = used.withColumn("_part", F.pmod(F.xxhash64("gene"), F.lit(SPREAD)).cast("int"))
    dealt = asked.join(genes.select(*keys, "_part").distinct().hint("merge"), keys)
    place = [*keys, "_part"]
    tasks = TASKS_PER_CORE * wanted.sparkSession.sparkContext.defaultParallelism
    found = dealt.repartition(tasks, *place).join(genes.repartition(tasks, *place).hint("merge"), place)
    rest = [x for x in asked.columns if x not in keys]
    return found.select("gene", *keys, *rest, F.explode("_ids").alias("isoform_id"))


def kinase_domain_kept(df: DataFrame) -> DataFrame:
    """Is the kinase domain part of the fusion? By status, orientation letters and the domain states of both sides."""
    letter = lambda i: F.lower(F.substring("orientation", i, 1))
    low, high = (-1, 0), (0, 1)

    def ok(i, column, forward, reverse):
        state = F.col(column).cast("string").try_cast("int")
        hit = F.when(letter(i) == "f", state.isin(*forward)).when(letter(i) == "r", state.isin(*reverse))
        return F.coalesce(hit, F.lit(False))

    first, second = ok(1, "domain_a", high, low), ok(2, "domain_b", low, high)
    kept = (
        F.when(F.col("kinase_status") == 1, first).when(F.col("kinase_status") == 2, second)
        .when(F.col("kinase_status") == 3, first | second).otherwise(False)
    )
    return df.withColumn("kinase_kept", kept)


def remove_control_fusions(df: DataFrame, controls: list[str], name: str = "fusion_name", unique: tuple[str, ...] = ("line_id", "fusion_id")) -> DataFrame:
    """Drop fusion names seen in control samples, pairs within one gene and repeated lines (the first by gene names stays)."""
    seen = df.where(F.col("sample").isin(controls)).select(name).distinct()
    kept = df.where(~F.col("sample").isin(controls) & (F.col("gene_a") != F.col("gene_b"))).join(seen, name, "left_anti")
    row = F.min_by(F.struct(*kept.columns), F.struct("gene_a", "gene_b", "sample"))
    return kept.groupBy(*unique).agg(row.alias("_row")).select("_row.*")


def position_vs_kinase_domain(df: DataFrame, kinase_exons: DataFrame, position: str = "pos") -> DataFrame:
    """State of the kinase exon with the number of the element at a position; ``no_kinase_domain`` when the table has none.

    Rows carry a gene model. Null outside the transcript.
    """
    exon = m.choose(m.holding("exons", position), 0)["num"]
    intron = m.choose(m.holding(m.introns("exons", "strand"), position), 0)["num"]
    out = df.withColumn("_n", F.coalesce(exon, intron)).join(pack_kinase_exons(kinase_exons), "isoform", "left")
    state = F.try_element_at("domain", F.col("_n")).cast("string")
    return out.withColumn(
        "relative_domain", F.when(F.col("_n").isNotNull(), F.coalesce(state, F.lit("no_kinase_domain")))
    ).drop("_n", "domain")
