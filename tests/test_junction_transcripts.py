"""Transcripts around junctions, end support and readers, on hand-made genes of both strands."""

import pytest
from pyspark.sql import functions as F

from neoquarry.operators import evidence, junctions
from neoquarry.operators.genemodels import pack_transcripts
from neoquarry.sources import readers

EXONS = [(100, 200), (300, 400), (500, 600), (700, 800)]


@pytest.fixture(scope="module")
def models(spark):
    rows = []
    for gene, isoform, strand, exons, coding in (
        ("P", "P.1", 1, EXONS, True), ("P", "P.2", 1, [EXONS[0], EXONS[2], EXONS[3]], True),
        ("M", "M.1", -1, EXONS, True), ("N", "N.1", 1, EXONS[:2], False),
    ):
        rows += [(gene, isoform, "chr1", strand, 1, a, b, a if coding else None, b if coding else None) for a, b in exons]
    return pack_transcripts(spark.createDataFrame(rows, "gene string, isoform string, chrom string, strand int, db int, start_pos long, end_pos long, cds_start long, cds_end long")).cache()


def made(spark, models, rows):
    """(sj_id, gene, start, end) as junction x isoform rows of one sample."""
    schema = "sj_id long, sample string, gene string, chrom string, start_pos long, end_pos long, read_count long"
    df = spark.createDataFrame([(i, "S", g, "chr1", a, b, 10 * i) for i, g, a, b in rows], schema)
    return junctions.junction_models(df, models.drop("chrom"))


def spans(chain):
    return [(x.start, x.end) for x in chain]


def test_transcript_around_one_junction(spark, models):
    rows = [
        (1, "P", 200, 500),  # skips exon 2
        (2, "P", 250, 500),  # starts in an intron: exon 1 is longer
        (3, "P", 350, 370),  # inside exon 2
        (4, "P", 600, 900),  # ends behind the gene
        (5, "P", 50, 300),  # begins before it
        (6, "M", 400, 700),  # skips exon 3 of 4 counted from the other end
    ]
    out = junctions.junction_transcript(made(spark, models, rows).where("isoform in ('P.1', 'M.1')"))
    got = {r.sj_id: (spans(r.chain), r.reached) for r in out.collect()}
    assert got == {
        1: ([(200, 500), (600, 700)], 4), 2: ([(250, 500), (600, 700)], 4),
        3: ([(200, 300), (350, 370), (400, 500), (600, 700)], 4), 4: ([(200, 300), (400, 500), (600, 900)], None),
        6: ([(200, 300), (400, 700)], 4),
    }


def test_stretched_exons_carry_chains_on(spark, models):
    rows = [(1, "P", 250, 300), (2, "P", 400, 500), (3, "P", 600, 700), (4, "P", 400, 500)]
    df = junctions.canonical_junction(made(spark, models, rows).where("isoform = 'P.1'"))
    plain = junctions.transcript_paths(junctions.transcript_edges(df), 1)
    assert plain.count() == 0
    steps = junctions.transcript_edges(junctions.collapsed(df), stretched=True)
    paths = junctions.transcript_paths(steps, 1)
    # the repeated record of one position is one step
    assert [(r.path, r.reached, r.cost) for r in paths.collect()] == [([1, 2, 3], 4, 1)]
    asked = junctions.junction_has_exon_modified(df.where("sj_id = 1").withColumn("asked", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))))
    assert [(r.asked, r.has_exon, r.has_start, r.has_end) for r in asked.orderBy("asked").collect()] == [(1, True, True, False), (2, True, False, True), (3, False, False, False)]


def test_chain_identity(spark, models):
    chains = spark.createDataFrame(
        [(1, "P", "P.1", [(200, 300), (400, 500), (600, 700)]), (2, "P", "P.1", [(200, 500), (600, 700)]), (3, "P", "P.1", [(600, 700), (200, 500)]), (4, "M", "M.1", []), (5, "P", "P.2", None)],
        "id int, gene string, isoform string, chain array<struct<start: long, end: long>>",
    )
    got = {r.id: (r.matches, r.own_match) for r in junctions.canonical_matches(chains, models).collect()}
    assert got == {1: (["P.1"], True), 2: (["P.2"], False), 3: (None, False), 4: (None, False), 5: (None, False)}


def test_canonical_chain_seen_and_end_support(spark, models):
    rows = [(1, "M", 600, 700), (2, "M", 200, 300), (3, "P", 150, 450)]
    df = made(spark, models, rows)
    presence = junctions.canonical_present_absent(
        df.select("sample", "gene", "chrom", "start_pos", "end_pos", "read_count").distinct(),
        junctions.canonical_transcript(models).select("gene", "isoform", "chrom", F.explode("chain").alias("g")).select("gene", "isoform", "chrom", F.col("g.start").alias("start_pos"), F.col("g.end").alias("end_pos")),
    )
    seen = {r.isoform: (spans(r.chain), r.complete) for r in junctions.canonical_chain_seen(presence, models).collect()}
    # of a gene read from the right, the first intron is the last one; the third is missing
    assert seen == {"M.1": ([(600, 700)], False)}
    support = {r.isoform: (r.first_met, r.last_met) for r in junctions.end_support(df).collect()}
    assert support == {"M.1": (True, True), "P.1": (True, False), "P.2": (True, False)}
    modes = junctions.isoform_present_by_ends(presence, models, junctions.end_support(df), 0.9)
    got = {r.isoform: [r[f"present_{i}"] for i in range(5)] for r in modes.collect()}
    assert got["M.1"] == [True] * 5 and got["P.1"] == [True, True, False, True, False]


def test_prevalence_of_coding_genes(spark, models):
    df = spark.createDataFrame([("A", "chr1", 1, 2, "P", 5), ("B", "chr1", 1, 2, "P", 5), ("A", "chr1", 3, 4, "N", 5)], "sample string, chrom string, start_pos long, end_pos long, gene string, read_count long")
    every = junctions.junction_sample_prevalence(df, ["B"])
    coding = junctions.junction_sample_prevalence(df, ["B"], transcripts=models)
    assert every.count() == 2 and [tuple(r) for r in coding.collect()] == [("chr1", 1, 2, "P", 2, 1)]


def test_gene_density_takes_the_longest_isoform(spark, models):
    regions = spark.createDataFrame([(1, "P.1", "chr1", 100, 200), (2, "P.2", "chr1", 100, 200), (3, "P.1", "chr1", 300, 400)], "region_id long, isoform string, chrom string, region_start long, region_end long")
    reads = spark.createDataFrame([(1, "S", "chr1", 101, "50M", 50, 1, 1), (2, "S", "chr1", 350, "50M", 50, 1, 2)], "read_id long, sample string, chrom string, pos long, cigar string, mapq int, nh int, mate long")
    got = [(r.gene, r.isoform, r.reads, r.length) for r in evidence.gene_density(regions, reads, models).collect()]
    assert got == [("P", "P.1", 2, 200)]


def test_maf_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("written today\nA\tB\n1\tx\nwritten yesterday\ty\n")
    (tmp_path / "b.txt").write_text("written yesterday\nB\tA\tC\nz\t2\tq\nB\tA\n\t3\n")
    (tmp_path / "c.txt").write_text("#version\n#more\nA\tB\n4\tw\n#note\n")
    got = readers.read_maf(spark, str(tmp_path), "A string, B string")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("1", "x"), ("written yesterday", "y"), ("2", "z"), ("A", "B"), ("3", None), ("4", "w")], key=str)


def test_walk_both_ways(spark, models):
    rows = [
        (1, "P", 200, 500), (2, "P", 250, 500), (3, "P", 350, 370), (4, "P", 600, 900), (5, "P", 50, 60), (6, "M", 400, 700),
        (7, "P", None, 500), (8, "P", 200, 300),
    ]
    out = junctions.walked_transcript(made(spark, models, rows).where("isoform in ('P.1', 'M.1')"))
    got = {r.sj_id: r.chain and spans(r.chain) for r in out.collect()}
    assert got == {
        1: [(200, 500), (600, 700)], 2: [(250, 500), (600, 700)],  # no arm below: the start lies in an intron
        3: [(200, 300), (350, 370), (400, 500), (600, 700)], 4: [(200, 300), (400, 500), (600, 900)], 5: [(50, 60)],
        6: [(200, 300), (400, 700)], 7: None, 8: [(200, 300), (400, 500), (600, 700)],
    }
    assert junctions.walked_transcript(made(spark, models, rows).limit(0)).count() == 0


def test_positions_are_classified_once(spark, models):
    rows = [(i, f"S{i % 3}", "P" if i % 2 else "M", *((200, 500), (195, 500), (250, 300), (200, 300))[i % 4], i) for i in range(40)]
    rows += [(90, "S0", None, 200, 300, 1), (91, "S0", "none", 200, 300, 1), (92, "S0", "P", None, None, 1)]
    records = spark.createDataFrame(rows, "sj_id long, sample string, gene string, start_pos long, end_pos long, read_count long")
    pairs = junctions.junction_models(records, models)
    shown = ["sj_id", "sample", "isoform", "score", "canonical", "exon_start", "exon_end", "rf_start", "rf_end", "effects"]
    key = lambda df, names: sorted(map(str, df.where("sj_id < 90").select(*names).collect()))
    for intronic in (False, True):
        apart = junctions.assign_isoforms(pairs, intronic=intronic)
        assert key(junctions.assigned_junctions(records, models, intronic), shown) == key(apart, shown)
    # records that meet no gene model, or have no position, give no row
    assert junctions.assigned_junctions(records, models, True).where("sj_id >= 90").count() == 0
    shown = ["sj_id", "isoform", "ratio", "max_sj_info"]
    told = junctions.junction_dominance(junctions.dominance_rows(records, models), canonical_only=True)
    plain = junctions.junction_dominance(junctions.canonical_junction(pairs), canonical_only=True)
    assert key(told, shown) == key(plain, shown)


def test_no_exon_array_behind_the_classification(spark, models):
    plan = junctions.assigned_junctions(spark.range(1).selectExpr("id as sj_id", "'P' as gene", "200L as start_pos", "300L as end_pos"), models)
    assert "exons" not in plan.columns and "effects" in plan.columns
