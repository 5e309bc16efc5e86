"""Hand-made rows for the rules that are easy to get wrong."""

import math

from pyspark.sql import functions as F

from neoquarry.functions import coding as c
from neoquarry.functions.sequence import reverse_complement, translate_cds
from neoquarry.operators import cohort, junctions, reports, scoring, sequences, variants
from neoquarry.operators.genemodels import pack_transcripts
from neoquarry.plans.intervals import overlap_join


def test_translation(spark):
    df = spark.createDataFrame([("ATGTAAGC",), ("atgNNNTGG",), ("",), (None,), ("AUGUGG",)], "s string")
    assert [r[0] for r in df.select(translate_cds("s")).collect()] == ["M*", "MXW", "", None, "MW"]
    assert df.select(translate_cds("s", True)).first()[0] == "M"
    twice = df.select(reverse_complement(reverse_complement(F.upper("s"))).alias("t"), F.upper("s").alias("u"))
    assert twice.where(~F.col("t").eqNullSafe(F.col("u"))).count() == 0


def test_alterations(spark):
    rows = [
        (1, "ATGAAATTT", 4, 4, "C", False, "ATGCAATTT"), (2, "ATGAAATTT", 4, 6, "", False, "ATGTTT"),
        (3, "ATGAAATTT", 4, 4, "GGG", True, "ATGAGGGAATTT"), (4, "ATGAAATTT", None, 4, "C", False, ""),
        (5, "ATGAAATTT", -2, 4, "C", False, ""), (6, "ATGAAATTT", 8, 12, "C", False, ""),
    ]
    df = spark.createDataFrame(rows, "id int, s string, a int, b int, alt string, ins boolean, want string")
    got = df.withColumn("got", c.apply_alteration("s", "a", "b", "alt", F.col("ins")))
    assert got.where("got <> want").count() == 0


def test_first_codon_is_not_reported(spark):
    df = spark.createDataFrame([("ATGAAATTT", 2, 2, "C"), ("ATGAAATTT", 5, 5, "C")], "s string, a int, b int, alt string")
    before, after = c.marked_codons("s", "a", "b", "alt", F.lit(False))
    assert [tuple(r) for r in df.select(before, after).collect()] == [(None, None), ("aAa", "aCa")]


def test_prefix_proteins_do_not_diverge(spark):
    df = spark.createDataFrame([("MKT", "MKTLL"), ("MKT", "MRT"), ("", "M"), ("mkt", "MKT")], "a string, b string")
    assert [r[0] for r in df.select(c.divergence("a", "b")).collect()] == [-1, 1, -1, -1]


def test_region_past_the_end_drops_the_last_base(spark):
    cds = "ATG" + "GCT" * 10
    alt = "ATG" + "GCT" * 9 + "GAT"
    df = spark.createDataFrame([(cds, alt)], "cds string, cds_alt string")
    r = sequences.altered_region(df).first()
    assert (r["diverged"], r["region_end"]) == (10, -1)
    assert r["region_alt"] == alt[3:-1]


def test_decay(spark):
    alt = "ATG" + "GCT" * 30 + "TAA" + "GCT" * 30
    df = spark.createDataFrame([(alt, 40, 150), (alt, 150, 160), (alt, None, 150), (alt, 40, 0)], "s string, p int, b int")
    assert [r[0] for r in df.select(c.nmd_susceptible("s", "p", "b")).collect()] == [True, False, None, None]
    assert [r[0] for r in df.select(c.nsd_susceptible("s", "p", "b")).collect()] == [None, True, None, None]


def test_flanks(spark):
    df = spark.createDataFrame([("ABCDE", "K/R", "FGHIJ"), ("AB", "K/R", "FGHIJ"), ("ABCDE", "K/X", "F*HIJ")], "b string, ch string, a string")
    out = sequences.flanked_peptide(df, "ch", "b", "a", 3).select("neoep_orig", "neoep_alt").collect()
    assert [tuple(r) for r in out] == [("CDEKFGH", "CDERFGH"), (None, None), ("CDEKF", "CDEF")]


def test_fold_change_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(reports.fold_change("a", "b")).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == 2.0 and got[3] is None


def test_affinity_and_delta(spark):
    df = spark.createDataFrame([(50.0, 1.0, 2.0), (500.1, 2.0, 1.0), (None, None, 1.0), (9000.0, 1.0, 1.0)], "i double, a double, b double")
    got = df.select(scoring.affinity_category("i"), scoring.delta("a", "b"), scoring.delta("a", "b", True)).collect()
    assert [tuple(r) for r in got] == [("HIGH", "higher", "lower"), ("LOW", "lower", "higher"), ("none", "equal", "equal"), ("none", "equal", "equal")]


def test_best_row_keeps_one_on_ties(spark):
    df = spark.createDataFrame([("s", "g", 5.0, 1.0, 2), ("s", "g", 5.0, 3.0, 1)], "case_id string, genome_pos string, mhc_score_2 double, ic50_score_2 double, o int")
    assert [r["o"] for r in cohort.best_row_per_mutation(df, ["o"]).collect()] == [1]


def test_alteration_types(spark):
    df = spark.createDataFrame([("A/G",), ("-/GTT",), ("ACG/-",), ("AC/A",), (None,)], "allele_string string")
    got = [(r["my_change_type"], r["in_frame"]) for r in variants.alteration_type(df).collect()]
    assert got == [("mutation", "inframe"), ("insertion", "inframe"), ("deletion", "inframe"), ("deletion", "frameshift"), (None, "Unknown")]


def _model(spark, strand):
    rows = [("g", "NM_1", "chr1", strand, 1, s, e, max(s, 110), min(e, 340)) for s, e in ((100, 150), (200, 260), (300, 350))]
    return pack_transcripts(spark.createDataFrame(rows, "gene string, isoform string, chrom string, strand int, db int, start_pos int, end_pos int, cds_start int, cds_end int"))


def test_positions_go_back_and_forth(spark):
    for strand in (1, -1):
        df = _model(spark, strand).withColumn("pos", F.explode(F.array(*[F.lit(x) for x in (110, 111, 150, 151, 201, 260, 340, 341)])))
        out = {r["pos"]: (r["cds_position"], r["genome_position"]) for r in sequences.genome_to_cds_position(df).collect()}
        want = {111: 0, 150: 39, 201: 40, 260: 99, 340: 139}
        for pos in (110, 151, 341):
            assert out[pos] == (-1, None)
        for pos, offset in want.items():
            assert out[pos] == (offset if strand > 0 else 139 - offset, pos)


def test_single_coding_segment_has_no_boundary(spark):
    rows = [("g", "NM_1", "chr1", 1, 1, 100, 150, 110, 140), ("g", "NM_1", "chr1", 1, 1, 200, 250, None, None)]
    df = pack_transcripts(spark.createDataFrame(rows, "gene string, isoform string, chrom string, strand int, db int, start_pos int, end_pos int, cds_start int, cds_end int"))
    r = sequences.truncation_boundary(df).first()
    assert (r["relative_boundary"], r["genome_boundary"]) == (None, None)


def test_unplaced_bracket_and_skips(spark):
    models = _model(spark, 1)
    sj = spark.createDataFrame([(1, "s", "g", "chr1", 150, 300, 10), (2, "s", "g", "chr1", 50, 200, 4), (3, "s", "g", "chr1", 150, 200, 9)],
                               "sj_id int, sample string, gene string, chrom string, start_pos int, end_pos int, read_count int")
    pairs = junctions.junction_models(sj, models)
    b = {r["sj_id"]: (r["bracket_start"], r["bracket_end"]) for r in junctions.acceptor_brackets(pairs).collect()}
    assert b == {1: (100, 200), 2: (50, 50), 3: (100, 200)}
    a = {r["sj_id"]: (r["canonical"], r["score"]) for r in junctions.assign_isoforms(pairs, intronic=True).collect()}
    assert a[3] == (True, -1)
    assert a[1][1] == 1 + 100 + (0 if (39 + 1) % 3 == 100 % 3 else 200)
    assert a[2][1] >= 500


def test_overlap_join_has_no_duplicates(spark):
    left = spark.createDataFrame([(i, "c", i * 7, i * 7 + 40) for i in range(60)], "a int, chrom string, s int, e int")
    right = spark.createDataFrame([(i, "c", i * 11, i * 11 + 90) for i in range(40)], "b int, chrom string, rs int, re int")
    got = sorted((r["a"], r["b"]) for r in overlap_join(left, right, ("s", "e"), ("rs", "re"), width=16).collect())
    want = sorted((i, k) for i in range(60) for k in range(40) if i * 7 < k * 11 + 90 and k * 11 < i * 7 + 40)
    assert got == want


def test_p_value(spark):
    rows = [("b", "x", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", "y", v) for v in (2.0, 4.0, 6.0, 9.0)]
    r = cohort.condition_ttest(spark.createDataFrame(rows, "label string, category string, value double"), "x", "y").first()
    assert abs(r["t_statistic"] + 2.75 / math.sqrt((5 + 26.75) / 6 * 0.5)) < 1e-9
    # two tails of the density with 6 degrees of freedom, by the trapezoid rule
    t, n = abs(r["t_statistic"]), 200_000
    density = lambda x: math.gamma(3.5) / (math.sqrt(6 * math.pi) * math.gamma(3)) * (1 + x * x / 6) ** -3.5
    inner = sum(density(t * i / n) for i in range(1, n)) + (density(0) + density(t)) / 2
    assert abs(r["p_value"] - (1 - 2 * inner * t / n)) < 1e-6


def test_preferred_alleles(spark):
    rows = [("P", "HLA-B*02", 3.0), ("P", "HLA-A*01", 3.0), ("P", "HLA-B*02", 3.0), ("P", "HLA-C*07", 1.0), ("Q", "HLA-A*01", None)]
    df = spark.createDataFrame(rows, "peptide_2 string, allele string, mhc_score_2 double")
    short = reports.preferred_hla(df).where("peptide_2 = 'P'").first()
    assert (short["preferred_HLA"], short["preferred_HLA_copies"]) == ("HLA-A*01,HLA-B*02", "1,2")
    assert reports.preferred_hla(df, repeats=True).where("peptide_2 = 'P'").first()["preferred_HLA"] == "HLA-A*01,HLA-B*02,HLA-B*02"
    assert reports.preferred_hla_subgroup(df).where("peptide_2 = 'P'").first()["preferred_HLA_subgroup"] == "HLA-A,HLA-B"


def test_report_keeps_every_row_and_its_layout(spark):
    rows = [("a", 7, "p7"), ("a", 3, "p3"), ("b", 5, "p5"), ("a", None, "none"), (None, 4, "nowhere")]
    df = spark.createDataFrame(rows, "case_id string, place long, peptide_2 string")
    out = variants.report_projection(df, "case_id", "place")
    assert out.columns == ["sample_row", *variants.REPORT_COLUMNS]
    found = {r.altered_peptide: r.sample_row for r in out.collect()}
    assert found == {"p3": "a_0", "p7": "a_1", "p5": "b_0", "none": None, "nowhere": None}


def test_first_hit_in_long_sequences(spark):
    protein = "ACDEFGHIKLMNPQRSTVWY" * 1500
    changed = protein[:15] + "WW" + protein[17:]
    rows = [("p", protein, changed, 15), ("same", "ACDEFGHIKL", "ACDEFGHIKL", -1)]
    df = spark.createDataFrame(rows, "k string, o string, v string, d int").withColumn("n", F.lit(6))
    got = {r[0]: r[1] for r in df.select("k", c.reconvergence("o", "v", "d", "n")).collect()}
    assert got == {"p": 17, "same": -1}


def test_next_equal_window(spark):
    rows = [("again", "A" * 60, "A" * 10 + "C" + "A" * 49, 0), ("never", "AC" * 30, "CA" * 30, 0), ("no start", "A", "A", -1)]
    df = spark.createDataFrame(rows, "k string, o string, v string, s int")
    got = {r[0]: r[1] for r in df.select("k", c.next_equal_window("o", "v", "s")).collect()}
    assert got == {"again": 38, "never": -1, "no start": -1}


def test_longest_orf(spark):
    rows = [
        (1, "ATGATGAAATAGATGCCCAAATAA"), (2, "CATGAAACCC"), (3, "CCC"), (4, ""), (5, "TAAATGTAA"), (6, None),
        (7, "atgaaatag"),
    ]
    df = spark.createDataFrame(rows, "k int, cds string")
    got = sorted((r["k"], r["orf_start"], r["orf_protein"]) for r in sequences.longest_orf(df).collect())
    assert got == [(1, 1, "MMK"), (1, 13, "MPK"), (2, 2, "MKP"), (5, 4, "M"), (7, 1, "MK")]


def test_alterations_of_two_samples_stay_apart(spark):
    edits = spark.createDataFrame(
        [("s1", "I", 1, 1, "C"), ("s1", "I", 1, 1, "C"), ("s2", "I", 3, 1, "T"), ("s2", "I", 3, 1, "G")],
        "case_id string, isoform string, pos int, len int, alt string",
    )
    models = spark.createDataFrame([("I", "AAAA"), ("J", "CC")], "isoform string, cds string")
    got = {r["case_id"]: (r["cds_alt"], r["applied"], len(r["rejected"])) for r in sequences.apply_alterations_multi(edits, models).collect()}
    assert got == {"s1": ("CAAA", 1, 0), "s2": ("AAGA", 1, 1)}


def test_filter_label():
    label = cohort.NeoepitopeFilter(mhc_affinity=5, frame_stat=2).label()
    assert label == (
        "MHC affinity = HIGH ONLY | frame_stat = alteration + read-frame | neoep_stat = all neoeps | Filter NMD = False"
        " | Gene Exp >= -1 | ProtCleav Thres >= -1 | TAP Thres >= -1 | Endogen Freq Thres <= -1"
    )
    assert cohort.NeoepitopeFilter().label().startswith("frame_stat = alteration only | ")


def test_counts_keep_types_outside_the_fixed_lists(spark):
    rows = [("a", "chr1:1-1", "P", "mutation", "inframe"), ("a", "chr1:2-2", "Q", None, "Unknown"), ("a", "chr1:3-3", "R", "fusion.5", "inframe"), ("b", "chr1:4-4", "S", None, None)]
    df = variants.alt_readframe_type(spark.createDataFrame(rows, "case_id string, genome_pos string, peptide_2 string, my_change_type string, in_frame string"))
    for frame_stat, column in cohort.TYPE_COLUMNS.items():
        settings = cohort.NeoepitopeFilter(frame_stat=frame_stat)
        got = {r.case_id: r.asDict() for r in cohort.mutation_counts(df, settings).collect()}
        assert list(got["a"])[1 : 1 + len(cohort.TYPE_VALUES[frame_stat])] == cohort.TYPE_VALUES[frame_stat]
        assert {c: sum(v for v in r.values() if v != c) for c, r in got.items()} == {"a": 3, "b": 1}
        assert got["b"]["null"] == 1
        peptides = {r.case_id: r.asDict() for r in cohort.neoepitope_counts(df, settings).collect()}
        assert peptides == got
        means = {r.case_id: r.asDict() for r in cohort.neoepitope_mean_std(df, settings).collect()}
        assert means["b"]["null:avg"] == 1 and sum(v or 0 for k, v in means["a"].items() if k.endswith(":avg")) == len([v for k, v in got["a"].items() if k != "case_id" and v])


def test_counts_scan_the_input_once_and_keep_samples_without_hits(spark):
    rows = [("S1", "m1", "mutation", "HIGH", "P1"), ("S1", "m1", "mutation", "none", "P2"), ("S2", "m2", "insertion", "none", "P3"),
            (None, "m3", "mutation", "MID", "P4"), ("S1", "m4", "", "MID", "P5"), ("S2", "m5", "deletion", None, "P6")]
    df = spark.createDataFrame(rows, "case_id string, genome_pos string, my_change_type string, aff_cat_2 string, peptide_2 string")
    settings = cohort.NeoepitopeFilter(mhc_affinity=2, frame_stat=0)
    got = {r["case_id"]: r.asDict() for r in cohort.mutation_counts(df, settings).collect()}
    assert {k: v["mutation"] for k, v in got.items()} == {"S1": 1, "S2": 0, None: 1}
    assert {k: v["null"] for k, v in got.items()} == {"S1": 1, "S2": 0, None: 0}
    stats = {r["case_id"]: r.asDict() for r in cohort.neoepitope_mean_std(df, settings).collect()}
    assert stats["S1"]["mutation:avg"] == 1 and stats["S1"]["mutation:std"] == 0 and stats["S2"]["insertion:avg"] is None


def test_preferred_alleles_with_nulls(spark):
    rows = [("P", "B*01:01", 2.0), ("P", "A*01:01", 2.0), ("P", "A*01:01", 2.0), ("P", "C*01:01", 1.0), ("P", "A*02:01", None),
            ("Q", "A*01:01", None), (None, "A*01:01", 1.0)]
    df = spark.createDataFrame(rows, "peptide_2 string, allele string, mhc_score_2 double")
    out = {r["peptide_2"]: (r["preferred_HLA"], r["preferred_HLA_copies"]) for r in reports.preferred_hla(df).collect()}
    assert out == {"P": ("A*01:01,B*01:01", "2,1"), "Q": (None, None), None: (None, None)}
    groups = {r["peptide_2"]: r["preferred_HLA_subgroup"] for r in reports.preferred_hla_subgroup(df).collect()}
    assert groups == {"P": "A,B", "Q": None, None: None}
