"""Junctions of many samples at one position: gene models, sequences and steps are worked out once, with the same rows."""

import random

from pyspark.sql import functions as F

from neoquarry.functions.sequence import codon_table, translate_cds
from neoquarry.operators import genemodels, junction_products, junctions, sequences
from neoquarry.session import FINE, tune


def model(spark):
    rows = [("G", iso, "chr1", 1, 1, s, e, s + (10 if k == 0 else 0), e) for iso, shift in (("A", 0), ("B", 6)) for k, (s, e) in enumerate([(100, 160), (200 + shift, 260), (300, 360 + shift)])]
    rows += [("H", "C", "chr1", -1, 1, s, e, s, e) for s, e in [(1100, 1190), (1300, 1390), (1500, 1590)]]
    return genemodels.pack_transcripts(spark.createDataFrame(rows, "gene string, isoform string, chrom string, strand int, db int, start_pos long, end_pos long, cds_start long, cds_end long"))


def records(spark):
    spots = [("G", 160, 200), ("G", 160, 300), ("G", 155, 206), ("G", 260, 300), ("G", 262, 300), ("H", 1190, 1300), ("H", 1190, 1495), ("H", 1390, 1500), ("G", None, 300)]
    rows = [(n * 10 + s, f"S{s}", *spots[n % len(spots)], 5 + n) for s in range(3) for n in range(9)]
    rows += [(500, "S0", "G", 160, 300, 3), (500, "S0", "H", 1190, 1495, 4), (None, "S1", "G", 160, 300, 3), (501, None, "G", 160, 300, 3), (502, "S2", None, 160, 300, 3)]
    out = spark.createDataFrame(rows, "sj_id long, sample string, gene string, start_pos long, end_pos long, read_count long")
    return out.coalesce(1).withColumn("chrom", F.lit("chr1"))


def told(df):
    return sorted(map(str, df.coalesce(1).select(sorted(df.columns)).collect()))


def runs(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_positions_equal_those_of_records(spark):
    tx, recs = model(spark), records(spark)
    columns = ["sample", "isoform", "sj_id", "from_exon", "to_exon", "penalty", "exon_count"]
    for wide in (False, True):
        plain = junctions.assign_isoforms(junctions.junction_models(recs, tx), intronic=wide)
        plain = junctions.transcript_edges(junctions.collapsed(plain) if wide else plain, wide)
        by_place = junctions.assigned_edges(recs, tx, wide)
        assert "exons" not in by_place.columns
        found = told(by_place.select(columns))
        assert found == told(plain.select(columns)) and len(found) > 20


def test_products_of_positions_equal_those_of_records(spark):
    tx, recs = model(spark), records(spark)
    draw = random.Random(5)
    genome = spark.createDataFrame([("chr1", i, "".join(draw.choice("ACGT") for _ in range(256))) for i in range(8)], "chrom string, chunk long, seq string")
    chains = junctions.transcript_with_junction(junctions.canonical_junction(junctions.junction_models(recs, tx)).where("not canonical"))
    plain = junction_products.junction_neoepitopes(chains, tx, genome, 256)
    by_place = junction_products.aberrant_products(recs, tx, genome, 256)
    columns = ["sj_id", "isoform", "nuc_before", "nuc_after", "diverged", "window_range", "AA_alt_STOP", "AA_orig_full", "sensitive_aa", "irrelevant_aa", "bool_NMD", "bool_NSD"]
    found = told(by_place.select(columns))
    assert found == told(plain.select(columns)) and len(found) > 20


def test_skipped_exons_by_position(spark):
    tx, recs = model(spark), records(spark)
    columns = ["sj_id", "sample", "gene", "isoform", "feat_num"]
    plain = junctions.missing_exons(junctions.junction_models(recs, tx)).where("missing_kind = 'skipped'").withColumnRenamed("missing_num", "feat_num")
    by_place = junctions.skipped_by_position(recs, tx)
    found = told(by_place.select(columns))
    assert found == told(plain.select(columns)) and found


def test_codons_are_read_as_numbers(spark):
    draw, table = random.Random(7), codon_table()
    texts = ["", "A", "ATGNNN", "atgUAA", "0123", "AT+", " TT", "1 2", "T-1", "4.2", "é12ATG", None] + list(table)
    texts += ["".join(draw.choice("ACGTUacgtN019 +-.") for _ in range(draw.randrange(40))) for _ in range(300)]

    def plain(s):
        s = None if s is None else s.upper().replace("U", "T")
        return None if s is None else "".join(table.get(s[i:i + 3], "X") for i in range(0, len(s) - 2, 3))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2).withColumn("p", translate_cds("t"))
    assert "str_to_map" not in runs(df) and "try_element_at" not in runs(df)
    assert {r["i"]: r["p"] for r in df.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_kept_proteins_give_the_same_windows(spark):
    draw = random.Random(9)
    rows = []
    for i in range(200):
        a = "".join(draw.choice("ACGT") for _ in range(draw.randrange(120)))
        at = draw.randrange(len(a) + 1)
        rows.append((i, a, a[:at] + draw.choice(["", "A", "CCC"]) + a[at + draw.randrange(4):]))
    df = spark.createDataFrame(rows, "id int, cds string, cds_alt string")
    names = ["id", "AA_orig_full", "AA_alt_full", "AA_orig_STOP", "AA_alt_STOP"]
    kept, plain = (sequences.comparative_neoepitopes(sequences.altered_region(df, keep_proteins=k)).select(names) for k in (True, False))
    assert told(kept) == told(plain)


def test_fine_settings_come_and_go(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    tune(spark, fine=True)
    tune(spark, fine=True)
    assert {k: spark.conf.get(k) for k in FINE} == FINE
    tune(spark)
    assert spark.conf.get(key) in (before, "134217728b") and spark.conf.get(key) != FINE[key]


def test_dominance_looks_lists_up_for_winners_and_places_positions_once(spark):
    tx, recs = model(spark), records(spark)
    recs = recs.union(recs.where("sj_id = 31").selectExpr("sj_id", "sample", "gene", "260 as start_pos", "300 as end_pos", "read_count", "chrom"))
    lists = junctions.assigned_lists(junctions.assigned_junctions(recs, tx))
    rows = junctions.dominance_rows(recs, tx)
    columns = ["sj_id", "sample", "isoform", "start_pos", "end_pos", "ratio", "max_sj_info"]
    carried = junctions.junction_dominance(rows.join(lists, "sj_id", "left"), assigned="assigned_isoforms").select(columns)
    looked_up = junctions.junction_dominance(rows, assigned="assigned_isoforms", lists=lists).select(columns)
    plain = junctions.acceptor_brackets(junctions.canonical_junction(junctions.junction_models(recs.where("start_pos is not null"), tx)))
    plain = junctions.junction_dominance(plain.join(lists, "sj_id", "left"), assigned="assigned_isoforms").select(columns)
    found = told(looked_up)
    assert found == told(carried) == told(plain) and len(found) > 20
    assert any("nothing" in r for r in found) and any(" | " in r for r in found)
    # introns and acceptors are listed per isoform, below the join with the positions, and a filter on one reading of the
    # rows does not part it from the other
    text = runs(looked_up)
    listed = [line for line in text.splitlines() if "Generate explode(array(struct(_introns" in line]
    brackets = [line for line in text.splitlines() if "Generate explode(array(struct(_b" in line]
    assert listed and brackets and not any("array_sort" in line for line in brackets)
