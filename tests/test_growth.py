"""Work and bytes per row of steps that many queries share, and their results on rows made here."""

import random

from pyspark.sql import functions as F

from neoquarry.functions import coding, models
from neoquarry.operators import cohort, fusions, junctions

EXONS = "array<struct<start:bigint,end:bigint,cds_start:bigint,cds_end:bigint,num:int,frame:int,offset:bigint>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exons_are_searched_once_per_lookup(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, [])], f"gene int, strand int, start_pos bigint, end_pos bigint, tx_start bigint, exons {EXONS}")
    df = df.withColumns({"tx_end": F.col("tx_start"), "chrom": F.lit("chr1")})
    df = df.union(df).repartition(2)
    searches = lambda d, what="filter(": plan(d).count(what)
    assert searches(df.select(models.frame_at("exons", "strand", "start_pos", 1).alias("x"))) == 1
    assert searches(df.select(junctions.skipped(F.col("start_pos"), F.col("end_pos")).alias("x"))) == 2
    assert searches(junctions.frame_preserved(df).select("frame_preserved")) == 2
    assert searches(junctions.ligated_elements(df).select("ligated")) == 4
    bracket = junctions.bracket_of(F.array("tx_start", "tx_end"), F.col("start_pos"), F.col("end_pos"))
    assert searches(df.select(bracket.alias("x"))) == 2


def test_equal_windows_are_found_by_marks(spark):
    draw, rows = random.Random(3), [("ACGTACGT", "ACGTACGT"), ("", "ACG"), ("ACG", ""), ("acgtACGTA", "ACGTACGTA"), (None, "ACG"), ("ACG", None)]
    for _ in range(300):
        a = "".join(draw.choice("AC") for _ in range(draw.randrange(30)))
        at = draw.randrange(len(a) + 1)
        rows.append((a, a[:at] + draw.choice(["", "A", "CC", "G"]) + a[at + draw.randrange(2):]))
    rows = [(i, a, b, draw.randrange(-1, 12)) for i, (a, b) in enumerate(rows)]

    def plain(o, v, s):
        if o is None or v is None or s < 0:
            return -1
        for i in range(s, len(v)):
            stop = min(len(v), i + 6)
            if o[i:stop] == v[i:stop]:
                return stop
        return -1

    df = spark.createDataFrame(rows, "id int, o string, v string, s int").withColumn("w", coding.next_equal_window("o", "v", "s", 2))
    assert "sequence(" not in plan(df)
    assert {r["id"]: r["w"] for r in df.collect()} == {i: plain(o, v, s) for i, o, v, s in rows}


def test_first_rows_carry_each_column_once(spark):
    rows = [("a", 2, 1.0, "x"), ("a", 1, 3.0, "y"), ("a", None, 3.0, "z"), (None, 5, None, "u"), (None, 4, 2.0, "v"), ("b", 7, None, "w")]
    df = spark.createDataFrame(rows, "genome_pos string, place int, mhc_score_2 double, note string")
    first = cohort.first_per_mutation(df, ["place"])
    best = cohort.best_row_per_mutation(df, ["place"], keys=("genome_pos",))
    assert "min_by" not in plan(first) and "min_by" not in plan(best)
    assert first.columns == best.columns == df.columns
    assert sorted(r["note"] for r in first.collect()) == ["v", "w", "z"]
    assert sorted(r["note"] for r in best.collect()) == ["v", "z"]
    mapped = cohort.first_per_mutation(df.withColumn("m", F.create_map("note", "place")), ["place"])
    assert sorted(r["note"] for r in mapped.collect()) == ["v", "w", "z"]


def test_ids_of_a_gene_stay_one_list_and_genes_are_dealt(spark):
    ids = [("G1", "NM_1", "CCDS1", "P1"), ("G1", "NM_2", None, "P1"), ("G2", "NM_3", "CCDS1", "P2"), (None, "NM_4", "CCDS1", "P3"), ("G1", "NM_1", "CCDS1", "P1")]
    asked = [(1, "ccds1"), (2, "CCDS1"), (2, "CCDS1"), (3, "P1"), (4, None), (5, "NM_2"), (6, "NM_9"), (7, "NM_4")]
    out = fusions.kinase_id_lookup(
        spark.createDataFrame(asked, "ask_id int, id string"), spark.createDataFrame(ids, "gene string, refseq string, ccds string, uniprot string")
    )
    assert out.columns == ["gene", "id_type", "id", "ask_id", "isoform_id"]
    found = sorted((r["ask_id"], r["id_type"], r["gene"], r["isoform_id"]) for r in out.collect())
    assert found == [
        (2, 2, "G1", "CCDS1"), (2, 2, "G1", "CCDS1"), (2, 2, "G2", "CCDS1"), (2, 2, "G2", "CCDS1"), (3, 3, "G1", "P1"),
        (5, 1, "G1", "NM_1"), (5, 1, "G1", "NM_2"),
    ]
    assert "_part" in plan(out)


def test_asked_ids_dealt_over_parts_are_not_broadcast(spark):
    ids = [(f"G{i // 3}" if i % 11 else None, f"NM_{i}", f"CCDS{i % 4}" if i % 2 else None, f"P{i % 7}") for i in range(300)]
    table = spark.range(300).select(
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("G"), F.floor(F.col("id") / 3).cast("string"))).alias("gene"), F.concat(F.lit("NM_"), "id").alias("refseq"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("CCDS"), (F.col("id") % 4).cast("string"))).alias("ccds"), F.concat(F.lit("P"), (F.col("id") % 7).cast("string")).alias("uniprot"),
    )
    asked = [(k % 90, None if k % 10 == 9 else f"NM_{k}" if k % 3 == 0 else f"P{k % 8}" if k % 3 == 1 else f"CCDS{k % 5}") for k in range(100)]
    wanted = spark.range(100).select(
        (F.col("id") % 90).alias("ask_id"),
        F.when(F.col("id") % 10 == 9, F.lit(None)).when(F.col("id") % 3 == 0, F.concat(F.lit("NM_"), "id"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("P"), (F.col("id") % 8).cast("string"))).otherwise(F.concat(F.lit("CCDS"), (F.col("id") % 5).cast("string"))).alias("id"),
    )
    out = fusions.kinase_id_lookup(wanted, table)
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    # the rows that exploding makes are counted by no estimate: only the asked ids, each once, may be sent to all
    assert [line for line in joins if "Broadcast" in line and "LeftSemi" not in line] == []
    assert sum("_part" in line and "SortMergeJoin" in line for line in joins) == 1
    pairs = {(row[0], t, row[t]) for row in ids if row[0] for t in (1, 2, 3) if row[t]}
    kind = lambda i: 1 if i.startswith("NM_") else 2 if i.startswith("CCDS") else 3
    plain = sorted((k, i, g, other) for k, i in asked if i for g, t, x in pairs if (t, x) == (kind(i), i) for h, u, other in pairs if (h, u) == (g, t))
    assert len(plain) > 1000
    assert sorted((r["ask_id"], r["id"], r["gene"], r["isoform_id"]) for r in out.collect()) == plain
