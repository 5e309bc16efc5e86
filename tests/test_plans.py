"""Plans hold no nested-loop or cartesian joins, prune columns, and streams resume."""

import re

import pytest

import __spark_entry__ as entry
from neoquarry.streaming.incremental import run_stage

FOLDER = "/root/testdata/sf0.001"
WATCHED = [
    "best_peptide_funnel", "score_peptides", "isoforms_by_position", "region_read_counts", "fusion_pairs", "sample_junctions",
    "processing_percentile", "junction_overlap_code", "kinase_genes_at_position", "variant_transcript_table", "preferred_hla",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", WATCHED)
def test_join_kinds(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_column_pruning(spark):
    text = plan(entry.queries()["efficacy_funnel"](spark, FOLDER))
    scanned = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_shipdate" not in scanned and "l_linenumber" not in scanned


def test_stream_goes_on_after_the_last_file(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    ddl = "Chromosome string, n int"

    def stage(df):
        return df.where("Chromosome rlike '^([0-9]+|X|Y)$'")

    spark.createDataFrame([("1", 1), ("MT", 2)], ddl).write.option("sep", "\t").option("header", True).csv(src)
    run_stage(spark, src, ddl, stage, out, chk).awaitTermination(120)
    spark.createDataFrame([("X", 3)], ddl).write.mode("append").option("sep", "\t").option("header", True).csv(src)
    run_stage(spark, src, ddl, stage, out, chk).awaitTermination(120)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 3]
