"""Labels and reports on the comparison table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import col
from ..plans.ordered import BUCKETS, HEAVY_FLOOR, with_rank
from .scoring import affinity_category


def fold_change(first="ic50_score_1", second="ic50_score_2") -> Column:
    """first / second; x/0 is infinite and 0/0 is not a number."""
    a, b = col(first).cast("double"), col(second).cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def same_peptide_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("doublecheck_pep_seq", F.col("peptide_1") == F.col("peptide_2"))


def _best_alleles(df: DataFrame, peptide: str, score: str) -> DataFrame:
    """(peptide, ``best``): sorted (allele, copies) of the alleles that reach the peptide's best score.

    Three aggregates without a join: rows per score, the top score of each (peptide, allele), and the list of a peptide's
    alleles, which is as short as the allele list.
    """
    pairs = df.where(F.col(score).isNotNull()).groupBy(peptide, "allele", score).agg(F.count(F.lit(1)).alias("copies"))
    tops = pairs.groupBy(peptide, "allele").agg(F.max(F.struct(F.col(score).alias("score"), "copies")).alias("_top"))
    lists = tops.groupBy(peptide).agg(F.collect_list(F.struct("allele", "_top.score", "_top.copies")).alias("_all"))
    highest = F.array_max(F.transform("_all", lambda a: a["score"]))
    reach = F.filter("_all", lambda a: a["score"] == F.col("_highest"))
    kept = F.transform(reach, lambda a: F.struct(a["allele"].alias("allele"), a["copies"].alias("copies")))
    return lists.withColumn("_highest", highest).select(peptide, F.array_sort(kept).alias("best"))


def preferred_hla(
    df: DataFrame, peptide: str = "peptide_2", score: str = "mhc_score_2", repeats: bool = False
) -> DataFrame:
    """All alleles at the peptide's highest score over the table, sorted and comma-joined.

    ``preferred_HLA`` names each allele once and ``preferred_HLA_copies`` says how often it reaches the score,
    so both cells stay as short as the allele list however common the peptide is. ``repeats`` writes every
    copy out instead; such a cell grows with the rows of its peptide.
    """
    once = F.transform("best", lambda p: p["allele"])
    every = F.flatten(F.transform("best", lambda p: F.array_repeat(p["allele"], p["copies"].cast("int"))))
    texts = [F.array_join(every if repeats else once, ",").alias("preferred_HLA")]
    if not repeats:
        copies = F.transform("best", lambda p: p["copies"].cast("string"))
        texts.append(F.array_join(copies, ",").alias("preferred_HLA_copies"))
    labels = _best_alleles(df, peptide, score).select(peptide, *texts)
    return df.join(labels, peptide, "left")


def preferred_hla_subgroup(df: DataFrame, peptide: str = "peptide_2", score: str = "mhc_score_2") -> DataFrame:
    """Distinct part before ``*`` of the preferred alleles."""
    groups = F.array_sort(F.array_distinct(F.transform("best", lambda p: F.substring_index(p["allele"], "*", 1))))
    labels = _best_alleles(df, peptide, score).select(peptide, F.array_join(groups, ",").alias("preferred_HLA_subgroup"))
    return df.join(labels, peptide, "left")


def mutation_neoepitope_rank(
    df: DataFrame,
    keys: tuple[str, ...] = ("case_id", "genome_pos"),
    score: str = "mhc_score_2",
    ties: str = "average",
    buckets: int = BUCKETS,
    floor: int = HEAVY_FLOOR,
) -> DataFrame:
    """Descending rank of the altered peptide within its mutation; with average ties a shared top rank is above 1.

    ``floor`` is the number of rows from which a mutation is ranked by ranges.
    """
    return with_rank(df, list(keys), score, "mut_neoep_rank_1", ties=ties, buckets=buckets, floor=floor)


def attach_gene_expression(df: DataFrame, expression: DataFrame | None) -> DataFrame:
    """``gene_express`` and ``gene_percentile`` by (gene_symbol, condition); 0 when either is unknown."""
    if expression is None:
        return df.withColumns({"gene_express": F.lit(0.0), "gene_percentile": F.lit(0.0)})
    table = expression.select(
        "gene_symbol", "condition", F.col("express").alias("_e"), F.col("percentile").alias("_p")
    )
    return (
        df.join(table, ["gene_symbol", "condition"], "left")
        .withColumns({"gene_express": F.coalesce("_e", F.lit(0.0)), "gene_percentile": F.coalesce("_p", F.lit(0.0))})
        .drop("_e", "_p")
    )


def rank1_report(frames: list[DataFrame], nmd: str = "bool_nmd", change: str = "myVEP_aa_orig_alt", buckets: int = BUCKETS) -> DataFrame:
    """Best peptide of every mutation outside NMD, original and altered peptides differing, with its fold change.

    Rows without an amino-acid change (``None/None`` or null in ``change``) are left out.

    Several inputs are ranked on their own (column ``input``); ``binding`` marks rows that belong to the
    second report, which leaves out the category ``none``.
    """
    tagged = [f.withColumn("input", F.lit(i)) for i, f in enumerate(frames)]
    ranked = mutation_neoepitope_rank(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), ("input", "case_id", "genome_pos"),
        buckets=buckets,
    )
    return (
        ranked.where(
            F.lower(nmd).contains("fa")
            & (F.col("mut_neoep_rank_1") == 1)
            & (F.col("peptide_1") != F.col("peptide_2"))
            & ~F.lower(change).contains("non")
        )
        .withColumn("fold_change", fold_change())
        .withColumn("binding", affinity_category("ic50_score_2") != "none")
    )
