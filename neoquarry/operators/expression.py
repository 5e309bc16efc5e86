"""Gene and isoform expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import BUCKETS, with_strict_percentile


def unpivot_expression(df: DataFrame, gene: str, conditions: list[str]) -> DataFrame:
    """Wide gene x condition table to (gene, condition, express)."""
    return df.unpivot([gene], conditions, "condition", "express")


def expression_percentile(df: DataFrame, condition: str = "condition", value: str = "express", buckets: int = BUCKETS) -> DataFrame:
    """Strict percentile of each gene among the expressed genes of its condition; 0 for genes not expressed."""
    expressed = df.where(F.col(value) > 0)
    ranked = with_strict_percentile(df, expressed.select(condition, value), [condition], value, "percentile", buckets=buckets)
    return ranked.withColumn(
        "percentile", F.when(F.col(value) > 0, F.col("percentile")).otherwise(F.lit(0.0))
    )


def genes_above_percentile(variants: DataFrame, expression: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Variants whose gene reaches the percentile in its condition."""
    return variants.join(expression.where(F.col("percentile") >= threshold), keys, "left_semi")


def isoform_expression(wanted: DataFrame, table: DataFrame, samples: list[str], key: str = "isoform;gene;range") -> DataFrame:
    """Largest value of each sample over rows of the isoform, else over rows of the gene."""
    parts = F.split(F.col(f"`{key}`"), ";")
    values = [F.col(f"`{s}`").cast("string").try_cast("double").alias(s) for s in samples]
    rows = table.select(
        F.get(parts, F.lit(0)).alias("isoform"), F.get(parts, F.lit(1)).alias("gene"), *values
    )
    by = {}
    for level, tag in (("isoform", "_i"), ("gene", "_g")):
        by[level] = rows.groupBy(level).agg(*[F.max(f"`{s}`").alias(s + tag) for s in samples], F.lit(True).alias("_has" + tag))
    joined = wanted.join(by["isoform"], "isoform", "left").join(by["gene"], "gene", "left")
    picked = [F.when(F.col("_has_i"), F.col(f"`{s}_i`")).otherwise(F.col(f"`{s}_g`")).alias(s) for s in samples]
    return joined.select(*wanted.columns, *picked)


def sample_expression_percentile(df: DataFrame, sample: str = "sample", value: str = "express", buckets: int = BUCKETS) -> DataFrame:
    """Strict percentile against the distinct positive values of the sample."""
    distinct = df.where(F.col(value) > 0).select(sample, value).distinct()
    return with_strict_percentile(df, distinct, [sample], value, "percentile", buckets=buckets)


def mutation_expression_counts(
    variants: DataFrame,
    expression: DataFrame,
    keys: list[str],
    thresholds: tuple[int, ...] = (25, 50, 75),
    condition: str = "condition",
    consequence: str = "Consequence",
) -> DataFrame:
    """Per condition and kind (missense, frameshift): all, in expressed genes, in genes at or above each threshold."""
    kind = F.when(F.lower(consequence).contains("missense"), "missense").when(
        F.lower(consequence).contains("frameshift"), "frameshift"
    )
    joined = variants.withColumn("kind", kind).where("kind is not null").join(expression, keys, "left")
    marks = [F.count_if(F.col("percentile") >= t).alias(f"percentile_{t}") for t in thresholds]
    return joined.groupBy(condition, "kind").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("express") > 0).alias("expressed"), *marks
    )


def mutation_summary_table(counts: DataFrame, condition: str = "condition", measures: list[str] | None = None) -> DataFrame:
    """One row per condition, a column per kind and measure."""
    measures = measures or [c for c in counts.columns if c not in (condition, "kind")]
    pivoted = counts.groupBy(condition).pivot("kind", ["missense", "frameshift"]).agg(
        *[F.sum(m).alias(m) for m in measures]
    )
    return pivoted.na.fill(0)
