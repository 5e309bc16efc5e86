"""Peptide scores: lookup, categories, comparison of original and altered, proteome matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import col
from ..plans.ordered import BUCKETS, strict_percentiles, with_shared_ranks
from ..plans.rows import unroll

# Upper ic50 limits of the affinity categories.
AFFINITY_LIMITS = {"HIGH": 50, "MID": 500, "LOW": 5000}

SCORE_COLUMNS = ["ic50_score", "mhc_score", "proteasome_score", "tap_score", "processing_score", "total_score"]


def score_peptides(windows: DataFrame, alleles: DataFrame, scores: DataFrame, on: str = "case_id") -> DataFrame:
    """One row per peptide and allele of its sample, with the scores; pairs without a score stay with nulls.

    ``alleles`` lists the alleles per ``on`` (a handful per patient), ``scores`` has one row per
    (allele, peptide). Both are equi-joins.
    """
    return windows.join(alleles, on).join(scores, ["allele", "peptide"], "left")


def missing_scores(scored: DataFrame) -> DataFrame:
    """Peptide and allele pairs the score table does not know."""
    return scored.where(F.col("ic50_score").isNull()).select("allele", "peptide").distinct()


def combine_score_sources(mhc: DataFrame, processing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Inner join of two score sets; clashing columns get ``_x`` and ``_y``."""
    keys = keys or ["allele", "start", "end", "length"]
    clash = (set(mhc.columns) & set(processing.columns)) - set(keys)

    def renamed(df, tag):
        return df.select(*[F.col(f"`{c}`").alias(c + tag if c in clash else c) for c in df.columns])

    return renamed(mhc, "_x").join(renamed(processing, "_y"), keys)


def affinity_category(ic50) -> Column:
    value = col(ic50)
    label = reduce(lambda w, kv: w.when(value <= kv[1], kv[0]), AFFINITY_LIMITS.items(), F)
    return label.otherwise("none")


def processing_percentile(df: DataFrame, reference: DataFrame, columns: dict[str, str], buckets: int = BUCKETS) -> DataFrame:
    """Strict percentile of each named score against the reference scores.

    ``columns`` maps the score column to the reference column; the result is ``<score>`` with ``score``
    replaced by ``percentile``.
    """
    out = df
    for score, ref in columns.items():
        name = score.replace("score", "percentile")
        table = strict_percentiles(df, reference.select(F.col(ref).alias(score)), [], score, name, buckets=buckets)
        out = out.join(table, score, "left")
    return out


def compare_orig_alt(
    original: DataFrame, altered: DataFrame, variant: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Original and altered scores side by side (``_1``, ``_2``) within one variant and isoform."""
    keys = variant + (keys or ["allele", "start", "end", "length"])

    def suffixed(df, tag):
        return df.select(*[F.col(c).alias(c if c in keys else c + tag) for c in df.columns])

    return suffixed(original, "_1").join(suffixed(altered, "_2"), keys)


def delta(first, second, inverse: bool = False) -> Column:
    a, b = col(first), col(second)
    up, down = ("lower", "higher") if inverse else ("higher", "lower")
    return F.when(b > a, up).when(b < a, down).otherwise("equal")


def delta_labels(df: DataFrame, with_ic50: bool = True) -> DataFrame:
    out = {
        "delta_mhc_score": delta("mhc_score_1", "mhc_score_2"),
        "delta_proteasome_score": delta("proteasome_score_1", "proteasome_score_2"),
        "delta_TAP_score": delta("tap_score_1", "tap_score_2"),
    }
    if with_ic50:
        out["delta_ic50_score"] = delta("ic50_score_1", "ic50_score_2", inverse=True)
    return df.withColumns(out)


def peptide_allele_matrix(df: DataFrame, alleles: list[str], order: list[str], ic50: str = "ic50_score") -> DataFrame:
    """Peptide rows, allele columns; the value with the highest ``order`` wins."""
    return df.groupBy("peptide").pivot("allele", alleles).agg(F.max_by(ic50, F.struct(*order)))


def protein_kmers(proteome: DataFrame, lengths: list[int], protein: str = "protein") -> DataFrame:
    """Every window of the wanted lengths with its 1-based start."""

    def windows(k):
        starts = F.when(F.length(protein) >= k, F.sequence(F.lit(1), F.length(protein) - (k - 1)))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.struct(i.alias("start"), F.substring(F.col(protein), i, F.lit(k)).alias("peptide")),
        )

    rows = unroll(proteome, "w", F.concat(*[windows(k) for k in lengths]))
    return rows.select(*[c for c in proteome.columns if c != protein], "w.start", "w.peptide")


def _wanted_kmers(peptides: DataFrame, proteome: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    asked = peptides.select("peptide").where(F.col("peptide").isNotNull()).distinct()
    return asked, protein_kmers(proteome, lengths).join(asked, "peptide", "left_semi")


def endogenous_match_count(
    peptides: DataFrame, proteome: DataFrame, lengths: list[int], protein_id: str = "protein_id"
) -> DataFrame:
    """Number of proteins that contain each peptide; ``error`` for lengths that were not searched."""
    asked, hits = _wanted_kmers(peptides, proteome, lengths)
    counts = hits.groupBy("peptide").agg(F.count_distinct(protein_id).alias("n"))
    searched = F.length("peptide").isin(lengths)
    found = asked.join(counts, "peptide", "left").select(
        "peptide",
        F.when(searched, F.coalesce("n", F.lit(0))).alias("pep_matches"),
        F.when(searched, "ok").otherwise("error").alias("pep_match_qstat"),
    )
    return peptides.join(found, "peptide", "left")


def endogenous_match_positions(
    peptides: DataFrame, proteome: DataFrame, lengths: list[int], protein_id: str = "protein_id"
) -> DataFrame:
    """First occurrence (1-based, closed) of each peptide in each protein that has it."""
    _, hits = _wanted_kmers(peptides, proteome, lengths)
    return (
        hits.groupBy("peptide", protein_id, "accession")
        .agg(F.min("start").cast("bigint").alias("match_start"))
        .withColumn("match_end", F.col("match_start") + F.length("peptide") - 1)
    )


RANKED_SCORES = {
    "ic50_score": True, "mhc_score": False, "proteasome_score": False, "tap_score": False,
    "processing_score": False, "total_score": False,
}


def rank_processing_scores(
    df: DataFrame, scores: dict[str, bool] | None = None, buckets: int = BUCKETS, sort: bool = True
) -> DataFrame:
    """File-wide average-tie ranks (value True = ascending) and the summed rank of mhc, proteasome and TAP.

    All scores share one count and one range index.
    """
    scores = scores or RANKED_SCORES
    df = with_shared_ranks(df, {f"rank_{name}": (name, ascending) for name, ascending in scores.items()}, buckets=buckets)
    summed = [F.coalesce(F.col(f"rank_{c}"), F.lit(0.0)) for c in ("mhc_score", "proteasome_score", "tap_score")]
    df = df.withColumn("rank_sum", reduce(lambda a, b: a + b, summed))
    return df.orderBy("rank_sum", *[f"rank_{c}" for c in scores]) if sort else df
