"""Interval joins as equi-joins on genome bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import unroll

EXON_BIN = 16_384
GENE_BIN = 131_072


def _binned(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.floor(F.col(end) / width))
    return unroll(df.withColumn(f"{name}_first", first), f"{name}_bin", F.sequence(first, last))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    on: str = "chrom",
    width: int = GENE_BIN,
    closed: bool = False,
) -> DataFrame:
    """Inner join of rows on the same chromosome whose spans overlap.

    Half-open spans by default; ``closed`` also accepts touching ends. Both sides are spread over fixed bins
    and joined on (chromosome, bin). A pair that shares several bins is kept only in the first shared one, so
    no pair comes out twice and nothing has to be removed afterwards. Column names must differ except ``on``.
    """
    a = _binned(left, *left_span, width, "_l")
    b = _binned(right, *right_span, width, "_r").withColumnRenamed(on, "_r_on")
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    meets = (ls <= re) & (rs <= le) if closed else (ls < re) & (rs < le)
    joined = a.join(
        b,
        (F.col(on) == F.col("_r_on"))
        & (F.col("_l_bin") == F.col("_r_bin"))
        & (F.col("_l_bin") == F.greatest("_l_first", "_r_first"))
        & meets,
    )
    return joined.drop("_l_first", "_l_bin", "_r_first", "_r_bin", "_r_on")
