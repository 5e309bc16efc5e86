"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unroll(df: DataFrame, name: str, array: Column | str) -> DataFrame:
    """One row per array element.

    A plain explode lets the optimizer derive a size test on the array and push it below joins, which
    evaluates a computed array several times. The outer form with a filter on the element does not.
    """
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row and stay where they are.

    A filter on an ordinary computed column is pushed down with its whole expression, through joins too, and
    is then evaluated again. The output of a generator is not: a one-element array holds the values.
    """
    kept = [c for c in df.columns if c not in columns]
    pack = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*kept, F.explode(pack).alias("_pin")).select(*kept, "_pin.*")
