"""Integer vectors: what the vector operators read from the table of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 256
LARGEST = 1 << 24  # components from here on would leave the range in which sums of squares are exact


def kept_rows(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """``vec_id``, ``label``, ``vector`` (doubles) of the rows whose vector is not null and holds finite numbers only."""
    values = F.col(vector).cast("array<double>")
    narrow = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), values.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return narrow.where(F.col("vector").isNotNull() & finite)


def scaled(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of every component, rows padded with zeros to ``width``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), dtype=np.int64)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST // STEPS} or more in size: scores would not be exact")
    if len(lengths) and (lengths == width).all():
        return values.astype(np.int64).reshape(len(vectors), width)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), place] = values
    return out


def longest(kept: DataFrame) -> int:
    """Components of the longest vector; shorter ones count as padded with zeros."""
    return kept.agg(F.max(F.size("vector"))).first()[0] or 0
