"""Pieces the text operators share: tables, words, hashes, settled intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoints, tune

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Words a task remembers, in two halves; it bounds memory, results do not depend on it.
MEMORY_WORDS = 120_000

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
# letters A-Z lowered, every ASCII character that is neither a digit nor a letter turned into a space
_ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_LOWERED = bytes.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the cluster's checkpoint folder, so lost executors recompute nothing before it.

    The shuffle files behind them are of no more use then and go at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        # the setting is read when a frame is made
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``place``, their number from 0 in the order given, counted range by range."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of the id number the rows of a partition
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = settled(ranges.select("*", F.spark_partition_id().alias("_part"), inside.alias("_inside")))
    # one row per partition of the table
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before", "_n")


def lean(run: Callable) -> Callable:
    """A task function that gives its memory back to the system when the task is over, as workers live on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


class Run:
    """Where the run of characters around a place ends; a run that was read once is not read again."""

    def __init__(self, pattern: str):
        self.match, self.first, self.last = re.compile(pattern).match, 0, -1

    def end(self, text: str, at: int) -> int:
        if not self.first <= at <= self.last:
            self.first, self.last = at, self.match(text, at).end()
        return self.last


def with_nulls_as_empty(values: list) -> list:
    return [b"" if v is None else v for v in values]


def space_words(text: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lowered."""
    return text.translate(_LOWERED).split()


def letter_words(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, A-Z lowered."""
    return text.translate(_ALNUM).split()


class Remembered(dict):
    """Values by key, at most ``size`` of them, worked out by ``made`` where they are not known.

    Once half of them are new the others go; what is asked for again meanwhile is carried over.
    """

    def __init__(self, made: Callable, size: int):
        super().__init__()
        self.made, self.half, self.older = made, size // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        self[key] = value
        return value


class WordHashes(Remembered):
    """64-bit hash of a word."""

    def __init__(self):
        super().__init__(xxhash.xxh3_64_intdigest, MEMORY_WORDS)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; empty when there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= _STEP
        out += words[i : i + n]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
