"""Quality by importance resampling.

Two generative models of hashed n-grams (single words and pairs of words, ``BUCKETS`` classes): one of target text, one
of raw text. A document's log-importance is the sum over its n-grams of the log-ratio of the two models. Adding a
Gumbel variable to it and keeping the k largest draws k documents without replacement with probabilities in proportion
to their importance.

The raw model counts every document. The target model is a classifier's side: it is fitted on labelled documents of
good quality, at most ``target_rows`` of them, chosen by the hash of their id. The k-th largest key is found exactly,
digit by digit of its bits: each round counts 65,536 classes at most, so no ranking ever meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, lean, letter_words, settled, window_hashes, with_nulls_as_empty

BUCKETS = 1 << 16


@dataclass(frozen=True)
class Resampling:
    """Production parameters."""

    keep: float = 0.8  # share of the rows drawn: k = ceil(keep * rows)
    target_rows: int = 20_000
    smooth: float = 1.0  # counts every class has beforehand
    seed: int = 17


def classes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The classes of a text's words and pairs of words."""
    words = hashes.of(letter_words(text))
    grams = np.concatenate((window_hashes(words, 1), window_hashes(words, 2)))
    return (grams >> np.uint64(48)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``bucket``, ``target`` and ``raw`` counts, from ``text`` and ``is_target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for value, target in zip(with_nulls_as_empty(batch.column(0).cast(pa.binary()).to_pylist()), batch.column(1).to_pylist()):
                if value:
                    own = np.bincount(classes(value, hashes), minlength=BUCKETS)
                    counts[1] += own
                    if target:
                        counts[0] += own
        held = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *(pa.array(c[held], pa.int64()) for c in counts)], names=["bucket", "target", "raw"])

    rows = docs.select(F.col("text").cast("string").alias("text"), "is_target")
    counts = rows.mapInArrow(lean(run), "bucket int, target long, raw long")
    return counts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(docs: DataFrame, labels: DataFrame, how: Resampling) -> np.ndarray:
    """The log-ratio of target to raw of each class; a table of fixed size."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    # a sample of a stated size: these ids may be broadcast
    chosen = good.orderBy(F.xxhash64("_good"), "_good").limit(how.target_rows).withColumn("_yes", F.lit(True))
    rows = docs.select("text", F.col("doc_id").cast("long").alias("_id")).join(F.broadcast(chosen), F.col("_id") == F.col("_good"), "left")
    rows = rows.select("text", F.coalesce("_yes", F.lit(False)).alias("is_target"))
    counts = np.zeros((2, BUCKETS))
    for r in gram_counts(rows).collect():
        counts[:, r.bucket] = r.target, r.raw
    counts += how.smooth
    shares = np.log(counts / counts.sum(axis=1, keepdims=True))
    return shares[0] - shares[1]


def weighed(docs: DataFrame, ratios: np.ndarray, how: Resampling) -> DataFrame:
    """``doc_id``, ``n_grams``, ``log_importance`` and ``micro``, the log-importance with its Gumbel variable."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), shared.value
        for batch in batches:
            found = [classes(v, hashes) for v in with_nulls_as_empty(batch.column(1).cast(pa.binary()).to_pylist())]
            logs = [round(float(table[c].sum()), 6) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(c) for c in found], pa.int64()), pa.array(logs, pa.float64())],
                names=["doc_id", "n_grams", "log_importance"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(lean(run), "doc_id long, n_grams long, log_importance double")
    # uniform in (0, 1) from the id, the same on every run
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(how.seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    # in millionths, as whole numbers: order and ties are the same on every machine
    micro = F.round((F.col("log_importance") - F.log(-F.log(uniform))) * 1_000_000).cast("long")
    return rows.withColumn("micro", micro)


def kth_largest(rows: DataFrame, k: int) -> int | None:
    """The k-th largest ``micro``, by counting 16 bits at a time."""
    if k <= 0:
        return None
    # the sign bit turned, so that the bits are in the order of the numbers
    turned = F.col("micro").bitwiseXOR(F.lit(-(1 << 63)))
    digits = rows.select(*(F.shiftrightunsigned(turned, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int").alias(f"d{i}") for i in range(4)))
    bits = 0
    for i in range(4):
        counts = dict(digits.groupBy(f"d{i}").count().collect())
        for digit in sorted(counts, reverse=True):
            if k <= counts[digit]:
                break
            k -= counts[digit]
        else:
            return None
        bits = bits << 16 | digit
        digits = digits.where(F.col(f"d{i}") == digit)
    return bits - (1 << 63)


def resampled(docs: DataFrame, labels: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """Per document ``doc_id``, ``n_grams``, ``log_importance`` and ``kept``.

    Rows tied with the k-th are all kept. A null or empty text has importance one (zero in logs). Repeated rows have
    equal keys, each gives a result row. Labels without a document, and null labels, count for nothing; without any
    target the two models are the raw one and an even one. Extra columns are ignored, an empty table stays empty.
    """
    rows = settled(weighed(docs, log_ratios(docs, labels, how), how))
    least = kth_largest(rows, math.ceil(rows.count() * how.keep))
    kept = F.col("micro") >= F.lit(least) if least is not None else F.lit(False)
    return rows.select("doc_id", "n_grams", "log_importance", kept.alias("kept"))
