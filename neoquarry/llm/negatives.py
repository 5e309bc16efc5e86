"""Hard-negative mining by angular triangle filtering.

A row's vector is brought to integers; scores are integer inner products. Each row stores its length and its angles to
R reference directions at right angles to each other (the main directions of a bounded sample of the rows). The cosines
of these angles give the part of a score that lies in the space of the references; the angle between a vector and that
space leaves a rest, of which only the size is known. By the triangle inequality on the sphere the cosine between two
rows is within that part plus or minus the product of the two rests' sines. Times both lengths, widened for every
rounding on the way, this bounds the integer score from both sides. Only pairs whose bounds overlap the window an anchor
still looks for get integer scoring:

* positives: from the score of the fifth best row of the same label found so far;
* negatives: from 80 % of a positive's score, or the fifth best found so far for it, to the positive's score.

Rows are sorted by ranges of their nearest reference and the angle to it, so tiles of rows have narrow angles: a tile
whose widest interval misses an anchor's window is left out as a whole, before any pair is looked at.

Anchors are the query set: they go to the tasks in blocks of a fixed number of rows, one block after the other, and every
task holds one block and its own rows tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, settled
from .vectors import kept_rows, longest, scaled

TILE = 1024
PAIRS = 1 << 15  # pairs scored at a time
SLACK = 2e-5  # of cosines kept as 32-bit numbers, their angles too
NO_SCORE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    """Production parameters. ``low`` and ``high`` bound a negative's score in percent of the positive's."""

    every: int = 100  # anchors: ids divisible by this
    moved: int = 7  # ids divisible by this have the next label
    labels: int = 10
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    references: int = 48
    sample: int = 4096  # rows the reference directions are fitted on; results do not depend on them
    block: int = 4096  # anchors in a block


def directions(kept: DataFrame, width: int, how: Mining) -> np.ndarray:
    """Reference directions at right angles, main ones of a bounded sample first; one per row."""
    sample = kept.orderBy(F.xxhash64("vec_id", "vector")).limit(how.sample).select("vector")
    found = [np.resize(np.asarray(r.vector, dtype=np.float64), len(r.vector)) for r in sample.collect()]
    rows = np.zeros((len(found), width))
    for i, v in enumerate(found):
        rows[i, : len(v)] = v / (np.linalg.norm(v) or 1)
    _, turned = np.linalg.eigh(rows.T @ rows)
    return np.ascontiguousarray(turned[:, ::-1].T[: how.references])


def described(kept: DataFrame, references: np.ndarray, width: int) -> DataFrame:
    """Per row ``row`` (a number of its own), ``vec_id``, ``label``, ``vector`` (32-bit integers), ``norm``, ``angles``
    (32-bit floats), sorted by ranges of the nearest reference and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = scaled(batch.column(2), width)
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
            cosines = (q @ references.T) / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)
            near = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(q), dtype=np.int64)
            least = angles.min(axis=1) if angles.shape[1] else np.zeros(len(q), dtype=np.float32)
            packed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed(q.astype(np.int32)), pa.array(norm), packed(angles), pa.array(near, pa.int32()), pa.array(least, pa.float32())],
                names=["vec_id", "label", "vector", "norm", "angles", "near", "least"],
            )

    schema = "vec_id long, label long, vector binary, norm double, angles binary, near int, least float"
    rows = kept.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    # many rows with one vector have one angle: their ids cut such a range
    order = ("near", "least", F.xxhash64("vec_id", "row"))
    return settled(settled(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("row", "vec_id", "label", "vector", "norm", "angles"))


class Side:
    """Rows as arrays: one batch, or a block of anchors."""

    def __init__(self, columns: list, width: int):
        row, vec_id, label, vector, norm, angles = columns
        self.row = np.asarray(row.to_numpy(zero_copy_only=False), dtype=np.int64)
        # a null id stands behind all others
        self.id = np.asarray(vec_id.fill_null(LAST).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.null = np.asarray(vec_id.is_null().to_numpy(zero_copy_only=False))
        self.label = np.asarray(label.to_numpy(zero_copy_only=False), dtype=np.int64)
        n = len(self.row)
        self.vector = np.frombuffer(b"".join(vector.to_pylist()), dtype=np.int32).reshape(n, width)
        self.norm = np.asarray(norm.to_numpy(zero_copy_only=False), dtype=np.float64)
        flat = np.frombuffer(b"".join(angles.to_pylist()), dtype=np.float32)
        self.angle = flat.reshape(n, -1) if n else flat.reshape(0, 0)
        self.cosine = np.cos(self.angle)
        # at least the sine of the angle to the space of the references
        self.rest = np.sqrt(np.clip(1 - (self.cosine.astype(np.float64) ** 2).sum(axis=1) + SLACK, 0, 1)).astype(np.float32)


def bounds(rows: Side, part: slice, anchors: Side, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score possible, rows by anchors."""
    inside = rows.cosine[part] @ anchors.cosine[some].T
    rest = rows.rest[part][:, None] * anchors.rest[some] + np.float32(SLACK)
    length = rows.norm[part][:, None] * anchors.norm[some]
    return np.ceil(length * (inside - rest)) - 1, np.floor(length * (inside + rest)) + 1


def tile_ceiling(rows: Side, part: slice, anchors: Side) -> np.ndarray:
    """Greatest score any row of a tile can have, per anchor, from the tile's interval of angles to each reference."""
    low, high = rows.angle[part].min(axis=0), rows.angle[part].max(axis=0)
    gap = np.maximum(np.maximum(anchors.angle - high, low - anchors.angle), 0)
    widest = gap.max(axis=1) if gap.shape[1] else np.zeros(len(anchors.row))
    cosine = np.cos(widest.astype(np.float64)) + SLACK
    norms = rows.norm[part]
    return np.floor(anchors.norm * np.where(cosine > 0, norms.max(), norms.min()) * cosine) + 1


def exact(rows: Side, i: np.ndarray, anchors: Side, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), dtype=np.int64)
    for s in range(0, len(i), PAIRS):
        a, b = rows.vector[i[s : s + PAIRS]].astype(np.int64), anchors.vector[j[s : s + PAIRS]].astype(np.int64)
        out[s : s + PAIRS] = np.einsum("ij,ij->i", a, b)
    return out


class Best:
    """The first ``size`` candidates of every slot by score, then id."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.slot = self.score = self.id = np.empty(0, dtype=np.int64)
        self.null = np.empty(0, dtype=bool)
        self.worst = np.full(slots, NO_SCORE)  # of a full slot, the score a candidate must reach

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate((self.slot, slot)), np.concatenate((self.score, score))
        ids, null = np.concatenate((self.id, ids)), np.concatenate((self.null, null))
        order = np.lexsort((null, ids, -score, slot))
        slot, score, ids, null = slot[order], score[order], ids[order], null[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        full, kept = place == self.size - 1, place < self.size
        self.worst[slot[full]] = score[full]
        self.slot, self.score, self.id, self.null = slot[kept], score[kept], ids[kept], null[kept]

    def batch(self, anchors: Side, per_anchor: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.row[self.slot // per_anchor]), pa.array((self.slot % per_anchor).astype(np.int32)),
                pa.array(self.score), pa.array(self.id, mask=self.null),
            ],
            names=["anchor", "slot", "score", "id"],
        )


FOUND = "anchor long, slot int, score long, id long"


def survivors(rows: Side, anchors: Side, floor, ceiling: np.ndarray | None, same_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows, anchors) whose bounds overlap [floor, ceiling], tile by tile; ``floor()`` gives the present floors."""
    for start in range(0, len(rows.row), TILE):
        part = slice(start, start + TILE)
        for some in np.array_split(np.flatnonzero(tile_ceiling(rows, part, anchors) >= floor()), max(1, len(anchors.row) // TILE)):
            if not len(some):
                continue
            least, most = bounds(rows, part, anchors, some)
            fits = most >= floor()[some]
            if ceiling is not None:
                fits &= least <= ceiling[some]
            fits &= (rows.label[part][:, None] == anchors.label[some]) == same_label
            i, j = np.nonzero(fits)
            yield i + start, some[j]


def _positives(batches: Iterator[pa.RecordBatch], block: list, width: int, how: Mining) -> Iterator[pa.RecordBatch]:
    anchors = Side(block, width)
    best = Best(len(anchors.row), how.positives)
    for batch in batches:
        rows = Side(batch.columns, width)
        for i, j in survivors(rows, anchors, lambda: best.worst, None, True):
            other = rows.null[i] | (rows.id[i] != anchors.id[j])
            i, j = i[other], j[other]
            score = exact(rows, i, anchors, j)
            good = score >= best.worst[j]
            best.add(j[good], score[good], rows.id[i[good]], rows.null[i[good]])
    yield best.batch(anchors, 1)


def _negatives(batches: Iterator[pa.RecordBatch], block: list, positive: np.ndarray, width: int, how: Mining) -> Iterator[pa.RecordBatch]:
    """``positive``: scores per anchor and slot, NO_SCORE where there are fewer."""
    anchors, n = Side(block, width), how.positives
    used = positive != NO_SCORE
    known = np.where(used, positive, 0)
    low, high = -(-how.low * known // 100), how.high * known // 100
    used &= low <= high
    low, high = np.where(used, low, LAST), np.where(used, high, NO_SCORE)
    best = Best(positive.size, how.negatives)
    floors = lambda: np.maximum(low, best.worst.reshape(-1, n))
    for batch in batches:
        rows = Side(batch.columns, width)
        for i, j in survivors(rows, anchors, lambda: floors().min(axis=1), high.max(axis=1), False):
            score, least = exact(rows, i, anchors, j), floors()
            slots, which = [], []
            for p in range(n):
                good = np.flatnonzero((score >= least[j, p]) & (score <= high[j, p]))
                slots.append(j[good] * n + p)
                which.append(good)
            which = np.concatenate(which)
            best.add(np.concatenate(slots), score[which], rows.id[i[which]], rows.null[i[which]])
    yield best.batch(anchors, n)


def _first(found: DataFrame, size: int) -> DataFrame:
    """The first rows of every slot over all tasks, with their ``rank``; each task has sent that many at most."""
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mined(rows: DataFrame, how: Mining = Mining(), vector: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null label or vector, or a null or non-finite component take no part. Rows with an anchor's id, repeated
    ones included, are not its positives; apart from that repeated rows count as rows of their own, anchors too. A null
    id is no anchor and stands behind all ids among equal scores. Shorter vectors count as padded with zeros; an empty
    vector scores zero. Extra columns are ignored; an empty table gives an empty result. A component of 65,536 or more in
    size is refused with an error, as sums would not be exact.
    """
    kept = kept_rows(rows, vector).where("label is not null")
    moved = (F.col("label") + 1) % how.labels
    kept = settled(kept.withColumn("label", F.when(F.col("vec_id") % how.moved == 0, moved).otherwise(F.col("label"))))
    width = longest(kept)
    table = described(kept, directions(kept, width, how), width)
    anchors = settled(numbered(table.where(F.col("vec_id") % how.every == 0), F.asc("vec_id"), F.asc("row")))
    spark, results = rows.sparkSession, []
    for start in range(0, anchors.count(), how.block):
        results.append(_block(spark, table, anchors.where(F.col("place").between(start, start + how.block - 1)).drop("place"), width, how))
    if not results:
        results = [spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")]
    return reduce(DataFrame.unionByName, results)


def _block(spark, table: DataFrame, anchors: DataFrame, width: int, how: Mining) -> DataFrame:
    """The result of one block of anchors; its rows, and their positives, are all the driver sees of the table."""
    block = anchors.toArrow().combine_chunks()
    columns = [c.combine_chunks() for c in block.columns]
    shared = spark.sparkContext.broadcast(columns)
    found = table.mapInArrow(lambda batches: _positives(batches, shared.value, width, how), FOUND)
    positives = settled(_first(found, how.positives).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    at = {r: i for i, r in enumerate(block["row"].to_pylist())}
    scores = np.full((len(at), how.positives), NO_SCORE)
    for r in positives.select("anchor", "slot", "positive_score").collect():
        scores[at[r.anchor], r.slot] = r.positive_score
    wanted = spark.sparkContext.broadcast(scores)
    found = table.mapInArrow(lambda batches: _negatives(batches, shared.value, wanted.value, width, how), FOUND)
    # both at most ``positives`` rows for each anchor of the block
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    known = F.broadcast(positives.join(F.broadcast(named), "anchor"))
    first = _first(found, how.negatives).select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = settled(first.join(known, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    shared.unpersist()
    wanted.unpersist()
    return out
