"""Compression of vectors to codes: product quantisation whose rounds run over cover trees.

Vectors are brought to integers and cut into 16 equal parts; each part position has a codebook of 64 entries that moves
by Lloyd's rounds, in whole numbers. The tasks hold their rows in blocks; for each block and part position a cover tree
is built once, over the distinct parts: the children of a node of level l are more than 2^(l-1) apart and every part
below a child is within 2^(l-1) of it. Each node carries the number of rows below it, the sum of their parts and the
largest distance to a part below it.

A round sends the nodes down the tree level by level with the entries that may still be nearest. By the triangle
inequality an entry is out for a whole subtree when its distance to the node, less the subtree's radius, exceeds the
nearest entry's distance plus the radius. Where one entry is left, the subtree goes to it with its sum and number, and
nothing below is looked at. Otherwise the children take over; only at ambiguous leaves are parts compared one by one, in
integers. Trees are kept in the checkpoint folder between rounds; what leaves a task is a sum per entry.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .vectors import kept_rows, longest, scaled

LEAF = 16  # parts under a node that is not divided further
SAFE = 1e-6  # relative widening of distances, far beyond their rounding


@dataclass(frozen=True)
class Compression:
    """Production parameters."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    block: int = 8192  # rows under one set of trees
    broadcast_labels: int = 100_000


@dataclass
class CoverTree:
    """A tree over distinct points, as arrays; nodes stand level by level, parents before children."""

    points: np.ndarray
    counts: np.ndarray  # rows at each point
    point_of: np.ndarray  # row -> point
    leaf_of: np.ndarray  # point -> lowest node above it
    levels: np.ndarray  # first node of each level, and the number of nodes
    center: np.ndarray  # node -> point
    parent: np.ndarray
    radius: np.ndarray  # largest distance from the centre to a point below
    total: np.ndarray  # rows below
    sums: np.ndarray  # sum of these rows' points

    @staticmethod
    def over(rows: np.ndarray) -> CoverTree:
        points, point_of, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        center, parent, paths, levels = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(len(points), np.int64)], [0, 1]
        reach = 2.0 ** np.ceil(np.log2(max(1.0, np.sqrt(_squares(points, points[:1]).max()))))
        leaf_of = paths[0].copy()
        while True:
            under = np.bincount(leaf_of, minlength=levels[-1])
            # nodes of the lowest level with too many points for a leaf
            live = np.flatnonzero((under[leaf_of] > LEAF) & (leaf_of >= levels[-2]))
            if not len(live):
                break
            reach /= 2
            centers = np.concatenate(center)
            child, new_center, new_parent = _children(points, live, leaf_of[live], centers, reach)
            leaf_of[live] = levels[-1] + child
            center.append(new_center)
            parent.append(new_parent)
            levels.append(levels[-1] + len(new_center))
        return _summed(points, point_of.ravel(), counts, leaf_of, np.array(levels), np.concatenate(center), np.concatenate(parent))


    def packed(self) -> dict:
        """The arrays, whole numbers as narrow as they allow."""
        narrow = lambda x: x if x.dtype.kind == "f" or not x.size else x.astype(np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))
        return {name: narrow(x) for name, x in vars(self).items()}

    @staticmethod
    def unpacked(arrays: dict) -> CoverTree:
        return CoverTree(**{name: x if x.dtype.kind == "f" else x.astype(np.int64) for name, x in arrays.items()})


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    return ((a - b) ** 2).sum(axis=-1)


def _children(points: np.ndarray, live: np.ndarray, node: np.ndarray, centers: np.ndarray, reach: float) -> tuple[np.ndarray, ...]:
    """Divides nodes, all at once: per live point its child (from 0, children of a node side by side), and each child's
    centre and parent.

    A node's own centre is its first child's, so that children are nested; then the first point that no child covers is
    the next, until all are covered. So centres of one node's children are more than ``reach`` apart.
    """
    turn = np.full(len(live), -1)
    heads = []
    left, k = np.argsort(node, kind="stable"), 0
    while len(left):
        nodes, at = np.unique(node[left], return_index=True)
        chosen = centers[nodes] if k == 0 else live[left[at]]
        of = np.searchsorted(nodes, node[left])
        near = _squares(points[live[left]], points[chosen[of]]) <= reach * reach
        turn[left[near]] = k
        heads.append((nodes, np.full(len(nodes), k), chosen))
        left, k = left[~near], k + 1
    parents, turns, chosen = (np.concatenate(x) for x in zip(*heads))
    order = np.lexsort((turns, parents))
    parents, turns, chosen = parents[order], turns[order], chosen[order]
    width = k + 1
    child = np.searchsorted(parents * width + turns, node * width + turn)
    return child, chosen, parents


def _summed(points, point_of, counts, leaf_of, levels, center, parent) -> CoverTree:
    nodes, size = len(center), points.shape[1]
    radius, total, sums = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros((nodes, size), np.int64)
    node, at = leaf_of, np.arange(len(points))
    while len(at):
        np.add.at(total, node, counts[at])
        np.add.at(sums, node, points[at] * counts[at, None])
        np.maximum.at(radius, node, np.sqrt(_squares(points[at], points[center[node]])))
        node = parent[node]
        at, node = at[node >= 0], node[node >= 0]
    return CoverTree(points, counts, point_of, leaf_of, levels, center, parent, radius, total, sums)


def assigned(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties: the first) of every node that is settled as a whole, else -1, and of every point."""
    nodes = len(tree.center)
    whole, own = np.full(nodes, -1), np.full(nodes, -1)
    possible = np.ones((nodes, len(entries)), dtype=bool)
    for start, end in zip(tree.levels[:-1], tree.levels[1:]):
        node = np.arange(start, end)
        if start:
            above = tree.parent[node]
            whole[node] = whole[above]
            node = node[whole[node] < 0]
            possible[node] = possible[tree.parent[node]]
        at = tree.points[tree.center[node]].astype(np.float64)
        far = np.sqrt(((at[:, None, :] - entries[None]) ** 2).sum(axis=2))
        far[~possible[node]] = np.inf
        least = far.min(axis=1)
        reach = 2 * tree.radius[node] + SAFE * (1 + least + tree.radius[node])
        possible[node] &= far <= (least + reach)[:, None]
        one = possible[node].sum(axis=1) == 1
        whole[node[one]] = own[node[one]] = possible[node[one]].argmax(axis=1)
    nearest = whole[tree.leaf_of]
    ambiguous = np.flatnonzero(nearest < 0)
    for s in range(0, len(ambiguous), LEAF * 64):
        part = ambiguous[s : s + LEAF * 64]
        far = _squares(tree.points[part][:, None, :], entries[None])
        far[~possible[tree.leaf_of[part]]] = np.iinfo(np.int64).max
        nearest[part] = far.argmin(axis=1)
    return own, nearest


def entry_sums(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of each entry: whole subtrees by their stored sums, points of ambiguous leaves one by one."""
    own, nearest = assigned(tree, entries)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    top = np.flatnonzero(own >= 0)
    np.add.at(counts, own[top], tree.total[top])
    np.add.at(sums, own[top], tree.sums[top])
    below = own.copy()
    for start, end in zip(tree.levels[1:-1], tree.levels[2:]):
        below[start:end] = np.maximum(below[start:end], below[tree.parent[start:end]])
    single = np.flatnonzero(below[tree.leaf_of] < 0)
    np.add.at(counts, nearest[single], tree.counts[single])
    np.add.at(sums, nearest[single], tree.points[single] * tree.counts[single, None])
    return counts, sums


def planted(kept: DataFrame, width: int, how: Compression) -> DataFrame:
    """``block``: rows of ids, labels and the trees of every part position, a block of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, how.block):
                some = batch.slice(start, how.block)
                parts = np.split(scaled(some.column(2), width), how.parts, axis=1)
                held = (some.column(0).to_pylist(), some.column(1).to_pylist(), [CoverTree.over(p).packed() for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held, protocol=5)], pa.binary())], names=["block"])

    return settled(kept.mapInArrow(run, "block binary"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for value in batch.column(0):
            ids, labels, forest = pickle.loads(value.as_buffer())
            yield ids, labels, map(CoverTree.unpacked, forest)


def moved(trees: DataFrame, codebooks: np.ndarray, how: Compression) -> np.ndarray:
    """The codebooks after a round; the driver sees one row per entry."""
    parts, entries, size = codebooks.shape
    shared = trees.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for _, _, forest in _blocks(batches):
            for p, tree in enumerate(forest):
                n, s = entry_sums(tree, shared.value[p])
                counts[p] += n
                sums[p] += s
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), *(pa.array(sums[p, e, i]) for i in range(size))],
            names=["part", "entry", "n", *(f"s{i}" for i in range(size))],
        )

    names = ["n", *(f"s{i}" for i in range(size))]
    found = trees.mapInArrow(run, ", ".join(["part int", "entry int", *(f"{c} long" for c in names)]))
    out = codebooks.copy()
    for r in found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(size)]
    shared.unpersist()
    return out


def coded(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error`` per row."""
    shared = trees.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for ids, labels, forest in _blocks(batches):
            code, error = np.empty((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
            for p, tree in enumerate(forest):
                _, nearest = assigned(tree, books[p])
                code[:, p] = nearest[tree.point_of]
                error += _squares(tree.points, books[p][nearest])[tree.point_of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array([r.tobytes().hex() for r in code]), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return trees.mapInArrow(run, "vec_id long, label long, code string, error long")


def compressed(rows: DataFrame, how: Compression = Compression(), vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of every row with a sound vector.

    Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors count as padded with
    zeros, and all to a whole number of components a part. With fewer rows than entries the codebooks are shorter. Null ids
    stand behind all others where the first entries are chosen; rows with null labels share one label error; repeated rows
    each give a row. Extra columns are ignored; an empty table gives an empty result. A component of 65,536 or more in
    size is refused with an error, as sums would not be exact.
    """
    kept = settled(kept_rows(rows, vector))
    width = -(-max(1, longest(kept)) // how.parts) * how.parts
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(how.entries).select("vector").toArrow()["vector"].combine_chunks()
    start = scaled(first, width) if len(first) else np.zeros((1, width), np.int64)
    codebooks = np.stack(np.split(start, how.parts, axis=1))
    trees = planted(kept, width, how)
    for _ in range(how.rounds):
        codebooks = moved(trees, codebooks, how)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    found = settled(coded(trees, codebooks))
    sums = settled(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    # a label is two numbers; a longer table goes through a shuffle join, hot labels split
    sums = F.broadcast(sums) if sums.count() <= how.broadcast_labels else sums
    out = found.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
