"""Vector codes next to plain rounds over all entries, and the trees by their own laws."""

import hashlib

import numpy as np
import pytest

from neoquarry.llm.codes import LEAF, Compression, CoverTree, assigned, compressed, entry_sums

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int), c) for i, v, c in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max([1] + [len(v) for _, v, _ in kept]) // parts) * parts
    x = np.array([np.r_[v, np.zeros(width - len(v), int)] for _, v, _ in kept]).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1].tolist()))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)], 1)
    for _ in range(rounds):
        who = near().argmin(-1)
        for p in range(parts):
            for e in range(len(first)):
                mine = x[who[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    far = near()
    who, error = far.argmin(-1), far.min(-1).sum(-1)
    totals = {}
    for (_, _, c), e in zip(kept, error):
        totals[c] = totals.get(c, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return sorted(((i, bytes(w.tolist()).hex(), int(e), totals[c], digest) for (i, _, c), w, e in zip(kept, who, error)), key=str)


def rows_of(kind):
    rng = np.random.default_rng(3)
    n = {"few": 20}.get(kind, 600)
    x = rng.normal(0, 0.3, size=(n, 32))
    if kind == "ties":
        x = rng.integers(-2, 3, size=(n, 32)) / 64
        x[::3] = x[0]
    rows = [(int(i), [float(a) for a in v], int(i % 5) if i % 11 else None) for i, v in enumerate(x)]
    if kind == "ties":
        rows += [(601, None, 1), (602, [None], 1), (603, [float("nan")], 1), (604, [float("-inf")] * 32, 1), (605, [0.25, -0.5], 2), (606, [], None)]
        rows += [rows[50], rows[50], (None, rows[1][1], 3)]
    return rows


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_same_as_plain_rounds(spark, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in compressed(df, Compression(block=250)).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert compressed(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("scale", [3, 40, 4000])
def test_cover_trees(scale):
    rng = np.random.default_rng(scale)
    rows = rng.normal(0, scale, size=(3000, 4)).astype(np.int64)
    tree = CoverTree.unpacked(CoverTree.over(rows).packed())
    assert (tree.points[tree.point_of] == rows).all() and tree.total[0] == len(rows) and (tree.sums[0] == rows.sum(0)).all()
    # sums and radius of every node, from the points below it
    below = np.zeros((len(tree.center), len(tree.points)), bool)
    node, at = tree.leaf_of.copy(), np.arange(len(tree.points))
    while len(at):
        below[node, at] = True
        node = tree.parent[node]
        at, node = at[node >= 0], node[node >= 0]
    for k in range(len(tree.center)):
        mine = tree.points[below[k]]
        far = np.sqrt(((mine - tree.points[tree.center[k]]) ** 2).sum(1))
        assert tree.radius[k] == far.max() and tree.total[k] == tree.counts[below[k]].sum()
    for level in range(1, len(tree.levels) - 1):
        children = np.arange(tree.levels[level], tree.levels[level + 1])
        reach = min(tree.radius[children].max() * 1.0, np.inf)
        for p in np.unique(tree.parent[children]):
            mine = children[tree.parent[children] == p]
            at = tree.points[tree.center[mine]]
            apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
            assert tree.center[mine[0]] == tree.center[p]  # nested
            if len(mine) > 1:
                assert apart[np.triu_indices(len(mine), 1)].min() >= tree.radius[mine].max()  # apart, and covering
        assert reach <= tree.radius[0] * 2
    sizes = np.bincount(tree.leaf_of, minlength=len(tree.center))
    assert sizes.max() <= LEAF
    for entries in (rows[:64], np.repeat(rows[:4], 8, axis=0), rows[:1]):
        own, nearest = assigned(tree, entries)
        assert (nearest == ((tree.points[:, None] - entries[None]) ** 2).sum(-1).argmin(-1)).all()
        counts, sums = entry_sums(tree, entries)
        who = nearest[tree.point_of]
        assert (counts == np.bincount(who, minlength=len(entries))).all()
        assert (sums == np.stack([rows[who == e].sum(0) for e in range(len(entries))])).all()


def test_whole_subtrees_are_assigned():
    """Far entries: the triangle inequality settles nodes without a look at the points below."""
    rng = np.random.default_rng(0)
    entries = rng.integers(-1000, 1000, size=(64, 4))
    rows = (entries[rng.integers(0, 64, 20000)] + rng.integers(-9, 10, size=(20000, 4))).astype(np.int64)
    tree = CoverTree.over(rows)
    own, _ = assigned(tree, entries)
    assert tree.total[own >= 0].sum() == len(rows) and (own >= 0).sum() < 400
