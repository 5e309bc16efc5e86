"""Hard negatives next to all pairs scored one by one."""

import numpy as np
import pytest

from neoquarry.llm.negatives import Mining, Side, bounds, described, directions, mined, tile_ceiling
from neoquarry.llm.vectors import kept_rows

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "x", 0) for i, v, c in rows], SCHEMA)


def brute(rows, how=Mining()):
    kept = []
    for i, v, c in rows:
        if c is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        kept.append((i, q, (c + 1) % how.labels if i is not None and i % how.moved == 0 else c))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:5]
    out = []
    for i, q, c in kept:
        if i is None or i % how.every:
            continue
        for ps, p in first([(dot(q, v), j) for j, v, d in kept if d == c and j != i]):
            found = [(dot(q, v), j) for j, v, d in kept if d != c]
            found = first([f for f in found if 80 * ps <= 100 * f[0] <= 100 * ps])
            out += [(i, p, r + 1, n, ps, s) for r, (s, n) in enumerate(found)]
    return sorted(out, key=str)


def data(kind, n=700, dim=24):
    rng = np.random.default_rng(5)
    if kind == "spread":
        x = rng.normal(size=(n, dim))
    elif kind == "clustered":
        x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, dim))
    else:
        x = rng.integers(-1, 2, size=(n, dim)).astype(float)  # many ties
        x[::3] = x[0]  # a third of all rows is one vector
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) * rng.uniform(0.5, 2, size=(n, 1))
    rows = [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    if kind == "ties":
        rows += [(5, None, 1), (6, [None] * dim, 1), (8, [float("nan")] * dim, 2), (9, [float("inf")] + [0.0] * (dim - 1), 2), (10, [0.5] * dim, None)]
        rows += [(None, rows[0][1], 0), (None, rows[0][1], 1), (100, rows[100][1], rows[100][2]), (3, rows[3][1], rows[3][2])]
        rows += [(900, [], 1), (1000, [0.0] * dim, 1), (1001, [0.3, -0.2], 1), (-100, rows[1][1], 2)]
    return rows


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties"])
def test_same_as_all_pairs(spark, kind):
    rows = data(kind)
    got = sorted((tuple(r) for r in mined(table(spark, rows), Mining(references=16, block=3)).collect()), key=str)
    assert got == brute(rows) and (got or kind == "clustered")


def test_bounds_hold_and_leave_pairs_out(spark):
    rows = kept_rows(table(spark, data("clustered"))).where("label is not null")
    how = Mining(references=16)
    arrow = described(rows, directions(rows, 24, how), 24).toArrow().combine_chunks()
    side = Side([c.combine_chunks() for c in arrow.columns], 24)
    every = np.arange(len(side.row))
    scores = side.vector.astype(np.int64) @ side.vector.T.astype(np.int64)
    least, most = bounds(side, slice(None), side, every)
    assert (least <= scores).all() and (scores <= most).all()
    # most pairs of different clusters cannot reach half the score of the anchor with itself
    assert (most < scores.diagonal()[None] / 2).mean() > 0.5
    for start in range(0, len(side.row), 100):
        part = slice(start, start + 100)
        assert (tile_ceiling(side, part, side) >= scores[part].max(axis=0)).all()


def test_empty_and_too_large(spark):
    assert mined(table(spark, [(1, [1.0], 1)]).limit(0)).collect() == []
    assert mined(table(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).count() == 1
    with pytest.raises(Exception, match="not be exact"):
        mined(table(spark, [(0, [1e30], 1)])).collect()
