"""Ranks and percentiles against plain Python, with one group that holds most of the rows."""

import bisect
import random

import pytest

from neoquarry.plans.ordered import cumulative_counts, with_rank, with_shared_ranks, with_strict_percentile


def _rows():
    rng = random.Random(5)
    hot = [("hot", float(rng.randrange(400))) for _ in range(3000)] + [("hot", 7.0)] * 1500
    cold = [(f"g{rng.randrange(40)}", float(rng.randrange(20))) for _ in range(800)]
    return hot + cold + [("g1", None), ("hot", None)]


@pytest.mark.parametrize("floor", [50, 10**6])
@pytest.mark.parametrize("keys", [["k"], []])
def test_cumulative_counts(spark, floor, keys):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, v double")
    got = cumulative_counts(df, keys, "v", buckets=16, floor=floor).collect()
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k if keys else None, []).append(v)
    groups = {k: sorted(v) for k, v in groups.items()}
    assert len(got) == sum(len(set(v)) for v in groups.values())
    for r in got:
        values = groups[r["k"] if keys else None]
        assert r["below"] == bisect.bisect_left(values, r["v"])
        assert r["ties"] == values.count(r["v"])
        assert r["total"] == len(values)


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    out = {(r["k"], r["v"]): r["r"] for r in with_rank(df, ["k"], "v", "r").collect()}
    # a tie at the top is 1.5, so nothing there has rank 1; null stays null
    assert out == {("a", 3.0): 1.5, ("a", 1.0): 3.0, ("a", None): None, ("b", 2.0): 1.0}
    out = {(r["k"], r["v"]): r["r"] for r in with_rank(df, ["k"], "v", "r", ties="min").collect()}
    assert out[("a", 3.0)] == 1.0


@pytest.mark.parametrize("floor", [50, 10**6])
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("ties", ["average", "min"])
def test_ranks_by_window_and_by_ranges(spark, floor, ascending, ties):
    rows = [(i, k, v) for i, (k, v) in enumerate(_rows() + [(None, 1.0)] * 300 + [(None, None)])]
    df = spark.createDataFrame(rows, "i int, k string, v double")
    out = with_rank(df, ["k"], "v", "r", ascending=ascending, ties=ties, buckets=16, floor=floor)
    assert out.columns == ["i", "k", "v", "r"]
    got = {r["i"]: r["r"] for r in out.collect()}
    assert len(got) == len(rows)
    groups = {}
    for _, k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for i, k, v in rows:
        if k is None or v is None:
            assert got[i] is None
            continue
        before = sum(x < v if ascending else x > v for x in groups[k])
        assert got[i] == before + ((groups[k].count(v) + 1) / 2 if ties == "average" else 1)


def test_strict_percentile(spark):
    ref = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 2.0), ("x", 4.0)], "k string, v double")
    probes = spark.createDataFrame([("x", 0.5), ("x", 2.0), ("x", 9.0), ("x", None), ("empty", 1.0)], "k string, v double")
    out = {(r["k"], r["v"]): r["p"] for r in with_strict_percentile(probes, ref, ["k"], "v", "p").collect()}
    assert out == {("x", 0.5): 0.0, ("x", 2.0): 25.0, ("x", 9.0): 100.0, ("x", None): None, ("empty", 1.0): None}


def test_shared_ranks(spark):
    rng = random.Random(9)
    one = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    rows = [(i, None if (a := one(40)) is None else a / 4, one(3), one(10**6)) for i in range(2000)]
    rows += [(i, 7.0, 1, 2**60 + i % 2) for i in range(2000, 3500)]  # long values that are equal as doubles
    rows += [(9000, None, None, None), (9001, None, None, None), (9002, -0.0, 0, 0), (9003, 0.0, 0, 0)]
    df = spark.createDataFrame(rows, "id int, a double, b int, c long")
    wanted = {"ra": ("a", True), "rb": ("b", False), "rc": ("c", False)}
    for ties in ("average", "min"):
        out = {r["id"]: r for r in with_shared_ranks(df, wanted, ties, buckets=16).collect()}
        assert len(out) == len(rows)
        for place, (name, (_, ascending)) in enumerate(wanted.items(), 1):
            values = sorted(r[place] for r in rows if r[place] is not None)
            for r in rows:
                if (v := r[place]) is None:
                    assert out[r[0]][name] is None
                    continue
                low, high = bisect.bisect_left(values, v), bisect.bisect_right(values, v)
                first = low + 1 if ascending else len(values) - high + 1
                assert out[r[0]][name] == (first + (high - low - 1) / 2 if ties == "average" else first)
    assert with_shared_ranks(df.limit(0), wanted).count() == 0
