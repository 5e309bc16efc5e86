"""Mixing next to the plain definition: one loop per source, fractions for the targets."""

from fractions import Fraction
from hashlib import md5

from neoquarry.llm.mixture import Curriculum, mixture, targets, sized, training_order

SCHEMA = "doc_id long, text string, source string, size long, target string"


def fair(sizes, repeats=3):
    """Targets by source, sharing again until none is above its bound."""
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(named)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in named if s not in held]
        rest = total - sum(held.values())
        share = {s: Fraction(rest * weight[s], sum(weight[f] for f in free)) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return {**held, **share}
        held.update({s: repeats * sizes[s] for s in over})


def rows_of(spark, data):
    # the last two columns clash with those of the result
    return spark.createDataFrame([(d, t, s, -1, "x") for d, t, s in data], SCHEMA)


def corpus():
    data = [(i, "w " * (i % 13), "abc"[i % 3]) for i in range(300)]
    data += [(1000 + i, "one two three", "tiny") for i in range(4)]
    data += [(2000 + i, "x y z\tq" * 5, None) for i in range(60)]
    data += [(None, "null id", "b"), (None, "null id", "b"), (None, None, "b"), (7, "w " * 7, "b"), (7, "w " * 7, "b"), (3000, "", "empty"), (3001, None, "empty")]
    return data


def test_taken_words_by_brute_force(spark):
    data = corpus()
    got = [tuple(r) for r in mixture(rows_of(spark, data)).collect()]
    sizes, members = {}, {}
    for d, t, s in data:
        n = len([w for w in (t or "").replace("\t", " ").split(" ") if w])
        sizes[s] = sizes.get(s, 0) + n
        members.setdefault(s, []).append((d, n))
    goals, want = fair(sizes), []
    for s, docs in members.items():
        docs.sort(key=lambda x: (md5(("" if x[0] is None else str(x[0])).encode()).hexdigest(), x[0] is None, x[0] or 0, x[1]))
        stream = [(k, n) for _ in range(3) for k, (_, n) in enumerate(docs)]
        taken, left = [0] * len(docs), int(goals[s] // 1)
        for k, n in stream:
            taken[k] += min(n, left)
            left -= min(n, left)
        assert left == 0
        want += [(d, n, sizes[s], round(float(goals[s]), 6), t) for (d, n), t in zip(docs, taken)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((*r[:3], round(r[3], 6), r[4]) for r in got), key=key) == sorted(want, key=key)
    assert all(r[4] <= 3 * r[1] for r in got)
    placed = [r[5] for r in got if r[5] is not None]
    assert placed == sorted(placed) and [r[5] is None for r in got] == sorted(r[5] is None for r in got)


def test_positions_invert_the_schedule(spark):
    """Up to any time, the words due are the integral of the schedule, to within a document."""
    rows = rows_of(spark, [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)])
    order = training_order(rows).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    for turn, source in enumerate("abc"):
        mine = [r for r in order if r.source == source]
        whole = sum(r.words for r in mine)
        for t in (0.1, 0.35, 0.5, 0.8):
            due = sum(r.words for r in mine if r.position < t)
            integral = {0: 1.5 * t - t * t / 2, 1: t, 2: (2 * t + t * t) / 3}[turn]
            assert abs(due - integral * whole) <= 10
    # targets in proportion to the integrals 1, 2, 3
    assert [sum(r.words for r in order if r.source == s) for s in "abc"] == [5000, 10000, 15000]


def test_schedules_of_several_lines(spark):
    plan = Curriculum(schedules=(((0.0, 0.0), (0.5, 2.0), (1.0, 0.0)),))
    assert plan.weights() == [1.0]
    order = training_order(rows_of(spark, [(i, "w", "s") for i in range(1000)]), plan).collect()
    middle = sum(1 for r in order if 0.25 <= r.position < 0.75)
    assert abs(middle - 750) <= 1 and order[0].position == 0.0


def test_reruns_agree_and_empty_tables_stay_empty(spark):
    data = corpus()
    a = sorted(map(str, mixture(rows_of(spark, data)).collect()))
    b = sorted(map(str, mixture(rows_of(spark, data[::-1]).repartition(5)).collect()))
    assert a == b
    assert mixture(rows_of(spark, []).limit(0)).collect() == []
    assert targets(sized(rows_of(spark, [(1, None, "a"), (2, " ", None)]))).select("target").distinct().collect()[0][0] == 0.0
