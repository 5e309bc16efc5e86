"""Quality rules next to plain counting and to a plain estimate; importance resampling next to a plain one."""

import re
import zlib
from collections import Counter

import numpy as np

from neoquarry.llm import importance, quality, queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def failed(n, repeats):
    return n < 50 or 100 * repeats > 50 * n


def test_statistics():
    numbers = quality.Numbers()
    for text in ["", "a", "a a a a a", "é ü é\n\n x\nx\n x", "a b c " * 500, "## % x | y <b>", "\x0b\x1c x\x1c\n \x1c"]:
        assert quality.statistics(text.encode(), numbers)[:5] == counted(text), text


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op7_quality(spark, FOLDER).collect()}
    for r in rows:
        n, chars, symbols, dup, repeats = counted(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert g.base_failed == failed(n, repeats)
    assert estimated_plainly(rows) == {d: r.kept for d, r in got.items()}


def estimated_plainly(rows, rules=quality.Rules()):
    """The same estimate with arrays in one place."""
    numbers, kept, groups = quality.Numbers(), {}, {}
    stats = {r.doc_id: quality.statistics((r.text or "").encode(), numbers) for r in rows}
    good = [r for r in rows if not failed(stats[r.doc_id][0], stats[r.doc_id][4])]
    sizes = Counter((r.lang, r.source) for r in good)
    pooled = Counter()
    for (lang, _), n in sizes.items():
        pooled[lang] += n if n < rules.least_rows else 0
    for r in rows:
        kept[r.doc_id] = False
    for r in good:
        key = (r.lang, r.source) if sizes[r.lang, r.source] >= rules.least_rows else r.lang if pooled[r.lang] >= rules.least_rows else None
        groups.setdefault(key, []).append(r.doc_id)
    bound = quality.chi_square_bound(6, rules.cutoff) * quality.core_factor(rules.core, 6)
    cut = lambda v, share: np.sort(v)[int(np.ceil(len(v) * share)) - 1]
    for ids in groups.values():
        x = np.array([stats[d][5:] for d in ids])
        centre = np.array([cut(v, 0.5) for v in x.T])
        spread = np.array([max(f, (cut(v, 0.75) - cut(v, 0.25)) / 1.349) for v, f in zip(x.T, rules.floors)])
        log_det, centre, inverse = least_plainly(x, centre, spread, rules)
        far = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        kept.update({d: bool(f <= bound) for d, f in zip(ids, far)})
    return kept


def least_plainly(x, centre, spread, rules):
    """Three starts, two steps each, the least determinant on until it falls no more."""
    floors = np.array(rules.floors)
    cut = lambda v, share: np.sort(v)[int(np.ceil(len(v) * share)) - 1]

    def stepped(log_det, centre, inverse):
        step = np.round(np.log1p(np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)) * 100)
        core = x[step <= cut(step, rules.core)]
        mean = core.mean(axis=0)
        new = quality.floored(core.T @ core / len(core) - np.outer(mean, mean), floors)
        value = np.linalg.slogdet(new)[1]
        return (value, mean, np.linalg.inv(new)) if value < log_det - 1e-6 else (log_det, centre, inverse)

    z = (x - centre) / spread
    length = np.linalg.norm(z, axis=1, keepdims=True)
    starts = [(np.inf, centre, np.diag(1 / spread**2))]
    for v in (np.tanh(z), np.divide(z, length, out=np.zeros_like(z), where=length > 0)):
        square = v.T @ v / len(v)
        square *= len(centre) / max(1e-12, np.trace(square))
        starts.append((np.inf, centre, np.linalg.inv(quality.floored(square * np.outer(spread, spread), floors))))
    for _ in range(rules.first_steps):
        starts = [stepped(*e) for e in starts]
    best = min(starts, key=lambda e: round(e[0], 6))
    for _ in range(rules.steps):
        after = stepped(*best)
        if after[0] == best[0]:
            break
        best = after
    return best


def test_least_determinant_leaves_a_crowd_of_outliers_out(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    good, bad = rng.normal(size=(900, 6)) @ mix, rng.normal(size=(200, 6)) * 0.3 + 9
    x = np.round(np.vstack((good, bad)), 4)
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["grp", *quality.FEATURES])
    # a group of equal rows has the floors' spread
    df = df.union(spark.createDataFrame([("same", *[1.0] * 6)] * 30, df.columns))
    rules = quality.Rules()
    found = {r.grp: r for r in quality.least_determinant(df, rules).collect()}
    cut = lambda v, share: np.sort(v)[int(np.ceil(len(v) * share)) - 1]
    centre = np.array([cut(v, 0.5) for v in x.T])
    spread = np.array([max(f, (cut(v, 0.75) - cut(v, 0.25)) / 1.349) for v, f in zip(x.T, rules.floors)])
    log_det, mean, inverse = least_plainly(x, centre, spread, rules)
    assert np.allclose(found["g"].centre, mean) and np.isclose(found["g"].log_det, log_det)
    assert np.isclose(found["same"].log_det, 2 * np.log(rules.floors).sum()) and np.allclose(found["same"].centre, 1.0)
    far = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean) > quality.chi_square_bound(6, 1e-3) * quality.core_factor(rules.core, 6)
    assert far[900:].all() and far[:900].mean() < 0.02
    # shuffled joins give the same
    apart = {r.grp: r for r in quality.least_determinant(df, quality.Rules(most_sent=0)).collect()}
    assert np.allclose(apart["g"].centre, mean) and apart.keys() == found.keys()


def test_clean_stay_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in queries.op7_quality(spark, "/root/testdata/sf0.1").collect() if r.doc_id in labels and not r.base_failed]
    clean, junk = ([r.kept for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.3


def test_repeats_alone_can_fail():
    rules = quality.Rules()
    bound = quality.chi_square_bound(6, rules.cutoff) * quality.core_factor(rules.core, 6)
    # the share of repeated words at the bound, from a centre of none: below the base rule's
    assert bound * rules.floors[quality.FEATURES.index("repeats")] ** 2 * 100 < rules.most_repeats


def test_held_out_junk_goes(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = {r.doc_id: r.quality for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = [r for r in queries.op7_quality(spark, "/root/testdata/sf0.1").collect() if r.doc_id in held and not r.base_failed]
    clean, junk = ([r.kept for r in got if held[r.doc_id] == q] for q in (1, 0))
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.02


def test_edges(spark):
    rows = [(1, None, None, None, 0), (1, None, None, None, 0), (None, "w " * 30 + "x y z " * 5000, "en", None, 0), (2, " ".join(f"w{i}" for i in range(60)), None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as grp", "2 as n_words", "3 as centre")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.judged(df).collect())
    assert got == [(0, 15030, True, False), (1, 0, True, False), (1, 0, True, False), (2, 60, False, True)]
    assert quality.judged(df.limit(0)).collect() == []


def test_resampling_against_plain_ranking(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    how = importance.Resampling()
    rows = importance.weighed(docs, importance.log_ratios(docs, labels, how), how).collect()
    k = -(-len(rows) * 4 // 5)
    least = sorted((r.micro for r in rows), reverse=True)[k - 1]
    got = {r.doc_id: r.kept for r in queries.op4_resampling(spark, FOLDER).collect()}
    assert got == {r.doc_id: r.micro >= least for r in rows}
    good = {r.doc_id: r.quality for r in labels.collect()}
    clean, junk = ([got[d] for d, q in good.items() if q == x] for x in (1, 0))
    assert np.mean(clean) > 0.9 > 0.7 > np.mean(junk)


def test_kth_largest(spark):
    values = [5, -3, 5, 0, 1 << 40, -(1 << 40), 65536, -65536, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "micro long")
    for k in range(1, len(values) + 1):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, 0) is None and importance.kth_largest(df.limit(0), 1) is None


def test_resampling_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x y z"), (2, "")], "doc_id long, text string").selectExpr("*", "1 as micro", "true as kept")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (9, 1, 0), (None, 1, 1)], "doc_id long, quality long, toxic long")
    got = importance.resampled(df, labels).collect()
    assert len(got) == 4 and all(r.log_importance == 0 for r in got if r.n_grams == 0)
    assert importance.resampled(df.limit(0), labels).collect() == []
    assert len(importance.resampled(df, labels.limit(0)).collect()) == 4
