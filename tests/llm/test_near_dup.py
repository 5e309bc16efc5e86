"""Near-duplicate groups next to all pairs compared one by one."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from neoquarry.llm import near_dup, queries
from neoquarry.llm.near_dup import Similarity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, words=3, percent=85):
    """(doc_id, n_shingles, component_id, kept) for distinct ids"""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        size = min(words, len(w))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sorted(sets.items()):
        common = defaultdict(int)
        for x in s:
            for other in holders[x]:
                common[other] += 1
            holders[x].append(d)
        for other, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[other]) - c):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets.items())


def ours(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert ours(queries.op6_near_duplicates(spark, folder)) == brute([tuple(r) for r in docs])


def test_chain_borderline_and_short_texts(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(100, " ".join(base))]
    # every copy differs a little more from the first, each is close to the one before
    for i in range(1, 15):
        base = base.copy()
        base[i * 4] = f"x{i}"
        rows.append((100 - i, " ".join(base)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "one two"), (7, "One  two"), (8, "é two")]
    rows += [(200, "w " * 30000), (201, "w " * 20), (300, " ".join(f"q{i}" for i in range(40)))]
    rows += [(301, " ".join(f"q{i}" for i in range(37))), (302, " ".join(f"q{i}" for i in range(30)))]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    for like in (Similarity(), Similarity(5, 80)):
        assert ours(near_dup.near_duplicates(df, like)) == brute(rows, like.words, like.percent)


def test_large_group_of_near_copies(spark):
    rows = []
    for d in range(400):
        words = [f"t{i}" for i in range(120)]
        words[d % 120] = f"n{d}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert ours(near_dup.near_duplicates(df)) == brute(rows)


def test_repeated_rows_nulls_extra_columns_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None)], "doc_id long, text string")
    df = df.withColumn("node", F.lit("n")).withColumn("key", F.lit(1)).withColumn("component_id", F.lit(2))
    got = near_dup.near_duplicates(df).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, [
        (1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 0, None, True)]))
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_signature_length_follows_the_threshold():
    assert Similarity(3, 85).symbols == 32
    assert Similarity(5, 80).symbols > 32
