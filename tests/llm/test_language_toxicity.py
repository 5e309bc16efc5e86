"""Language ID, toxicity on held-out labels, decontamination's ways, the pipeline's stages."""

import math
import random
import re
import time
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from neoquarry.llm import decontamination, language_id, queries, toxicity

SF001, SF01 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_languages_agree_with_what_texts_declare(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    found = queries.op1_language_id(spark, SF01)
    assert found.count() == docs.count()
    joined = found.join(docs, "doc_id")
    assert joined.where("language = lang and accepted").count() > 0.995 * docs.count()


def test_posterior_by_hand(spark):
    fusion = language_id.Fusion()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang", "source", "text")
    model = language_id.pair_model(docs, fusion)
    scored = language_id.text_evidence(docs, model, fusion).collect()
    names = [*fusion.languages, "und"]
    best = lambda r: names[r._text.index(max(r._text))]
    n = len(scored)
    start = {x: (sum(best(r) == x for r in scored) + fusion.smooth * (0.01 if x == "und" else 0.99 / 4)) / (n + fusion.smooth) for x in names}
    said = {(x, s): sum(best(r) == x and r.lang == s for r in scored) for x in names for s in fusion.languages}
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF001).collect()}
    for r in scored[:50]:
        host = [x for x in scored if x.source == r.source]
        logs = {}
        for i, x in enumerate(names):
            prior = (sum(best(h) == x for h in host) + fusion.smooth * start[x]) / (len(host) + fusion.smooth)
            first = 0.25 if x == "und" else 0.9 if x == r.lang else 0.1 / 3
            right = (said[x, r.lang] + fusion.smooth * first) / (sum(said[x, s] for s in fusion.languages) + fusion.smooth)
            logs[x] = r._text[i] + math.log(prior) + math.log(right)
        top = max(logs.values())
        want = 1 / sum(math.exp(v - top) for v in logs.values())
        assert got[r.doc_id].posterior == pytest.approx(want, abs=1e-9)
        assert logs[got[r.doc_id].language] == top


def test_other_scripts_and_edges(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = [(-1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, "en", "src0", 1), (-2, None, "en", "src1", 1), (-3, "123 456", None, None, 1), (-4, "", "xx", "src1", 1), (-4, "", "xx", "src1", 1)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, SCHEMA)).selectExpr("*", "1 as language", "2 as host", "3 as _text")
    got = [r for r in language_id.identified_documents(both).collect() if r.doc_id < 0]
    assert len(got) == 5 and not any(r.accepted for r in got) and {r.language for r in got} == {"und"}
    kept = language_id.accepted_documents(both)
    assert kept.columns == both.columns and kept.where("doc_id < 0").count() == 0
    assert kept.count() > 0.99 * docs.count()
    assert language_id.identified_documents(both.limit(0)).collect() == []


def test_page_evidence(spark):
    rows = [("http://x.a.de/y", "<html>"), ("http://x.org/fr/1", "<html lang='en'>"), ("https://u@h.co.uk:8/es?x", '<HTML class=a LANG="es-MX">'), (None, None)]
    where = language_id.page_evidence()
    df = spark.createDataFrame(rows, "url string, html string")
    got = [tuple(r) for r in df.select(where.declared, where.host, where.hint).collect()]
    assert got == [("", "x.a.de", "de"), ("en", "x.org", "fr"), ("es", "h.co.uk", "es"), (None, None, None)]


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = queries.op3_toxicity(spark, SF01)
    for r in got.select("doc_id", "held_out", "score", "predicted").limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    n = {(r.toxic, r.predicted): r["count"] for r in got.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] > 0.8 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) < 0.01 * n[0, 0]


def test_scores_do_not_depend_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learned(docs, labels) == toxicity.learned(docs, turned)


def test_clauses():
    grammar = toxicity.Grammar({"idiot": 7.0, "lowei*": 5.0}, dict.fromkeys(toxicity.THREAT_FORMS.values(), 1.0))
    read = dict(zip(toxicity.WAYS, grammar.read("An Idiot. You idiot! He said idiot\nnot a loweisch here; idiotic. kill you")))
    assert {way: w for way, w in read.items() if w} == {
        "insult": 7.0, "insult_target": 7.0, "insult_negated": 5.0, "insult_reported_target": 7.0, "threat_target": 1.0,
    }
    assert grammar.read("a clean text, lowe") == [0.0] * 13


@pytest.mark.parametrize("clause, ways", [
    ("he said he would kill you", {"threat_reported_target"}),
    ("I do not want to kill you", {"threat_negated_target"}),
    ("not every day I think you are an idiot", {"insult_target"}),  # too far behind the negation
    ("you are an idiot and I am killing you", {"insult_target", "threat_target"}),
    ("you aren’t an idiot, but I will beat them", {"insult_negated_target", "threat_target"}),
    ("er sagte, er schlägt dich", {"threat_reported_target"}),
    ("the idiot walked all the way to the old house before you", {"insult"}),  # the target is too far behind
    ("a skilled mate beats nobody", {"threat"}),
])
def test_ways_of_a_clause(clause, ways):
    grammar = toxicity.Grammar({"idiot": 7.0}, dict.fromkeys(toxicity.THREAT_FORMS.values(), 1.0))
    (words,) = grammar.clauses(clause)
    assert set(grammar.matched(words)) == ways


def plain_ways(letters):
    """The ways and their best weights, looked up for each insult or threat in the whole clause."""
    T, best = toxicity, {}
    for i, (letter, insult, threat) in enumerate(letters):
        def near(mark, places, stops):
            return any(letters[j][0] & mark and not any(letters[k][0] & stops for k in range(min(i, j) + 1, max(i, j))) for j in places)

        n = len(letters)
        reported = near(T.REPORT, range(i), T.TURN)
        negated = near(T.NEGATION, range(max(0, i - T.SCOPE), i), T.TURN | T.PAUSE)
        around = [*range(max(0, i - T.REACH), i), *range(i + 1, min(n, i + T.REACH + 1))]
        aimed = letter & T.TARGET or near(T.TARGET, around, T.TURN)
        end = ("_reported" if reported else "_negated" if negated else "") + ("_target" if aimed else "")
        for kind, mark, weight in (("insult", T.INSULT, insult), ("threat", T.THREAT, threat)):
            if letter & mark:
                best[kind + end] = max(best.get(kind + end, 0.0), weight)
    return best


def test_composed_machine_against_plain_search():
    rng = random.Random(3)
    grammar = toxicity.Grammar({}, {})
    for _ in range(3000):
        letters = []
        for _ in range(rng.randrange(25)):
            letter = 0 if rng.random() < 0.6 else rng.choice(toxicity.LETTERS)
            letters.append((letter, rng.choice((1.0, 2.5, 7.0)), rng.choice((0.5, 4.0))))
        following = iter(letters)
        grammar.letter = lambda word: next(following)  # noqa: B023
        assert grammar.matched([""] * len(letters)) == plain_ways(letters)


def test_long_clauses_take_linear_time():
    grammar = toxicity.Grammar({"idiot": 7.0}, {})
    seconds = []
    for n in (20_000, 40_000):
        start = time.process_time()
        grammar.read("you idiot not " * n)
        seconds.append(time.process_time() - start)
    assert seconds[1] < 3.5 * seconds[0]


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x " * 60000)], "doc_id long, text string").selectExpr("*", "1 as score", "1 as toxic")
    labels = spark.createDataFrame([(1, None, None), (1, 0, 1), (1, 0, 0), (None, 1, 1)], "doc_id long, quality long, toxic long")
    for some in (labels, labels.limit(0)):
        got = toxicity.scored(df, toxicity.learned(df, some)).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(df.limit(0), toxicity.learned(df.limit(0), labels)).collect() == []


def test_decontamination_in_parts_and_edges(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    more = spark.createDataFrame([(1000, "Thatred? ONE-two"), (1001, None), (1002, " -- "), (None, "the")], "item_id long, text string")
    odd = spark.createDataFrame([(-1, None, None, None, 0), (None, "thatred ONE  two", None, None, 0), (None, "thatred ONE  two", None, None, 0)], SCHEMA)
    docs, bench = docs.union(odd), bench.union(more)
    rows = lambda df: sorted(map(repr, df.collect()))
    whole = rows(decontamination.contamination(docs, bench))
    assert whole == rows(decontamination.contamination(docs.selectExpr("*", "1 as row", "2 as items"), bench, max_windows=900))
    assert sum("items=[1000]" in r and "n_hit=3" in r for r in whole) == 2
    clean = decontamination.decontaminated(docs, bench, "spans")
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontamination.contamination(clean.where("text is not null"), bench).where("n_hit > 0").count() < 3
    assert decontamination.contamination(docs.limit(0), bench).collect() == []
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF001)
        assert name == "bpe" or out.columns == docs.columns
        before, now = ({r.doc_id for r in x.select("doc_id").collect()} for x in (seen, out))
        assert now <= before
        assert name not in ("pii", "bpe") or now == before
        seen = out
    run = corpus_pipeline.run(spark, SF001)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, seen.collect()))
    assert not [r for r in run.collect() if re.search(r"@\w+ \.", r.decoded)]
