"""Toxicity by a grammar of weighted finite-state transducers.

Words become letters: sets of marks (insult, threat, target, negation, reporting verb, pause, turn), with the weights
a learned lexicon gives to insults and threats. Small transducers read the letters of a clause in order:

* reported speech: what follows a reporting verb in its clause is reported, up to a turn (``but``);
* negation: the ``SCOPE`` words behind a negation are negated, up to a pause or turn;
* target: an insult or threat is aimed if a target stands within ``REACH`` words before or behind it;
* match: picks one insult or threat of the clause, takes its weight, and ends in the way it was matched.

They are composed once into one table of transitions. A clause is read by the best path to each end, so one clause may
match in several ways; reported speech wins over negation. What is scored is the matched clause: the best weight in each
way, and how many matches there are; words outside such a clause add nothing.

The weights of words and stems and of the ways are learned from labels, on at most ``rows`` rows of each class, chosen by
the hash of their id among those whose crc32 of the id is not 0 modulo 5. Scores use the text only. Anchors are found by
one pass of an Aho-Corasick automaton; only clauses around an anchor are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The function words of the transducers, and stems and endings of threats, per language of the corpus.
THREATS = {
    "en": ("kill hurt destroy beat attack", "s ed ing en"),
    "de": ("töt schlag schläg vernicht getöt geschlag", "e st t en te et ete"),
    "fr": ("tue frapp détrui", "s r ra rai ras nt e es er era erai eras é t re sent"),
    "es": ("mat golpe destru destroz", "ar o a as aré ará an ir iré irá yo ye"),
}
TARGETS = frozenset("you your he she they them him du dich dir ihr euch sie tu te toi vous ils elles usted tú ellos".split())
NEGATIONS = frozenset("not never no cannot nicht kein keine keinen nie niemals ne n pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says wrote called quoted claims claimed sagte sagt schrieb nannte zitierte dit écrivit dijo dice escribió llamó".split())
PAUSES = frozenset(", and or und oder et ou y o".split())
TURNS = frozenset("but however aber sondern mais pero sino".split())

THREAT_FORMS = {stem + end: stem for stems, ends in THREATS.values() for stem in stems.split() for end in ("", *ends.split())}

INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE, TURN, REPORTED, NEGATED, AIMED = (1 << i for i in range(10))
SCOPE, REACH = 4, 6

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")
CLAUSE_END = frozenset(".!?;\n")
STEMS = (4, 5, 6)
WAYS = tuple(kind + mode + aim for kind in ("insult", "threat") for mode in ("", "_negated", "_reported") for aim in ("", "_target"))


@dataclass(frozen=True)
class Transducer:
    """A start, and for a state and a letter the next states with the letters written."""

    start: object
    moves: Callable[[object, int], Iterable[tuple[object, int]]]

    def then(self, other: Transducer) -> Transducer:
        """Both in a row: the other reads what this one writes."""

        def moves(state, letter):
            for mine, middle in self.moves(state[0], letter):
                for its, out in other.moves(state[1], middle):
                    yield (mine, its), out

        return Transducer((self.start, other.start), moves)


def _reporting(on: int, letter: int) -> list[tuple[int, int]]:
    after = 0 if letter & TURN else 1 if letter & REPORT else on
    return [(after, letter | REPORTED if on else letter)]


def _negating(left: int, letter: int) -> list[tuple[int, int]]:
    after = SCOPE if letter & NEGATION else 0 if letter & (PAUSE | TURN) else max(0, left - 1)
    return [(after, letter | NEGATED if left else letter)]


def _aiming(left: int, letter: int) -> list[tuple[int, int]]:
    after = REACH if letter & TARGET else 0 if letter & TURN else max(0, left - 1)
    return [(after, letter | AIMED if left or letter & TARGET else letter)]


def _matching(state: tuple | None, letter: int) -> list[tuple[tuple | None, int]]:
    """``None`` looks for an anchor; after it: kind, mode, aimed or not, words within which a target still counts."""
    if state is None:
        mode = "_reported" if letter & REPORTED else "_negated" if letter & NEGATED else ""
        aim, left = ("_target", 0) if letter & AIMED else ("", REACH)
        return [(None, 0), *(((kind, mode, aim, left), mark) for kind, mark in (("insult", INSULT), ("threat", THREAT)) if letter & mark)]
    kind, mode, aim, left = state
    if left and letter & TARGET:
        return [((kind, mode, "_target", 0), 0)]
    return [((kind, mode, aim, 0 if letter & TURN else max(0, left - 1)), 0)]


GRAMMAR = Transducer(0, _reporting).then(Transducer(0, _negating)).then(Transducer(0, _aiming)).then(Transducer(None, _matching))
# every letter a word or comma can be
LETTERS = (*range(2 * REPORT), PAUSE, TURN)


def tabled(machine: Transducer) -> tuple[list[dict[int, list[tuple[int, int]]]], list[int]]:
    """The transitions by state and letter, and for each state the number of the way it ends in, -1 for none.

    Behind an anchor the marks of context are not read any more, so states that differ only there are one.
    """
    known, table, ends = {machine.start: 0}, [], []
    queue = [machine.start]
    for state in queue:
        ends.append(-1 if state[1] is None else WAYS.index("".join(state[1][:3])))
        row: dict[int, list[tuple[int, int]]] = {}
        for letter in LETTERS:
            row[letter] = []
            for after, out in machine.moves(state, letter):
                if after[1] is not None:
                    after = (machine.start[0], after[1])
                if after not in known:
                    known[after] = len(known)
                    queue.append(after)
                row[letter].append((known[after], out))
        table.append(row)
    return table, ends


@dataclass(frozen=True)
class Learning:
    """Production parameters."""

    rows: int = 20_000  # labelled rows of each class at most
    least_rows: float = 0.03  # share of the toxic rows a lexicon entry must occur in
    least_count: int = 4
    least_weight: float = 3.0  # nats by which an entry speaks for the toxic class
    threat: float = 4.0  # weight of a threat that the training rows tell nothing about
    plain: float = 0.5  # what the weights of the ways are held to by the ridge; evidence moves them
    aimed: float = 1.0
    distanced: float = 0.25  # negated or reported
    ridge: float = 1.0


def lowered(text: str) -> str:
    return text.lower().replace("’", "'")


def features(text: str) -> set[str]:
    """The words of a text, their stems marked by ``*``, and the stems of its threats marked by ``!``."""
    out = set()
    for word in set(TOKEN.findall(lowered(text))) - {","}:
        out.add(word)
        out.update(word[:n] + "*" for n in STEMS if len(word) > n)
        if word in THREAT_FORMS:
            out.add("!" + THREAT_FORMS[word])
    return out


def counted(rows: DataFrame, only: frozenset | None) -> DataFrame:
    """In how many texts each feature occurs, counted per part and summed by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = shared.value, Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = features(value or "")
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > 300_000:
                    yield _pairs(counts)
                    counts.clear()
        yield _pairs(counts)

    return rows.select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["f", "n"])


def training_rows(docs: DataFrame, labels: DataFrame, how: Learning) -> DataFrame:
    """``text``, ``toxic`` of the labelled rows the model may learn from; labels that contradict each other are out."""
    one = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    one = one.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    one = one.where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)) != 0)
    parts = [one.where(f"toxic = {t}").orderBy(F.xxhash64("_id"), "_id").limit(how.rows) for t in (1, 0)]
    # both samples are of a stated size: they may be broadcast
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select("text", F.col("doc_id").cast("long").alias("_doc"))
    return rows.join(chosen, F.col("_doc") == F.col("_id")).select("text", "toxic")


def lexicon(rows: DataFrame, how: Learning) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of insults, and stems of threats, with their weights, from the training rows.

    What the driver holds is bounded by the sample: the features that a share ``least_rows`` of the toxic rows has are
    at most 1 / ``least_rows`` times as many as a toxic training text has on average.
    """
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return {}, {}
    least = max(how.least_count, math.ceil(how.least_rows * toxic))
    frequent = counted(rows.where("toxic = 1"), None).where((F.col("n") >= least) | F.col("f").startswith("!"))
    held = {r.f: r.n for r in frequent.collect()}
    stems = {"!" + stem for stem in THREAT_FORMS.values()}
    other = {r.f: r.n for r in counted(rows.where("toxic = 0"), frozenset(held) | stems).collect()}

    def weight(f: str) -> float:
        return math.log((held.get(f, 0) + 0.5) / (toxic + 1)) - math.log((other.get(f, 0) + 0.5) / (clean + 1))

    # a threat that few rows have keeps its fixed weight
    seen = {f for f in stems if held.get(f, 0) + other.get(f, 0) >= how.least_count}
    threats = {f[1:]: round(max(0.0, weight(f)), 6) if f in seen else how.threat for f in sorted(stems)}
    weights = {f: weight(f) for f in held if f[0] != "!"}
    # the strongest first, of equal ones the longest; an entry is left out if a chosen stem covers it, or if what it
    # stands for is for the most part that of chosen longer ones
    chosen: dict[str, float] = {}
    explained: Counter = Counter()
    strong = ((w, f) for f, w in weights.items() if w >= how.least_weight)
    for w, f in sorted(strong, key=lambda x: (-x[0], -len(x[1].rstrip("*")), x[1])):
        body = f.rstrip("*")
        above = [body[:k] + "*" for k in STEMS if k < len(body) + (f[-1] != "*")]
        if not any(s in chosen for s in above) and explained[f] < 0.8 * held[f]:
            chosen[f] = round(w, 6)
            for s in above:
                explained[s] += held[f]
    return chosen, threats


class Grammar:
    """The composed transducers with the weights of a lexicon."""

    def __init__(self, words: dict[str, float], threats: dict[str, float]):
        self.words, self.threats = words, threats
        self.table, self.ends = tabled(GRAMMAR)
        self.anchors = ahocorasick.Automaton()
        for entry in {*(f.rstrip("*") for f in words), *THREAT_FORMS}:
            self.anchors.add_word(entry, len(entry))
        self.anchors.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of a word as an insult."""
        found = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                found = max(found, self.words.get(word[:n] + "*", 0.0))
        return found

    def letter(self, word: str) -> tuple[int, float, float]:
        """A word's letter, its weight as an insult and as a threat."""
        if word in PAUSES:
            return PAUSE, 0.0, 0.0
        if word in TURNS:
            return TURN, 0.0, 0.0
        insult, threat = self.insult(word), self.threats.get(THREAT_FORMS.get(word, ""), 0.0)
        negation = NEGATION if word in NEGATIONS or word.endswith("n't") else 0
        marks = (INSULT if insult > 0 else 0) | (THREAT if threat > 0 else 0) | negation
        return marks | (TARGET if word in TARGETS else 0) | (REPORT if word in REPORTS else 0), insult, threat

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The words and commas of the clauses that hold an anchor, each clause once."""
        text = lowered(text)
        done = -1
        for last, size in self.anchors.iter(text):
            first = last + 1 - size
            if first < done or (first and text[first - 1].isalpha()):
                continue
            start = first
            while start > 0 and text[start - 1] not in CLAUSE_END:
                start -= 1
            end = last + 1
            while end < len(text) and text[end] not in CLAUSE_END:
                end += 1
            done = end
            yield TOKEN.findall(text, start, end)

    def matched(self, words: list[str]) -> dict[str, float]:
        """The ways in which a clause matches, each with the weight of its best path."""
        live = {0: 0.0}
        for word in words:
            letter, insult, threat = self.letter(word)
            after: dict[int, float] = {}
            for state, so_far in live.items():
                for to, out in self.table[state][letter]:
                    weight = insult if out == INSULT else threat if out == THREAT else so_far
                    if weight > after.get(to, -1.0):
                        after[to] = weight
            live = after
        best: dict[str, float] = {}
        for state, weight in live.items():
            if self.ends[state] >= 0:
                way = WAYS[self.ends[state]]
                best[way] = max(best.get(way, 0.0), weight)
        return best

    def read(self, text: str) -> list[float]:
        """For each way the best weight of a clause, then the log of one more than the number of matches."""
        best, n = dict.fromkeys(WAYS, 0.0), 0
        for words in self.clauses(text):
            for way, weight in self.matched(words).items():
                n += 1
                best[way] = max(best[way], weight)
        return [*best.values(), math.log1p(n)]


@dataclass
class Model:
    """A grammar's lexicon and the weights of the ways to match."""

    words: dict[str, float]
    threats: dict[str, float]
    weights: list[float]
    bias: float

    def score(self, read: list[float]) -> float:
        x = self.bias + sum(w * v for w, v in zip(self.weights, read))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), 9)


def learned(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> Model:
    """The model of the training rows; without toxic rows every score is the share of toxic rows, smoothed."""
    rows = training_rows(docs, labels, how)
    lexica = lexicon(rows, how)
    shared = rows.sparkSession.sparkContext.broadcast(lexica)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*shared.value)
        for batch in batches:
            read = [grammar.read(t) if t else [0.0] * (len(WAYS) + 1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(read, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    # equal rows come together first; what is left is bounded by the sample
    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(WAYS) + 1)
    weights, bias = fitted(x, np.array([r.y for r in found], float), np.array([r["count"] for r in found], float), how)
    return Model(*lexica, weights, bias)


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, how: Learning) -> tuple[list[float], float]:
    """Logistic regression by Newton's method, with a ridge around the weights ways have without evidence.

    The order of rows does not matter.
    """
    order = np.lexsort((*x.T, y)) if len(x) else np.empty(0, int)
    x, y, n = np.column_stack((x[order], np.ones(len(order)))), y[order], n[order]
    ways = [how.distanced if "_neg" in way or "_rep" in way else how.aimed if way.endswith("_target") else how.plain for way in WAYS]
    prior = np.array([*ways, 0.0, 0.0])
    w = prior.copy()
    penalty = np.diag([how.ridge] * (x.shape[1] - 1) + [0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - penalty @ (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 6) for v in w[:-1]], round(float(w[-1]), 6)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score``, ``predicted`` and ``n_clauses`` (matches in clauses).

    Every text is read whole. A null or empty text has no clause and the score of one. A null id is in no fold.
    Repeated rows each give a result row; extra columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        grammar = Grammar(own.words, own.threats)
        for batch in batches:
            read = [grammar.read(t) if t else [0.0] * (len(WAYS) + 1) for t in batch.column(1).to_pylist()]
            scores = [own.score(r) for r in read]
            clauses = [round(math.expm1(r[-1])) for r in read]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(clauses, pa.int64())], names=["doc_id", "score", "n_clauses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, n_clauses long")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
