"""Quality rules: robust multivariate outliers.

Fixed rules come first (too few words, too much repetition). For the rest a vector of transformed statistics per
document is held against its language and source: the minimum-covariance-determinant estimate of centre and spread is
found by concentration steps, and a document whose Mahalanobis distance exceeds a chi-square bound is rejected.

Each group has three starts, none of them drawn at random: medians with quartile spreads, the products of values bent
by tanh, and those of spatial signs. All take ``first_steps`` concentration steps; the start whose core then has the
least determinant goes on until the determinant falls no more. A step that does not lower the determinant is not taken.

Every step is a grouped aggregate with partial sums: a concentration step takes the share ``core`` of a group's rows
nearest to the present centre (the bound comes from a histogram of distances, so ties fall on one side), and sums
their values and products. Groups too small for an estimate are pooled by language, and what is still small over all.
Centres and inverse spreads are rows, a few per group, broadcast to the documents up to ``most_sent`` groups and joined
by a shuffle beyond.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMORY_WORDS, settled, with_nulls_as_empty

FEATURES = ("word_length", "symbols", "upper", "repeats", "dup_lines", "marks")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    least_words: int = 50
    most_repeats: int = 50  # percent of words in repeated windows
    core: float = 0.75  # share of a group's rows the estimate rests on
    first_steps: int = 2  # concentration steps of every start
    steps: int = 20  # of the best start at most
    most_sent: int = 10_000  # groups up to which estimates are broadcast
    least_rows: int = 200  # smaller groups are pooled
    cutoff: float = 1e-3  # probability, under the core's normal law, of a distance past the bound
    # least standard deviation of each feature; the core of a clean corpus may not vary at all in some
    floors: tuple[float, ...] = (0.05, 0.05, 0.05, 0.10, 0.10, 0.05)


class Numbers(dict):
    """A number for each word, from a counter that starts again when memory is emptied between texts."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def statistics(text: bytes, numbers: Numbers) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the features."""
    words = text.split()
    n = len(words)
    size = len(text.decode())
    blanks = len(text) - len(text.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup_lines, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    if len(numbers) > MEMORY_WORDS:
        numbers.clear()
    repeats = repeated_words(np.fromiter(map(numbers.__getitem__, words), np.int64, n))
    chars = size - blanks
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, b".,;:!?\"'()"))
    each = max(1, chars)
    features = (
        math.log(max(1.0, chars / max(1, n))), math.sqrt(symbols / each), math.sqrt(upper / each),
        math.sqrt(repeats / max(1, n)), math.sqrt(dup_lines / max(1, lines)), math.sqrt(marks / each),
    )
    return (n, chars, symbols, dup_lines, repeats, *(round(x, 4) for x in features))


def repeated_words(words: np.ndarray) -> int:
    """Words inside a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    _, small = np.unique(words, return_inverse=True)
    k = int(small.max()) + 1
    # pairs are renumbered first, so that a window's number fits whatever the number of words
    _, pairs = np.unique(small[:-1] * k + small[1:], return_inverse=True)
    _, window, counts = np.unique(pairs[:-1] * k + small[2:], return_inverse=True, return_counts=True)
    twice = counts[window] > 1
    hit = np.zeros(len(words), dtype=bool)
    for i in range(3):
        hit[i : i + len(twice)] |= twice
    return int(hit.sum())


def measured(docs: DataFrame) -> DataFrame:
    """Per row the statistics and features; a null text has none of anything."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        kinds = [pa.int64()] * len(counts) + [pa.float64()] * len(FEATURES)
        for batch in batches:
            rows = [statistics(t, numbers) for t in with_nulls_as_empty(batch.column(3).cast(pa.binary()).to_pylist())]
            columns = list(zip(*rows)) or [()] * len(kinds)
            arrays = [batch.column(i) for i in range(3)] + [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "source", *counts, *FEATURES])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, lang string, source string, "
    schema += ", ".join([*(f"{c} long" for c in counts), *(f"{c} double" for c in FEATURES)])
    return rows.mapInArrow(run, schema)


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document the statistics, ``base_failed``, ``distance`` (null where a rule decides) and ``kept``.

    Null and empty texts have no words and fail. A null language or source is a group of its own. Repeated rows each
    give a result row; extra columns are ignored; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < rules.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeats)
    rows = settled(measured(docs).withColumn("base_failed", failed))
    groups = _groups(rows.where("not base_failed"), rules)
    rows = rows.join(groups, [F.col("lang").eqNullSafe(F.col("_lang")), F.col("source").eqNullSafe(F.col("_source"))], "left")
    fit = settled(rows.where("not base_failed").select("grp", *FEATURES))
    estimate = least_determinant(fit, rules)
    placed = rows.join(estimate.withColumnRenamed("grp", "_grp"), F.col("grp") == F.col("_grp"), "left")
    distance = F.when(~F.col("base_failed"), _distance())
    bound = chi_square_bound(len(FEATURES), rules.cutoff)
    out = placed.withColumn("distance", distance)
    # the spread of a core is too small by a factor that depends on its share only
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= bound * core_factor(rules.core, len(FEATURES)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def least_determinant(fit: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per group ``grp`` the estimate ``centre``, ``inverse`` of least determinant, its logarithm in ``log_det``."""
    first = settled(_first_estimate(fit, rules))
    # proven: what is broadcast has a row per group and start
    sent = F.broadcast if first.count() <= rules.most_sent else lambda df: df
    estimate = settled(_starts(fit, first, rules, sent))
    for _ in range(rules.first_steps):
        estimate = settled(_concentrated(fit, estimate, rules, sent))
    best = F.min(F.struct(F.round("log_det", 6).alias("rounded"), "start", "centre", "inverse", "log_det", "fell")).alias("b")
    estimate = settled(estimate.groupBy("grp").agg(best).select("grp", "b.start", "b.centre", "b.inverse", "b.log_det", "b.fell"))
    for _ in range(rules.steps):
        if estimate.where("fell").isEmpty():
            break
        estimate = settled(_concentrated(fit, estimate, rules, sent))
    return sent(estimate.select("grp", "centre", "inverse", "log_det"))


def _groups(rows: DataFrame, rules: Rules) -> DataFrame:
    """``_lang``, ``_source`` to the group whose estimate they take."""
    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < rules.least_rows)
    pooled = small.groupBy("lang").agg(F.sum("n").alias("m")).withColumnRenamed("lang", "_l")
    named = n.join(pooled, F.col("lang").eqNullSafe(F.col("_l")), "left")
    own = F.concat(F.lit("s:"), F.to_json(F.struct("lang", "source")))
    by_lang = F.concat(F.lit("l:"), F.to_json(F.struct("lang")))
    grp = F.when(F.col("n") >= rules.least_rows, own).when(F.col("m") >= rules.least_rows, by_lang).otherwise(F.lit("all"))
    return named.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), grp.alias("grp"))


def _quantile(counts: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The least value of each key up to which a share of the rows lies, from ``keys``, value and count ``c``."""
    w = Window.partitionBy(*keys)
    run = F.sum("c").over(w.orderBy(value))
    return (
        counts.withColumns({"_run": run, "_all": F.sum("c").over(w)})
        .where(F.col("_run") >= F.col("_all") * share).groupBy(*keys).agg(F.min(value).alias(value))
    )


def _first_estimate(fit: DataFrame, rules: Rules) -> DataFrame:
    """Medians and, from the quartiles, spreads of the single features; values lie on a grid, so counts stay few."""
    long = fit.select("grp", F.posexplode(F.array(*FEATURES)).alias("f", "v")).groupBy("grp", "f", "v").agg(F.count("*").alias("c"))
    cuts = None
    for name, share in (("low", 0.25), ("mid", 0.5), ("high", 0.75)):
        one = _quantile(long, ["grp", "f"], "v", share).withColumnRenamed("v", name)
        cuts = one if cuts is None else cuts.join(one, ["grp", "f"])
    spread = ((F.col("high") - F.col("low")) / 1.349).alias("spread")
    rows = cuts.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("f", "mid", spread))).alias("s"))
    # a diagonal spread, in the same form as a full one
    p = len(FEATURES)
    parts = [F.lit(0.0) if i != j else 1 / F.pow(F.greatest(F.col("s")[i]["spread"], F.lit(rules.floors[i])), 2) for i in range(p) for j in range(p)]
    return rows.select("grp", F.array(*(F.col("s")[i]["mid"] for i in range(p))).alias("centre"), F.array(*parts).alias("inverse"))


def _distance() -> Column:
    p = len(FEATURES)
    off = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    return sum((off[i] * off[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)), F.lit(0.0))


def _products(of: list[Column]) -> list[Column]:
    """Sums of the values and of their products in pairs."""
    p = len(of)
    return [F.sum(v).alias(f"s{i}") for i, v in enumerate(of)] + [F.sum(of[i] * of[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]


def _means(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The means of values and of products."""
    p = len(FEATURES)
    square = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            square[i, j] = square[j, i] = row[f"q{i}_{j}"] / row["n"]
    return np.array([row[f"s{i}"] for i in range(p)]) / row["n"], square


_ESTIMATE = pa.schema([
    ("grp", pa.string()), ("start", pa.int32()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())),
    ("log_det", pa.float64()), ("fell", pa.bool_()),
])
_ESTIMATE_DDL = "grp string, start int, centre array<double>, inverse array<double>, log_det double, fell boolean"


def _starts(fit: DataFrame, first: DataFrame, rules: Rules, sent: Callable) -> DataFrame:
    """Three estimates per group, from one pass; they have no core yet, so no determinant."""
    p = len(FEATURES)
    z = [(F.col(f) - F.col("centre")[i]) * F.sqrt(F.col("inverse")[i * p + i]) for i, f in enumerate(FEATURES)]
    rows = fit.join(sent(first), "grp").select("grp", *(v.alias(f"z{i}") for i, v in enumerate(z)))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0)))
    bent = [F.tanh(f"z{i}") for i in range(p)]
    signs = [F.when(length > 0, F.col(f"z{i}") / length).otherwise(0.0) for i in range(p)]
    kinds = [F.lit(k).alias("start") for k in (1, 2)]
    each = [rows.select("grp", kind, *(v.alias(f"v{i}") for i, v in enumerate(of))) for kind, of in zip(kinds, (bent, signs))]
    sums = each[0].union(each[1]).groupBy("grp", "start").agg(F.count("*").alias("n"), *_products([F.col(f"v{i}") for i in range(p)]))
    floors = np.array(rules.floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                centre, square = _means(row)
                # back from units of the quartile spreads; the products' common factor does not matter to the order
                unit = 1 / np.sqrt(np.array(row["inverse"]).reshape(p, p).diagonal())
                scale = p / max(1e-12, np.trace(square))
                spread = floored(square * scale * np.outer(unit, unit), floors)
                out.append({"grp": row["grp"], "start": row["start"], "centre": row["centre"], "inverse": np.linalg.inv(spread).ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=_ESTIMATE)

    made = sums.join(first, "grp").mapInArrow(run, _ESTIMATE_DDL)
    plain = first.select("grp", F.lit(0).alias("start"), "centre", "inverse", F.lit(None).cast("double").alias("log_det"), F.lit(None).cast("boolean").alias("fell"))
    return plain.union(made)


def _concentrated(fit: DataFrame, estimate: DataFrame, rules: Rules, sent: Callable) -> DataFrame:
    """Each estimate from the rows nearest to it, where that lowers the determinant (``fell``); else as it was."""
    # distances in steps of about a hundredth of their size
    step = F.round(F.log1p(F.greatest(_distance(), F.lit(0.0))) * 100).cast("int")
    near = fit.join(sent(estimate.select("grp", "start", "centre", "inverse")), "grp").withColumn("step", step).drop("centre", "inverse")
    bound = _quantile(near.groupBy("grp", "start", "step").agg(F.count("*").alias("c")), ["grp", "start"], "step", rules.core)
    core = near.join(sent(bound.withColumnRenamed("step", "most")), ["grp", "start"]).where("step <= most")
    moments = core.groupBy("grp", "start").agg(F.count("*").alias("n"), *_products([F.col(f) for f in FEATURES]))
    floors = np.array(rules.floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                centre, square = _means(row)
                spread = floored(square - np.outer(centre, centre), floors)
                log_det = float(np.linalg.slogdet(spread)[1])
                new = {"grp": row["grp"], "start": row["start"], "centre": row["centre"], "inverse": row["inverse"], "log_det": row["log_det"], "fell": False}
                if row["log_det"] is None or log_det < row["log_det"] - 1e-6:
                    new |= {"centre": centre.tolist(), "inverse": np.linalg.inv(spread).ravel().tolist(), "log_det": log_det, "fell": True}
                out.append(new)
            yield pa.RecordBatch.from_pylist(out, schema=_ESTIMATE)

    return moments.join(estimate.drop("fell"), ["grp", "start"]).mapInArrow(run, _ESTIMATE_DDL)


def floored(spread: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """The spread with at least the floors' variance in every direction, measured in units of the floors."""
    scaled = spread / np.outer(floors, floors)
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * np.outer(floors, floors)


def chi_square_bound(p: int, tail: float) -> float:
    """The value a chi-square variable with p degrees of freedom exceeds with that probability, by halving."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(p, mid) > tail else (low, mid)
    return high


def chi_square_tail(p: int, x: float) -> float:
    """For even p: a Poisson sum."""
    if p % 2:
        raise ValueError("an even number of features is expected")
    term = total = math.exp(-x / 2)
    for i in range(1, p // 2):
        term *= x / 2 / i
        total += term
    return total


def core_factor(share: float, p: int) -> float:
    """By how much the normal law's spread exceeds that of its core."""
    q = chi_square_bound(p, 1 - share)
    return share / (1 - chi_square_tail(p + 2, q))
