"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of four terms, normalised over the languages and the class ``und`` (no
language of the list):

* text: a model of adjacent letter pairs of each language, counted over all texts that declare it. The log-likelihood
  is tempered, since neighbouring pairs are not independent;
* declared markup language: right with a probability that is measured on the text evidence of all rows, per source;
* address suffix: the same, for the country part of a host name or a language directory in the path;
* prior: how often a host holds each language, smoothed towards its domain suffix, which is smoothed towards the whole
  corpus. All counts come from grouped aggregates with partial sums, so a host with a third of all rows costs no more.

The model has a fixed size (languages x ``BUCKETS`` pair classes); it is summed by Spark and broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, settled

LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
# Country parts of host names, by the language most pages there are in.
COUNTRIES = {"en": "uk us au nz ie", "de": "de at", "fr": "fr", "es": "es mx ar cl co pe"}
# classes of letter pairs: 1024 hashed letters squared would be sparse, pairs are hashed into this many
BUCKETS = 1 << 14


@dataclass(frozen=True)
class Fusion:
    """Production parameters."""

    languages: tuple[str, ...] = LANGUAGES
    temper: float = 0.25  # share of the text's log-likelihood that counts
    most_text: float = 60.0  # a text's evidence is at most this many nats
    declared_right: float = 0.9  # weight of a declared language before it is measured
    smooth: float = 20.0  # rows a parent level counts for in its child's prior
    unknown_prior: float = 0.01
    unknown_slack: float = 3.0  # nats per pair above which a text is unlike every language
    least: float = 0.5  # smallest posterior that is accepted
    broadcast_hosts: int = 100_000  # priors of at most so many hosts are broadcast; the result is the same either way


def pair_codes(text: str) -> np.ndarray:
    """Classes of the adjacent pairs of lowered letters; pairs of a letter and a blank mark words' ends."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letters = np.where(_IS_LETTER[np.minimum(chars, len(_IS_LETTER) - 1)], chars, np.uint32(32))
    if len(letters) < 2:
        return np.empty(0, dtype=np.int64)
    left, right = letters[:-1], letters[1:]
    mixed = (left * np.uint32(0x9E3779B1) + right) * np.uint32(0x85EBCA6B)
    codes = (mixed >> np.uint32(18)).astype(np.int64)
    return codes[(left != 32) | (right != 32)]


_IS_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)] + [True])


def pair_counts(docs: DataFrame, languages: tuple[str, ...], text: str, declared: str) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all texts that declare one of the languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        place = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value:
                    counts[place[lang]] += np.bincount(pair_codes(value), minlength=BUCKETS)
        rows, buckets = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([languages[r] for r in rows], pa.string()), pa.array(buckets, pa.int32()), pa.array(counts[rows, buckets], pa.int64())],
            names=["lang", "bucket", "n"],
        )

    rows = docs.where(F.col(declared).isin(*languages)).select(F.col(declared).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class PairModel:
    """Log-probabilities of pair classes, and how likely a text of a language usually is per pair."""

    def __init__(self, languages: tuple[str, ...], rows: list[tuple[str, int, int]]):
        counts = np.zeros((len(languages), BUCKETS))
        for lang, bucket, n in rows:
            counts[languages.index(lang), bucket] = n
        share = counts.sum(axis=0) + 1.0
        share /= share.sum()
        # each language is smoothed by what all hold together
        self.log = np.log((counts + 200.0 * share) / (counts.sum(axis=1, keepdims=True) + 200.0))
        p = np.exp(self.log)
        self.usual = (p * self.log).sum(axis=1)

    def of(self, text: str) -> tuple[list[float], int]:
        codes = pair_codes(text)
        return self.log[:, codes].sum(axis=1).tolist(), len(codes)


def pair_model(docs: DataFrame, fusion: Fusion, text: str = "text", declared: str = "lang") -> PairModel:
    """The model of a corpus; at most languages x ``BUCKETS`` numbers reach the driver."""
    rows = pair_counts(docs, fusion.languages, text, declared).collect()
    return PairModel(fusion.languages, [(r.lang, r.bucket, r.n) for r in rows])


def text_evidence(docs: DataFrame, model: PairModel, fusion: Fusion, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with ``_text``: tempered log-likelihoods of the languages and of ``und``, zero at the best; null without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for value in batch.column(place).to_pylist():
                logs, n = own.of(value) if value else ([], 0)
                if not n:
                    out.append(None)
                    continue
                # a text of no language is less likely, pair by pair, than a language's own texts are
                every = [x * fusion.temper for x in (*logs, (own.usual.max() - fusion.unknown_slack) * n)]
                top = max(every)
                out.append([max(x - top, -fusion.most_text) for x in every])
            columns = [batch.column(i) for i in kept] + [pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in kept), "_text"])

    fields = [docs.schema.fields[i] for i in kept]
    return docs.mapInArrow(lean(run), T.StructType([*fields, T.StructField("_text", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Evidence:
    """Where the other evidence lies: columns of the rows, None where there is none."""

    declared: Column
    host: Column
    domain: Column | None = None
    hint: Column | None = None


def fused(scored: DataFrame, where: Evidence, fusion: Fusion = Fusion()) -> DataFrame:
    """The rows of ``text_evidence`` with ``language``, ``posterior``, ``text_language`` and ``accepted``.

    A null or unlisted declaration, host or hint adds nothing. A text without letters is ``und`` and not accepted.
    """
    names = [*fusion.languages, UNKNOWN]
    none = F.lit(None).cast("string")
    best = F.array_position("_text", F.array_max("_text")).cast("int")
    rows = scored.withColumns({
        "_declared": F.when(where.declared.isin(*fusion.languages), where.declared),
        "_host": where.host.cast("string"),
        "_domain": none if where.domain is None else where.domain.cast("string"),
        "_hint": none if where.hint is None else F.when(where.hint.isin(*fusion.languages), where.hint),
        "text_language": F.when(F.col("_text").isNull(), UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, names)), best)),
    })
    seen = settled(rows.where("_text is not null").groupBy("_host", "_domain", "_declared", "_hint", "text_language").agg(F.count("*").alias("n")))
    rows = _with_priors(rows, seen, names, fusion)
    right = {c: _confusion(seen, c, names, fusion) for c in ("_declared", "_hint")}
    logs = []
    for i, name in enumerate(names):
        log = F.col("_text")[i] + F.log(F.col(f"_prior_{i}"))
        for column, table in right.items():
            chosen = F.lit(0.0)
            for said in fusion.languages:
                chosen = F.when(F.col(column) == said, table[name, said]).otherwise(chosen)
            log = log + chosen
        logs.append(log)
    rows = rows.withColumn("_logs", F.array(*logs)).withColumn("_top", F.array_max("_logs"))
    total = F.aggregate("_logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_top")))
    place = F.array_position("_logs", F.col("_top")).cast("int")
    rows = rows.withColumns({
        "language": F.when(F.col("_text").isNull(), UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, names)), place)),
        "posterior": F.when(F.col("_text").isNull(), 0.0).otherwise(1 / total),
    })
    rows = rows.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= fusion.least))
    return rows.drop("_text", "_declared", "_host", "_domain", "_hint", "_logs", "_top", *(f"_prior_{i}" for i in range(len(names))))


def _with_priors(rows: DataFrame, seen: DataFrame, names: list[str], fusion: Fusion) -> DataFrame:
    """Adds a prior per language: the host's counts over the domain's over the corpus'."""
    counts = [F.sum(F.when(F.col("text_language") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(names)]
    total = seen.agg(*counts).first()
    whole = sum(x or 0 for x in total)
    start = [((total[i] or 0) + fusion.smooth * (fusion.unknown_prior if name == UNKNOWN else (1 - fusion.unknown_prior) / len(fusion.languages))) / (whole + fusion.smooth) for i, name in enumerate(names)]
    columns = range(len(names))
    smoothed = lambda i, parent: (F.col(f"n{i}") + fusion.smooth * parent) / (sum((F.col(f"n{j}") for j in columns), F.lit(0.0)) + fusion.smooth)
    domains = seen.where("_domain is not null").groupBy("_domain").agg(*counts)
    domains = domains.select("_domain", *(smoothed(i, F.lit(start[i])).alias(f"d{i}") for i in columns))
    hosts = seen.where("_host is not null").groupBy("_host", "_domain").agg(*counts).join(domains, "_domain", "left")
    hosts = hosts.select("_host", "_domain", *(smoothed(i, F.coalesce(f"d{i}", F.lit(start[i]))).alias(f"_prior_{i}") for i in columns))
    hosts = hosts.withColumnsRenamed({"_host": "_h", "_domain": "_d"})
    same = (F.col("_host") == F.col("_h")) & F.col("_domain").eqNullSafe(F.col("_d"))
    hosts = settled(hosts)
    # a row of a host is six numbers and two names; a longer table goes through a shuffle join, hot hosts split
    small = hosts.count() <= fusion.broadcast_hosts
    joined = rows.join(F.broadcast(hosts) if small else hosts, same, "left").drop("_h", "_d")
    return joined.withColumns({f"_prior_{i}": F.coalesce(f"_prior_{i}", F.lit(start[i])) for i in columns})


def _confusion(seen: DataFrame, column: str, names: list[str], fusion: Fusion) -> dict[tuple[str, str], float]:
    """log P(said | true language), by counting what is said against the text's own language; languages squared."""
    rows = seen.where(F.col(column).isNotNull()).groupBy("text_language", column).agg(F.sum("n").alias("n")).collect()
    n = {(r[0], r[1]): r[2] for r in rows}
    said, out = fusion.languages, {}
    for true in names:
        total = sum(n.get((true, s), 0) for s in said)
        for s in said:
            wrong = (1 - fusion.declared_right) / max(1, len(said) - 1)
            start = 1 / len(said) if true == UNKNOWN else fusion.declared_right if s == true else wrong
            out[true, s] = math.log((n.get((true, s), 0) + fusion.smooth * start) / (total + fusion.smooth))
    return out


def document_evidence() -> Evidence:
    """Documents declare a language; their source stands for the host."""
    return Evidence(declared=F.col("lang"), host=F.col("source"))


def page_evidence() -> Evidence:
    """Pages declare it in the markup; addresses end in a country or begin with a language."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    first = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    spoken = F.coalesce(*(F.when(country.isin(*codes.split()), lang) for lang, codes in COUNTRIES.items()))
    return Evidence(
        declared=F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)),
        host=F.when(host != "", host), domain=F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        hint=F.coalesce(F.when(first.isin(*LANGUAGES), first), spoken),
    )


def identified_documents(docs: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """Per document ``doc_id``, ``language``, ``posterior``, ``text_language``, ``accepted``.

    Null or empty texts and texts without letters are ``und`` and not accepted; repeated rows each give a result row;
    extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    scored = settled(text_evidence(rows, pair_model(rows, fusion), fusion, keep_text=False))
    return fused(scored, document_evidence(), fusion).select("doc_id", "language", "posterior", "text_language", "accepted")


def accepted_documents(docs: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """The documents whose language is found, all columns; others go."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
    rows = docs.withColumnsRenamed(names)
    out = fused(text_evidence(rows, pair_model(rows, fusion), fusion), document_evidence(), fusion).where("accepted")
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def identified_pages(pages: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """Per page ``page_id``, ``language``, ``posterior``, ``text_language``, ``accepted``; as for documents."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    where = page_evidence()
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), where.declared.alias("said"), where.host.alias("host"),
        where.domain.alias("domain"), where.hint.alias("hint"), bare.alias("text"),
    )
    scored = settled(text_evidence(rows, pair_model(rows, fusion, declared="said"), fusion, keep_text=False))
    columns = Evidence(F.col("said"), F.col("host"), F.col("domain"), F.col("hint"))
    return fused(scored, columns, fusion).select("page_id", "language", "posterior", "text_language", "accepted")
