"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, given by knots with straight lines between them. Its
integral is the source's weight; all weights share the words of the corpus, no source above ``repeats`` times its own.
A source's documents stand in a fixed order (by the digest of their id) and are read again from the start until the
target is met; the last one may be read in part. A visit that begins at word c of a target of T words is due at the
time at which the integral of the schedule reaches c / T of the whole: that is its training position. The visits,
sorted by ranges of the position, are the training order.

Words before a document are counted in two steps: per source and bucket of the digest, then inside a bucket. So no
source, however large, meets in one task. All of it is DataFrame expressions; texts are only read to count words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, settled

WORD = r"[^\x20\x09-\x0D]+"
RUN = 4096  # copies of a row laid out by one step


@dataclass(frozen=True)
class Curriculum:
    """Schedules as knots (time, weight), dealt to the sources in turn, and the most a document is repeated."""

    schedules: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.5), (1.0, 0.5)),
        ((0.0, 2.0), (1.0, 2.0)),
        ((0.0, 2.0), (1.0, 4.0)),
    )
    repeats: int = 3

    def weights(self) -> list[float]:
        """The integrals of the schedules."""
        return [sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(s, s[1:])) for s in self.schedules]

    def weight(self, turn: Column) -> Column:
        found = F.lit(None).cast("double")
        for i, w in enumerate(self.weights()):
            found = F.when(turn == i, F.lit(w)).otherwise(found)
        return found

    def time(self, turn: Column, share: Column) -> Column:
        """The time at which the integral of a schedule reaches a share (0 to 1) of the whole."""
        found = F.lit(None).cast("double")
        for i, knots in enumerate(self.schedules):
            found = F.when(turn == i, _inverted(knots, share * F.lit(self.weights()[i]))).otherwise(found)
        return found


def _inverted(knots: tuple[tuple[float, float], ...], amount: Column) -> Column:
    """Where the integral of a line through the knots reaches an amount."""
    found, before, steps = F.lit(knots[-1][0]), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        steps.append((t0, w0, t1 - t0, w1 - w0, before))
        before += (t1 - t0) * (w0 + w1) / 2
    for t0, w0, width, rise, start in reversed(steps):
        z = (amount - F.lit(start)) / F.lit(width)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * rise) * z, F.lit(0.0)))
        at = F.lit(t0) + F.lit(width) * (F.lit(2.0) * z / (F.lit(w0) + root))
        inside = F.when(z <= 0, F.lit(t0)).otherwise(at)
        end = start + width * (w0 + w0 + rise) / 2
        found = F.when(amount <= F.lit(end), inside).otherwise(found)
    return found


def sized(docs: DataFrame) -> DataFrame:
    """``source``, ``doc_id``, ``size`` in words, and ``copies``, how many rows agree in the three."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    return rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))


def targets(counted: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """Per source ``source``, ``turn`` (which schedule it has), ``source_size``, ``target``.

    Sources above their bound are held at it and the rest is shared again by weight until none is above. A round is
    one aggregate over the sources; the driver sees sums only.
    """
    sums = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = numbered(sums, F.asc_nulls_last("source"))
    turn = (F.col("place") % len(plan.schedules)).cast("int")
    sources = settled(sources.select("source", turn.alias("turn"), plan.weight(turn).alias("weight"), "source_size"))
    most = F.col("source_size") * plan.repeats
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:
        bound = F.lit(False) if level is None else most < F.lit(level) * F.col("weight")
        n, words, weight = sources.agg(
            F.count(F.when(bound, 1)), F.coalesce(F.sum(F.when(bound, most)), F.lit(0)), F.coalesce(F.sum(F.when(~bound, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == held or not weight:
            break
        level, held = (whole - words) / weight, n
    target = F.least(most.cast("double"), F.lit(level or 0.0) * F.col("weight"))
    return sources.select("source", "turn", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def allotted(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``visits``.

    ``visits`` lists, in order, each reading of the document with its ``position`` (0 to 1) and ``words`` (all, or for
    the last one of a source its first words). A null text has no words and no visits; a null source is a source of its
    own, behind all others; a null id is an id like any other. Repeated rows are read one after the other. Extra columns
    are ignored; an empty table gives an empty result.
    """
    counted = settled(sized(docs))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = counted.select(
        _key(F.col("source")).alias("key"), F.substring(digest, 1, 3).alias("bucket"), digest.alias("digest"), "*",
        (F.col("size") * F.col("copies")).alias("words"),
    )
    buckets = rows.groupBy("key", "bucket").agg(F.sum("words").alias("words"))
    earlier = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select("key", "bucket", earlier(W.partitionBy("key").orderBy("bucket")).alias("before"))
    sources = targets(counted, plan).withColumn("key", _key(F.col("source"))).drop("source")
    starts = buckets.join(sources, "key").withColumnRenamed("key", "_key").withColumnRenamed("bucket", "_bucket")
    inside = earlier(W.partitionBy("key", "bucket").orderBy("digest", F.asc_nulls_last("doc_id"), "size"))
    placed = rows.withColumn("inside", inside).join(starts, (F.col("key") == F.col("_key")) & (F.col("bucket") == F.col("_bucket")))
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    last = F.least(F.col("run") + RUN, F.col("copies")) - 1
    each = runs.withColumn("copy", F.explode(F.sequence("run", last)))
    first = F.col("before") + F.col("inside") + F.col("copy") * F.col("size")
    due = F.floor("target")

    def visit(i: Column) -> Column:
        start = first + i * F.col("source_size")
        return F.struct(start.alias("start"), F.greatest(F.least(start + F.col("size"), due) - start, F.lit(0)).cast("long").alias("words"))

    visits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(plan.repeats - 1)), visit), lambda v: v["words"] > 0)
    position = lambda v: plan.time(F.col("turn"), v["start"].cast("double") / due.cast("double"))
    visits = F.transform(visits, lambda v: F.struct(position(v).alias("position"), v["words"].alias("words")))
    return each.select("doc_id", "source", "size", "source_size", "target", visits.alias("visits"))


def training_order(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """One row per reading of a document, ``position``, ``source``, ``doc_id``, ``visit``, ``words``, sorted by ranges of position."""
    rows = allotted(docs, plan).select("doc_id", "source", F.posexplode("visits").alias("visit", "v"))
    rows = settled(rows.select(F.col("v.position").alias("position"), "source", "doc_id", "visit", F.col("v.words").alias("words")))
    order = (F.asc("position"), F.asc_nulls_last("source"), F.asc_nulls_last("doc_id"), F.asc("visit"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mixture(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """Per document its ``size``, ``source_size``, ``target``, ``taken`` words and ``first_position``, in training order.

    Documents the mix does not take come last.
    """
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda n, v: n + v["words"])
    rows = allotted(docs, plan).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.round(F.get("visits", F.lit(0))["position"], 9).alias("first_position")
    )
    order = (F.asc_nulls_last("first_position"), F.asc_nulls_last("doc_id"), F.asc("size"))
    return settled(rows).repartitionByRange(*order).sortWithinPartitions(*order)
