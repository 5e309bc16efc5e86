"""Ranks and percentiles over groups of any size.

A window ordered over one group runs in one task, so a group that holds a third of the rows would decide the
run time. Equal values are counted first (with map-side combine). Groups with few distinct values then take
the plain window. A group with more than a ten-thousandth of them (so there are fewer than ten thousand such
groups, which makes their list safe to broadcast) is cut into ranges at approximate quantiles: each range is
summed in its own task, and the range totals (at most ``BUCKETS`` rows per group) give the offsets. The
quantiles only steer the balance; the counts are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024
ACCURACY = 2000  # the cuts are off by at most 1/2000 of the values, half a bucket
HEAVY_SHARE = 10_000  # a heavy group has more than 1 / HEAVY_SHARE of the distinct values ...
HEAVY_FLOOR = 200_000  # ... and more than this many


def _bucket(value: str, bounds: Column, buckets: int) -> Column:
    """Number of bounds below the value, by binary search over the sorted bounds array."""
    steps = []
    half = buckets // 2
    while half:
        steps.append(F.lit(half))
        half //= 2

    def step(pos, half):
        return pos + F.when(F.get(bounds, pos + half - 1) < F.col(value), half).otherwise(0)

    # coalesce: a column that cannot be null keeps the optimizer from filtering on it below the aggregate
    return F.coalesce(F.aggregate(F.array(*steps), F.lit(0), step), F.lit(0))


def cumulative_counts(
    df: DataFrame, keys: list[str], value: str, weight: str | None = None, buckets: int = BUCKETS, floor: int = HEAVY_FLOOR
) -> DataFrame:
    """One row per (keys, value): ``ties`` at the value, ``below`` it and ``total`` of the group.

    ``weight`` sums a column instead of counting rows; null values and null keys are left out. ``buckets`` must be a power
    of two.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    # every caller joins the counts back on equal keys, so a group with a null key has no use
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    grouped = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.cast("bigint").alias("ties"))
    if not keys:
        return _by_ranges(grouped, keys, value, buckets)
    # the test on ties is always true; with it the sizes and quantiles read the same exchange as the counts
    grouped = grouped.where(F.col("ties") >= 0)
    sizes = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = sizes.select((F.sum("_n") / HEAVY_SHARE).cast("bigint")).scalar()
    heavy = F.broadcast(sizes.where(F.col("_n") > F.greatest(F.coalesce(share, F.lit(0)), F.lit(floor))).select(*keys))
    group = W.partitionBy(*keys)
    below = F.sum("ties").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    light = grouped.join(heavy, keys, "left_anti").select(
        *keys, value, "ties", F.coalesce(below, F.lit(0)).alias("below"), F.sum("ties").over(group).alias("total")
    )
    return light.unionByName(_by_ranges(grouped.join(heavy, keys, "left_semi"), keys, value, buckets))


def _by_ranges(grouped: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    quantiles = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx(F.col(value).cast("double"), quantiles, ACCURACY)
    bounds = grouped.where(F.col("ties") >= 0).select(sketch).scalar()
    placed = (
        grouped.withColumn("_bounds", bounds)
        .withColumn("_bucket", _bucket(value, F.col("_bounds"), buckets))
        .drop("_bounds")
    )
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.sum("ties").alias("_size"))
        .withColumn("total", F.sum("_size").over(group))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_size").over(group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("_size")
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .select(*keys, value, "ties", (F.col("_before") + F.col("_inside")).alias("below"), "total")
    )


def with_ranks(
    df: DataFrame,
    keys: list[str],
    ranks: dict[str, tuple[str, bool]],
    ties: str = "average",
    buckets: int = BUCKETS,
    floor: int = HEAVY_FLOOR,
) -> DataFrame:
    """Add ranks within ``keys``: result column -> (value column, ascending). A null value or key gets a null rank.

    Rows of ordinary groups go through one window each, on one shuffle. Groups with more than ``floor`` rows
    and more than a ten-thousandth of all rows are counted by ranges instead; both ways give the same ranks.
    Every count reads the input itself, not the frame that already carries other ranks.
    """
    if not keys:
        return _counted_ranks(df, keys, ranks, ties, buckets)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    sizes = df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = sizes.select((F.sum("_n") / HEAVY_SHARE).cast("bigint")).scalar()
    listed = sizes.where(F.col("_n") > F.greatest(F.coalesce(share, F.lit(0)), F.lit(floor)))
    marked = df.join(F.broadcast(listed.select(*keys, F.lit(True).alias("_heavy"))), keys, "left")
    light = _window_ranks(marked.where(F.col("_heavy").isNull()), keys, known, ranks, ties)
    heavy = _counted_ranks(marked.where("_heavy").select(*df.columns), keys, ranks, ties, buckets)
    columns = [*df.columns, *ranks]
    return light.select(*columns).unionByName(heavy.select(*columns))


def _window_ranks(df: DataFrame, keys: list[str], known: Column, ranks: dict, ties: str) -> DataFrame:
    # rows without a key have no rank: they are dealt by their content instead of meeting under one null
    content = [F.col(f"`{n}`") for n, t in df.dtypes if "map<" not in t and t != "variant"]
    df = df.withColumn("_deal", F.when(~known, F.xxhash64(*content)).otherwise(F.lit(0)))
    group = W.partitionBy(*keys, "_deal")
    for name, (value, ascending) in ranks.items():
        order = F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value)
        place = F.rank().over(group.orderBy(order)).cast("double")
        if ties == "average":
            place = place + (F.count(value).over(W.partitionBy(*keys, "_deal", value)) - 1) / 2
        df = df.withColumn(name, F.when(known & F.col(value).isNotNull(), place))
    return df


def _counted_ranks(df: DataFrame, keys: list[str], ranks: dict, ties: str, buckets: int) -> DataFrame:
    known = [F.col(k).isNotNull() for k in keys]
    out = df
    for name, (value, ascending) in ranks.items():
        rows = df.where(reduce(lambda a, b: a & b, [*known, F.col(value).isNotNull()]))
        grouped = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
        counts = _by_ranges(grouped, keys, value, buckets)
        lower = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("ties")
        step = (F.col("ties") + 1) / 2 if ties == "average" else F.lit(1)
        out = out.join(counts.select(*keys, value, (lower + step).cast("double").alias(name)), [*keys, value], "left")
    return out


def with_shared_ranks(df: DataFrame, ranks: dict[str, tuple[str, bool]], ties: str = "average", buckets: int = BUCKETS) -> DataFrame:
    """Ranks over the whole table for several value columns at once: result column -> (value column, ascending).

    Rows with the same values have the same ranks, so each combination of values is taken once, unpivoted to (column,
    value) and counted. All columns of one type are then cut into ranges together, and each combination gets its numbers
    back in one exchange. A null value gets a null rank.
    """
    values = list(dict.fromkeys(v for v, _ in ranks.values()))
    types = dict(df.select(*values).dtypes)
    alias = {v: f"_v{i}" for i, v in enumerate(values)}
    combined = df.groupBy(*[F.col(v).alias(alias[v]) for v in values]).agg(F.count(F.lit(1)).alias("_n"))
    out = combined.drop("_n") if len(set(types.values())) > 1 else None
    for kind in dict.fromkeys(types.values()):
        own = [v for v in values if types[v] == kind]
        cells = F.array(*[F.struct(F.lit(values.index(v)).alias("_score"), F.col(alias[v]).alias("_value")) for v in own])
        long = combined.select(*alias.values(), "_n", F.explode(cells).alias("_cell")).select(*alias.values(), "_n", "_cell.*")
        long = long.where(F.col("_value").isNotNull())
        counts = _by_ranges(
            long.groupBy("_score", "_value").agg(F.sum("_n").cast("bigint").alias("ties")), ["_score"], "_value", buckets
        )
        numbers = []
        for name, (value, ascending) in ranks.items():
            if value in own:
                lower = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("ties")
                place = lower + ((F.col("ties") + 1) / 2 if ties == "average" else F.lit(1))
                numbers.append(F.max(F.when(F.col("_score") == values.index(value), place.cast("double"))).alias(name))
        found = long.drop("_n").join(counts, ["_score", "_value"]).groupBy(*alias.values()).agg(*numbers)
        out = found if out is None else _meet(out, found, {a: a for a in alias.values()})
    return _meet(df, out, alias).select(*df.columns, *ranks)


def _meet(left: DataFrame, right: DataFrame, names: dict[str, str]) -> DataFrame:
    """Left join on columns that may be null on both sides."""
    right = right.withColumnsRenamed({n: f"_r{n}" for n in names.values()})
    same = reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_r{m}"]) for n, m in names.items()])
    return left.join(right, same, "left").drop(*[f"_r{n}" for n in names.values()])


def with_rank(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str,
    ascending: bool = False,
    ties: str = "average",
    buckets: int = BUCKETS,
    floor: int = HEAVY_FLOOR,
) -> DataFrame:
    return with_ranks(df, keys, {name: (value, ascending)}, ties, buckets, floor)


def strict_percentiles(
    probes: DataFrame,
    reference: DataFrame,
    keys: list[str],
    value: str,
    name: str,
    reference_value: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(keys, value, ``name``) for every probe value: 100 * (reference values below it) / (reference values).

    Groups without reference values give null.
    """
    marks = reference.select(*keys, F.col(reference_value or value).alias(value), F.lit(1).alias("_weight"))
    asked = probes.select(*keys, value).distinct().withColumn("_weight", F.lit(0))
    counts = cumulative_counts(marks.unionByName(asked), keys, value, "_weight", buckets)
    share = F.when(F.col("total") > 0, F.lit(100.0) * F.col("below") / F.col("total"))
    return counts.select(*keys, value, share.alias(name))


def with_strict_percentile(probes: DataFrame, reference: DataFrame, keys: list[str], value: str, name: str, **options) -> DataFrame:
    """Probe rows with their percentile; a null probe gets null."""
    return probes.join(strict_percentiles(probes, reference, keys, value, name, **options), [*keys, value], "left")
