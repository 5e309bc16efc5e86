"""Counts and statistics over samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.student import two_sided_p
from ..session import ensure_checkpoints
from .scoring import affinity_category

TYPE_COLUMNS = {0: "my_change_type", 1: "in_frame", 2: "alt_readframe_type"}
# The alteration types and frame labels an input can hold.
CHANGES = ["mutation", "insertion", "deletion"]
FRAMES = ["inframe", "frameshift", "Unknown"]
TYPE_VALUES = {0: CHANGES, 1: FRAMES, 2: [f"{c}_{f}" for c in CHANGES for f in FRAMES]}
NO_TYPE = "null"
AFFINITY_LEVELS = {1: ["HIGH", "MID", "LOW"], 2: ["HIGH", "MID"], 3: ["LOW"], 4: ["MID"], 5: ["HIGH"]}
# The texts of the filter label.
AFFINITY_TEXT = {
    1: "MHC affinity >= LOW", 2: "MHC affinity >= MID", 3: "MHC affinity = LOW Only",
    4: "MHC affinity = MID Only", 5: "MHC affinity = HIGH ONLY",
}
FRAME_TEXT = {
    0: "frame_stat = alteration only", 1: "frame_stat = read-frame only", 2: "frame_stat = alteration + read-frame",
}
CLASS_TEXT = {
    0: "neoep_stat = all neoeps", 1: "neoep_stat = high-affinity neoeps", 2: "neoep_stat = high-efficacy neoeps",
}


@dataclass(frozen=True)
class NeoepitopeFilter:
    """Settings of the filter cascade; a threshold of -1 is off."""

    mhc_affinity: int = 0
    frame_stat: int = 0
    neoep_stat: int = 0
    check_nmd: bool = False
    min_expression: float = -1
    min_proteasome: float = -1
    min_tap: float = -1
    max_endogenous: float = -1

    @property
    def type_column(self) -> str:
        return TYPE_COLUMNS[self.frame_stat]

    def predicates(self) -> list[Column]:
        tests = []
        if self.mhc_affinity in AFFINITY_LEVELS:
            tests.append(F.col("aff_cat_2").isin(AFFINITY_LEVELS[self.mhc_affinity]))
        if self.neoep_stat in (1, 2):
            tests.append(F.col("aff_cat_2").isin("HIGH", "MID"))
        if self.neoep_stat == 2:
            tests += [
                F.col(c).isin("higher", "equal")
                for c in ("delta_mhc_score", "delta_proteasome_score", "delta_TAP_score")
            ]
        if self.check_nmd:
            tests.append(F.lower("bool_nmd").contains("fa"))
        for limit, name in (
            (self.min_expression, "express_percentile"),
            (self.min_proteasome, "proteasome_percentile_2"),
            (self.min_tap, "tap_percentile_2"),
        ):
            if limit > -1:
                tests.append(F.col(name) >= limit)
        if self.max_endogenous > -1:
            tests.append(F.col("pep_matches_2") <= self.max_endogenous)
        return tests

    def label(self) -> str:
        parts = [
            AFFINITY_TEXT.get(self.mhc_affinity), FRAME_TEXT.get(self.frame_stat), CLASS_TEXT.get(self.neoep_stat),
            f"Filter NMD = {self.check_nmd}", f"Gene Exp >= {self.min_expression}",
            f"ProtCleav Thres >= {self.min_proteasome}", f"TAP Thres >= {self.min_tap}",
            f"Endogen Freq Thres <= {self.max_endogenous}",
        ]
        return " | ".join(p for p in parts if p)


def filter_neoepitopes(df: DataFrame, settings: NeoepitopeFilter) -> DataFrame:
    tests = settings.predicates()
    kept = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return kept.withColumn("filter_label", F.lit(settings.label()))


def _typed(df: DataFrame, settings: NeoepitopeFilter) -> DataFrame:
    """Rows without a type are of the type ``null``."""
    column = settings.type_column
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(NO_TYPE)))


def _passing(settings: NeoepitopeFilter, column: str) -> Column:
    """The column where the row passes every test, else null."""
    tests = settings.predicates()
    return F.when(reduce(lambda a, b: a & b, tests), F.col(column)) if tests else F.col(column)


def _across(small: DataFrame, settings: NeoepitopeFilter, types: list[str] | None, case: str) -> tuple[DataFrame, list[str]]:
    """One row per sample, and the types asked for or else the fixed ones and all others seen before filtering.

    ``small`` has one row per (sample, type). It is stored before its types are read, so the input is scanned once.
    """
    column = settings.type_column
    if not types:
        ensure_checkpoints(small.sparkSession)
        small = small.checkpoint()
        fixed = TYPE_VALUES[settings.frame_stat]
        seen = {r[0] for r in small.select(column).distinct().collect()} - set(fixed)
        types = [*fixed, *sorted(seen, key=lambda t: (t == NO_TYPE, t))]
    values = [F.first(c).alias(c) for c in small.columns if c not in (case, column)]
    return small.groupBy(case).pivot(column, types).agg(*values), types


def _count_matrix(df, settings, count, value, types, case):
    small = _typed(df, settings).groupBy(case, settings.type_column).agg(count(_passing(settings, value)).alias("n"))
    wide, types = _across(small, settings, types, case)
    # by place: a type may hold any character
    places = [f"_{i}" for i in range(len(types))]
    return wide.toDF(case, *places).na.fill(0, subset=places).toDF(case, *types)


def mutation_counts(df: DataFrame, settings: NeoepitopeFilter, types: list[str] | None = None, case: str = "case_id") -> DataFrame:
    """Samples x alteration types: distinct mutations that pass; zero for every sample seen before filtering."""
    return _count_matrix(df, settings, F.count_distinct, "genome_pos", types, case)


def neoepitope_counts(
    df: DataFrame, settings: NeoepitopeFilter, distinct: bool = True, types: list[str] | None = None, case: str = "case_id"
) -> DataFrame:
    """Samples x alteration types: distinct or all altered peptides that pass."""
    return _count_matrix(df, settings, F.count_distinct if distinct else F.count, "peptide_2", types, case)


def list_mutations(df: DataFrame, settings: NeoepitopeFilter, case: str = "case_id") -> DataFrame:
    column = settings.type_column
    return filter_neoepitopes(df, settings).select(case, F.col(column).alias("alteration_type"), "genome_pos").distinct()


def neoepitopes_per_alteration(
    df: DataFrame, settings: NeoepitopeFilter, case: str = "case_id", zeros: bool = True
) -> DataFrame:
    """Distinct altered peptides per (sample, mutation); mutations whose peptides were all filtered count 0."""
    counts = filter_neoepitopes(df, settings).groupBy(case, "genome_pos").agg(
        F.count_distinct("peptide_2").alias("peptides")
    )
    if not zeros:
        return counts
    return df.select(case, "genome_pos").distinct().join(counts, [case, "genome_pos"], "left").na.fill(0, ["peptides"])


def neoepitope_mean_std(df: DataFrame, settings: NeoepitopeFilter, types: list[str] | None = None, case: str = "case_id") -> DataFrame:
    """Mean and population deviation of the positive per-mutation counts, per sample and type."""
    column = settings.type_column
    counts = _typed(df, settings).groupBy(case, column, "genome_pos").agg(
        F.nullif(F.count_distinct(_passing(settings, "peptide_2")), F.lit(0)).alias("n")
    )
    small = counts.groupBy(case, column).agg(F.avg("n").alias("avg"), F.stddev_pop("n").alias("std"))
    wide, types = _across(small, settings, types, case)
    return wide.toDF(case, *[f"{t}:{m}" for t in types for m in ("avg", "std")])


def _least_row(df: DataFrame, keys: tuple[str, ...], order: list[str], lead: Column | None = None) -> DataFrame:
    """The first row of each group by ``lead`` and the order columns; each column is in the shuffled row once.

    The keys are taken from the row: a later filter on them stays above the aggregate, so it is run and exchanged once.
    """
    named = {c.lower() for c in order}
    rest = [c for c in df.columns if c.lower() not in named]
    led = [] if lead is None else [lead.alias("_lead")]
    if any("map<" in t or "variant" in t for n, t in df.dtypes if n in rest):
        # such columns cannot be compared
        row = F.min_by(F.struct(*df.columns), F.struct(*led, *order))
    else:
        row = F.min(F.struct(*led, *order, *rest))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*").select(*df.columns)


def first_per_mutation(df: DataFrame, order: list[str], keys: tuple[str, ...] = ("genome_pos",)) -> DataFrame:
    """First row of every mutation by the given order columns.

    A partial aggregate: each task keeps one row per mutation before the shuffle.
    """
    return _least_row(df, keys, order)


def combine_datasets(frames: dict[str, DataFrame], leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Stack named inputs, with a ``dataset`` column."""
    kept = [f.withColumn("dataset", F.lit(n)) for n, f in frames.items() if n not in leave_out]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def unique_mutations(df: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct("genome_pos").alias("mutations"))


def efficacy_funnel(df: DataFrame, by: tuple[str, ...] = ("case_id",), min_percentile: float = 50) -> DataFrame:
    """Rows left after each cumulative step, in one pass."""
    binder = F.col("aff_cat_2").isin("HIGH", "MID")
    processed = binder & (F.col("proteasome_percentile_2") >= min_percentile) & (F.col("tap_percentile_2") >= min_percentile)
    expressed = processed & (F.col("express_percentile") > 0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(binder).alias("binders"),
        F.count_if(processed).alias("processed"),
        F.count_if(expressed).alias("expressed"),
    )


def processing_bins(
    df: DataFrame, order: list[str], step: int = 50, case: str = "case_id", category: str = "aff_cat_2",
    key: tuple[str, ...] | None = None,
) -> DataFrame:
    """Mutations per sample, category (a response group, say) and window ``[t, t+step)`` that holds both percentiles.

    One row per window and ``key`` (sample and mutation unless given) is kept, the first by ``order``; a percentile of 100
    lies outside every window.
    """
    low = (F.floor(F.col("proteasome_percentile_2") / step) * step).cast("bigint")
    both = (
        (F.floor(F.col("proteasome_percentile_2") / step) == F.floor(F.col("tap_percentile_2") / step))
        & (F.col("proteasome_percentile_2") < 100)
        & (F.col("proteasome_percentile_2") >= 0)
    )
    inside = df.where(both).withColumn("window", F.concat_ws("-", low.cast("string"), (low + step).cast("string")))
    kept = first_per_mutation(inside, order, (*(key or (case, "genome_pos")), "window"))
    return kept.groupBy(case, category, "window").agg(F.count(F.lit(1)).alias("n"))


def labelled_counts(frames: list[tuple[str, DataFrame]], value: str, keys: list[str], subgroup: str | None = None) -> DataFrame:
    """Long table (keys, [subgroup,] label, value) from several results."""
    extra = [subgroup] if subgroup else []
    parts = [
        f.select(*keys, *extra, F.lit(label).alias("label"), F.col(value).cast("double").alias("value"))
        for label, f in frames
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def condition_ttest(
    df: DataFrame, first: str, second: str, bin_column: str = "label", category: str = "category", value: str = "value",
    p_value: bool = True,
) -> DataFrame:
    """Pooled-variance two-sample t test per bin between the rows whose category contains one label or the other.

    Case does not count. Each side is matched on its own: a row whose category contains both labels is on both.
    """
    text, sides = F.lower(category), {}
    for name, label in (("a", first), ("b", second)):
        mine = F.when(text.contains(label.lower()), F.col(value))
        sides |= {f"{name}_n": F.count(mine), f"{name}_mean": F.avg(mine), f"{name}_var": F.var_samp(mine)}
    stats = df.groupBy(bin_column).agg(*(c.alias(n) for n, c in sides.items())).where("a_n + b_n > 0")
    na, nb = F.col("a_n"), F.col("b_n")
    dof = na + nb - 2
    pooled = F.try_divide((na - 1) * F.col("a_var") + (nb - 1) * F.col("b_var"), dof)
    spread = F.sqrt(pooled * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb)))
    out = stats.select(
        bin_column, na.alias("n_a"), nb.alias("n_b"), dof.alias("dof"),
        F.try_divide(F.col("a_mean") - F.col("b_mean"), spread).alias("t_statistic"),
    )
    if not p_value:
        return out

    return out.withColumn("p_value", two_sided_p("t_statistic", "dof"))


def sample_mean_std(df: DataFrame, by: tuple[str, ...] = ("case_id",), value: str = "ic50_score_2") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def fold_change_buckets(df: DataFrame, by: tuple[str, ...] = ("case_id",), value: str = "fold_change") -> DataFrame:
    x = F.col(value)
    return df.groupBy(*by).agg(
        F.count_if(x < 1).alias("below_1"), F.count_if(x == 1).alias("equal_1"), F.count_if(x > 1).alias("above_1"),
        F.count_if(x > 100).alias("above_100"), F.count_if(x > 500).alias("above_500"),
    )


def best_row_per_mutation(
    df: DataFrame, tie_order: list[str], by: str = "mhc", keys: tuple[str, ...] = ("case_id", "genome_pos")
) -> DataFrame:
    """The row with the largest mhc score, or the smallest ic50, of each mutation; ties go to the first by ``tie_order``."""
    lead = -F.col("mhc_score_2") if by == "mhc" else F.col("ic50_score_2")
    usable = df.where(F.col("mhc_score_2" if by == "mhc" else "ic50_score_2").isNotNull())
    return _least_row(usable, keys, tie_order, lead)


def category_boundary_values(df: DataFrame, ic50: str = "ic50_score_2", mhc: str = "mhc_score_2") -> DataFrame:
    """Largest ic50 inside HIGH, MID and LOW with the mhc score of that row."""
    return (
        df.withColumn("aff_cat", affinity_category(ic50))
        .where(F.col("aff_cat") != "none")
        .groupBy("aff_cat")
        .agg(F.max(ic50).alias("max_ic50"), F.max_by(mhc, F.struct(ic50, mhc)).alias("mhc_score"))
    )
