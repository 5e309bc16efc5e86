"""Results to files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FASTA_ID = 10


def write_table(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """Tab-separated output with a header; ``order`` sorts it globally first (a range exchange, not one task)."""
    text = df.select(*[F.col(f"`{n}`") if t not in ("boolean",) else F.initcap(F.col(f"`{n}`").cast("string")).alias(n) for n, t in df.dtypes])
    if order:
        text = text.orderBy(*order)
    text.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def stack_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """Titled results in one frame; columns a section lacks are null."""
    named = [df.withColumn("section", F.lit(title)) for title, df in sections.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def write_summary_sections(sections: dict[str, DataFrame], path: str) -> None:
    """One write, one folder per section."""
    stack_sections(sections).write.mode("overwrite").partitionBy("section").parquet(path)


def error_rows(rows: DataFrame, results: DataFrame, keys: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Rows without a result: status -1 when the request failed (listed in ``failed``), 0 when the reply was empty."""
    missing = rows.join(results.select(*keys), keys, "left_anti")
    if failed is None:
        return missing.withColumn("status", F.lit(0))
    marks = failed.select(*keys).distinct().withColumn("_f", F.lit(True))
    return missing.join(marks, keys, "left").withColumn("status", F.when(F.col("_f"), -1).otherwise(0)).drop("_f")


def write_error_rows(rows: DataFrame, results: DataFrame, keys: list[str], path: str, failed: DataFrame | None = None) -> None:
    write_table(error_rows(rows, results, keys, failed), path, mode="append")


def resume_incremental(variants: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("case_id", "genome_pos", "isoform_id")) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return variants.join(done.select(*keys), list(keys), "left_anti")


def peptide_fasta(
    windows: DataFrame, key: list[str], prefix: str = "", extra: str = "", id_length: int = FASTA_ID
) -> DataFrame:
    """Two records per window, mutant ``m<i>`` and original ``o<i>``: ``>prefix|id|m<i>|extra|frame|i of n``.

    ``n`` is the number of peptides in the record, one for a single window. The run id is a hash of the key,
    so it repeats.
    """
    place = F.col("window_start").cast("string")
    run = F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), 1, id_length)

    def record(tag, peptide):
        title = [F.lit(f">{prefix}"), run, F.concat(F.lit(tag), place), F.lit(extra), F.col("window_frame")]
        return F.concat_ws("\n", F.concat_ws("|", *title, F.concat(place, F.lit(" of 1"))), F.col(peptide))

    return windows.select(F.explode(F.array(record("m", "peptide_alt"), record("o", "peptide_orig"))).alias("value"))


def export_peptide_fasta(windows: DataFrame, key: list[str], path: str, prefix: str = "", extra: str = "") -> None:
    peptide_fasta(windows, key, prefix, extra).write.mode("overwrite").text(path)
