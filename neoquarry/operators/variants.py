"""Filters and derived columns of mutation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import clean_allele, col
from ..plans.ordered import BUCKETS, cumulative_counts

MISSING_COLUMN = "~_~"
CARRIED_COLUMNS = (
    "case_id gene_symbol isoform_id express_count express_percentile my_change_type in_frame my_HGVSc my_HGVSp "
    "myVEP_codon_orig_alt myVEP_aa_orig_alt bool_NMD bool_NSD cancer_type"
).split()


def filter_somatic(df: DataFrame, max_alt_count: int = 3, check_status: bool = True, check_count: bool = True) -> DataFrame:
    """Keep somatic calls, and calls with fewer than ``max_alt_count`` alternative reads in the normal sample."""
    if check_status:
        df = df.where(F.lower("Mutation_Status").contains("somatic"))
    if check_count:
        df = df.where(F.col("n_alt_count") < max_alt_count)
    return df


def filter_coding_change(df: DataFrame, column: str = "Amino_acids") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def filter_chromosome(df: DataFrame, column: str = "Chromosome") -> DataFrame:
    return df.where(F.col(column).rlike("^([0-9]+|X|Y)$"))


def filter_consequence(df: DataFrame, kind: int = 0, column: str = "Consequence") -> DataFrame:
    """1 keeps missense, 2 keeps frameshift, anything else keeps all."""
    word = {1: "missense", 2: "frameshift"}.get(kind)
    return df.where(F.lower(column).contains(word)) if word else df


def filter_noncoding_isoform(df: DataFrame, column: str = "isoform_id") -> DataFrame:
    return df.where(~F.col(column).contains("NR_"))


def changes_protein(aa_change) -> Column:
    """Both sides of ``A/B`` exist and differ."""
    parts = F.split(col(aa_change), "/")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.coalesce((first != "") & (second != "") & (first != second), F.lit(False))


def filter_altering_rows(
    df: DataFrame, change: str = "aa_change", required: tuple[str, str] = ("AA_orig_STOP", "AA_alt_STOP")
) -> DataFrame:
    return df.withColumn("bool_alteration", changes_protein(change)).where("bool_alteration").dropna(subset=list(required))


def genome_pos_key(chrom, start, end, with_chr: bool = True) -> Column:
    """``chrom:start-end`` text, with or without the ``chr`` prefix."""
    bare = F.regexp_replace(col(chrom), "^chr", "")
    name = F.concat(F.lit("chr"), bare) if with_chr else bare
    return F.concat(name, F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))


def parse_genome_pos(df: DataFrame, key: str = "genome_pos") -> DataFrame:
    """Typed chromosome, start, end and length (end - start) of a key."""
    part = lambda i: F.regexp_extract(key, r"^(?:chr)?([^:]+):(-?\d+)-(-?\d+)$", i)
    return (
        df.withColumn("chrom", part(1))
        .withColumn("start_pos", part(2).try_cast("bigint"))
        .withColumn("end_pos", part(3).try_cast("bigint"))
        .withColumn("span", F.col("end_pos") - F.col("start_pos"))
    )


def insertion_coordinates(
    df: DataFrame, start: str = "start_pos", end: str = "end_pos", ref: str = "ref"
) -> DataFrame:
    """Insertions (reference ``-``) get start = end + 1; a span above one base marks the call invalid."""
    insertion = F.col(ref) == "-"
    invalid = insertion & (F.abs(F.col(end) - F.col(start)) > 1)
    swap = insertion & ~invalid & (F.col(end) > F.col(start))
    s, e = F.col(start), F.col(end)
    return df.withColumns(
        {start: F.when(swap, e).otherwise(s), end: F.when(swap, s).otherwise(e), "valid": ~invalid}
    )


def sample_suffix(df: DataFrame, whole_genome: bool, column: str = "case_id") -> DataFrame:
    return df.withColumn(column, F.concat(F.col(column), F.lit("_WGS"))) if whole_genome else df


def fill_missing_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Make every named column present; an absent column becomes the placeholder text."""
    absent = {n: F.lit(MISSING_COLUMN) for n in (names or CARRIED_COLUMNS) if n not in df.columns}
    return df.withColumns(absent) if absent else df


def clean_expression_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``-`` and other non-numbers become 0; adds ``<c>_is_number`` and ``<c>_is_positive``."""
    out = {}
    for name in columns:
        number = F.col(name).cast("string").try_cast("double")
        out[f"{name}_is_number"] = number.isNotNull()
        out[f"{name}_is_positive"] = F.coalesce(number > 0, F.lit(False))
        out[name] = F.coalesce(number, F.lit(0.0))
    return df.withColumns(out)


def alteration_type(df: DataFrame, allele: str = "allele_string") -> DataFrame:
    """``my_change_type`` and ``in_frame`` from ``ref/alt``."""
    parts = F.split(F.col(allele), "/")
    lengths = [F.length(clean_allele(F.get(parts, F.lit(i)))) for i in (0, 1)]
    diff = lengths[0] - lengths[1]
    return df.withColumn(
        "my_change_type", F.when(diff == 0, "mutation").when(diff < 0, "insertion").when(diff > 0, "deletion")
    ).withColumn(
        "in_frame", F.when(diff.isNull(), "Unknown").when(F.pmod(diff, F.lit(3)) == 0, "inframe").otherwise("frameshift")
    )


def alt_readframe_type(df: DataFrame) -> DataFrame:
    return df.withColumn("alt_readframe_type", F.concat_ws("_", "my_change_type", "in_frame"))


def crosscheck_columns(df: DataFrame, pairs: dict[str, tuple[str, str]], empty: dict[str, str] | None = None) -> DataFrame:
    """For each name, ``compare_<name>`` = ``given | computed`` and ``match_<name>``.

    ``empty`` gives the text that replaces the comparison when either side is missing.
    """
    empty = empty or {"codon": "-codon_empty-", "aa": "-aa_empty-"}
    out = {}
    for name, (given, computed) in pairs.items():
        a, b = F.col(given), F.col(computed)
        missing = a.isNull() | b.isNull() | (a == "") | (b == "")
        text = F.concat_ws(" | ", a, b)
        if name in empty:
            text = F.when(missing, F.lit(empty[name])).otherwise(text)
        out[f"compare_{name}"] = text
        out[f"match_{name}"] = ~missing & (a == b)
    return df.withColumns(out)


def patient_hla_alleles(df: DataFrame, patient: str = "Patient ID", length: int = 9) -> DataFrame:
    """One row per patient and allele from three comma lists."""
    loci = F.array(*[F.split(F.col(f"`HLA-{g}.1`"), ",") for g in "ABC"])
    allele = F.explode(F.flatten(F.filter(loci, lambda x: x.isNotNull())))
    return (
        df.select(F.col(f"`{patient}`").alias("patient"), allele.alias("name"))
        .where(F.trim("name") != "")
        .select("patient", F.concat(F.lit("HLA-"), F.trim("name")).alias("allele"), F.lit(length).alias("length"))
    )


def condition_label(df: DataFrame, rules: list[tuple[str, str]], sample: str = "case_id", name: str = "condition") -> DataFrame:
    """First rule whose text occurs in the sample id (any case) gives the label; no match gives null."""
    label = F.lit(None).cast("string")
    for text, value in reversed(rules):
        label = F.when(F.lower(sample).contains(text.lower()), value).otherwise(label)
    return df.withColumn(name, label)


def condition_lookup(df: DataFrame, table: DataFrame, sample: str = "case_id") -> DataFrame:
    """Labels from a table with one row per sample; an unknown sample keeps null labels."""
    return df.join(table, sample, "left")


# The published columns of the summary report, in their order, with the input column each is taken from.
REPORT_COLUMNS = {
    "case_id": "case_id",
    "gene_symbol": "gene_symbol",
    "allele": "allele",
    "genome_pos": "genome_pos",
    "myVEP_aa_orig_alt": "myVEP_aa_orig_alt",
    "my_change_type": "my_change_type",
    "in_frame": "in_frame",
    "alt_readframe_type": "alt_readframe_type",
    "original_peptide": "peptide_1",
    "ic50_score_orig": "ic50_score_1",
    "aff_cat_orig": "aff_cat_1",
    "proteasome_score_orig": "proteasome_score_1",
    "tap_score_orig": "tap_score_1",
    "proteasome_percentile_orig": "proteasome_percentile_1",
    "tap_percentile_orig": "tap_percentile_1",
    "altered_peptide": "peptide_2",
    "ic50_score_alt": "ic50_score_2",
    "aff_cat_alt": "aff_cat_2",
    "proteasome_score_alt": "proteasome_score_2",
    "tap_score_alt": "tap_score_2",
    "proteasome_percentile_alt": "proteasome_percentile_2",
    "tap_percentile_alt": "tap_percentile_2",
    "bool_NMD": "bool_NMD",
    "Fold Change (orig/alt)": "fold_change",
    "mut_neoep_rank_1": "mut_neoep_rank_1",
}


def report_projection(
    df: DataFrame, file: str, order: str, columns: dict[str, str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Report columns in fixed order behind ``sample_row``, which is ``<file>_<i>`` with i from 0.

    ``columns`` names the input column of each report column; one that the input lacks is null, so the layout is
    always the same. ``order`` is a numeric column without repeats within a file; it decides the running number.
    Rows with a null file or order stay, without a number (null ``sample_row``).
    """
    place = cumulative_counts(df, [file], order, buckets=buckets).select(file, order, "below")
    known = {c.lower() for c in df.columns}
    cells = [
        (F.col(source) if source.lower() in known else F.lit(None).cast("string")).alias(name)
        for name, source in (columns or REPORT_COLUMNS).items()
    ]
    number = F.concat(F.col(file).cast("string"), F.lit("_"), F.col("below").cast("string")).alias("sample_row")
    return df.join(place, [file, order], "left").select(number, *cells)
