"""What an aberrant junction does to the transcript: sequences, altered proteins, decay regions, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coding as c
from ..functions import models as m
from ..functions.sequence import cut, translate_cds
from ..session import ensure_checkpoints
from ..plans.rows import pinned, unroll
from .genemodels import TRANSCRIPT_KEY
from .junctions import END, START, canonical_junction, exons_from_junctions, junction_models, transcript_with_junction
from .sequences import CHUNK, altered_region, comparative_neoepitopes, protein_part, transcript_sequence


def junction_neoepitopes(
    chains: DataFrame, transcripts: DataFrame, genome: DataFrame, chunk: int = CHUNK, codons: int = 9,
    peptide: int = c.PEPTIDE, key: str = "sj_id",
) -> DataFrame:
    """Canonical against aberrant transcript, both read from the first coding base to the transcript end.

    ``chains`` are rows of ``transcript_with_junction``. Gives the bases around the junction, the differing
    window with its genome range, the four compared proteins, and the NMD-sensitive and NMD-irrelevant
    stretches with their stop flags. Isoforms without a start codon, or whose start codon the junction
    removes, are left out.
    """
    plain = transcript_sequence(transcripts, genome, chunk, F.col("exons"), "mrna").select(*TRANSCRIPT_KEY, "mrna")
    chains = chains if "implied_exons" in chains.columns else exons_from_junctions(chains)
    rows = transcript_sequence(
        chains, genome, chunk, F.col("implied_exons"), "mrna_alt", [key, *TRANSCRIPT_KEY]
    ).join(plain, TRANSCRIPT_KEY)
    plus = F.col("strand") > 0
    parts = m.coding("exons")
    first = F.when(plus, F.get(parts, F.lit(0))["start"] + 1).otherwise(F.element_at(parts, -1)["end"])
    rows = rows.where(F.exists("exons", lambda e: e["cds_start"].isNotNull())).withColumn("_first", first)
    donor = F.when(plus, F.col("start_pos")).otherwise(F.col("end_pos") + 1)
    last = F.when(plus, F.element_at("implied_exons", -1)).otherwise(F.get("implied_exons", F.lit(0)))
    rows = pinned(
        rows,
        {
            "_oc": m.spliced_offset("exons", "strand", "_first"), "_oa": m.spliced_offset("implied_exons", "strand", "_first"),
            "_oj": m.spliced_offset("implied_exons", "strand", donor) + 1,
            "_end": m.spliced_length("implied_exons") - (last["end"] - last["start"]) - 1,
        },
    ).where("_oc is not null and _oa is not null and mrna is not null and mrna_alt is not null")
    whole = lambda text, start: cut(text, F.col(start).cast("int"), F.length(text))
    rows = rows.withColumns({"cds": whole("mrna", "_oc"), "cds_alt": whole("mrna_alt", "_oa")})
    at = F.col("_oj").cast("int")
    rows = rows.withColumns(
        {
            "nuc_before": cut("mrna_alt", F.greatest(at - 3 * codons, F.lit(0)), at),
            "nuc_after": cut("mrna_alt", at, at + 3 * codons),
        }
    )
    rows = comparative_neoepitopes(altered_region(rows, peptide, keep_proteins=True))
    # the window on the aberrant transcript, back on the genome
    stop = F.when(F.col("region_end") < 0, F.length("cds_alt") - 1).otherwise(F.col("region_end"))
    rows = rows.withColumns(
        {
            "_a": m.spliced_position("implied_exons", "strand", F.col("_oa") + F.col("region_start")),
            "_b": m.spliced_position("implied_exons", "strand", F.col("_oa") + stop - 1),
        }
    )
    span = F.concat("chrom", F.lit(":"), F.least("_a", "_b").cast("string"), F.lit("-"), F.greatest("_a", "_b").cast("string"))
    v, b = (F.col("_oj") - 1 - F.col("_oa")).cast("int"), (F.col("_end") - c.NMD_DISTANCE - F.col("_oa")).cast("int")
    rows = rows.withColumns({"window_range": F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), span), "_v": v, "_bd": b})
    v, b = F.col("_v"), F.col("_bd")
    codon = lambda x: x - F.pmod(x, F.lit(3))
    known = (v >= 0) & (b >= 0)
    later = F.when(v > b, codon(v)).otherwise(codon(b) + 3)
    rows = rows.withColumns(
        {
            "sensitive_aa": F.when(known & (v < b), protein_part("_pa", codon(v), codon(b) + 3 - codon(v))),
            "irrelevant_aa": F.when(known, protein_part("_pa", later, F.length("cds_alt") - later)),
        }
    )
    return rows.withColumns(
        {"bool_NMD": F.contains("sensitive_aa", F.lit("*")), "bool_NSD": ~F.contains("irrelevant_aa", F.lit("*"))}
    ).drop("_first", "_oc", "_oa", "_oj", "_end", "_a", "_b", "_v", "_bd", "mrna", "mrna_alt", "_po", "_pa")


def aberrant_products(
    junctions: DataFrame, transcripts: DataFrame, genome: DataFrame, chunk: int = CHUNK, key: str = "sj_id",
) -> DataFrame:
    """``junction_neoepitopes`` of the aberrant junctions of all samples, worked out once per position.

    What a key gives depends only on the positions of its records, mostly one. Keys with the same positions share the work
    and get the result back with one join. Records without a key give no row.
    """
    place = ["gene", "chrom", START, END]
    held = junctions.where(F.col(key).isNotNull() & F.col("gene").isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*place))).alias("places")
    )
    rows = unroll(held.select("places").distinct(), "_p", "places").select("places", "_p.*")
    models = canonical_junction(junction_models(rows, transcripts)).where("not canonical")
    # the chains are read twice, for their pieces of the genome and for the rows these are joined to
    ensure_checkpoints(junctions.sparkSession)
    chains = exons_from_junctions(transcript_with_junction(models)).checkpoint()
    found = junction_neoepitopes(chains, transcripts, genome, chunk, key="places")
    return held.join(found, "places").drop("places")


def transcript_event_notes(
    sequences: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("case_id", "isoform"), seq: str = "cds"
) -> DataFrame:
    """Sequence and protein text of each sample with the notes of each codon in brackets behind it.

    ``events`` has the keys, position (0-based offset) and note; ``sequences`` has at least one of the keys.
    A transcript without a sample gives one row for every sample with events, and one without a sample if
    there is none. Equal notes collapse map-side, so a key gathers the distinct notes of one sample only.
    """
    shared = [k for k in keys if k in sequences.columns]
    distinct = events.select(*keys, F.floor(F.col("position") / 3).cast("int").alias("codon"), "note").distinct()
    notes = distinct.groupBy(*keys, "codon").agg(F.array_join(F.array_sort(F.collect_list("note")), ",").alias("n"))
    packed = notes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("codon", "n"))).alias("_m"))
    rows = sequences.join(packed, shared, "left").withColumn("_c", F.regexp_extract_all(seq, F.lit(".{1,3}"), F.lit(0)))

    def marked(show):
        def one(codon, i):
            note = F.try_element_at("_m", i)
            return F.concat(show(codon), F.coalesce(F.concat(F.lit("["), note, F.lit("]")), F.lit("")))

        return one

    whole = F.filter("_c", lambda x: F.length(x) == 3)
    return rows.withColumns(
        {
            "marked_sequence": F.array_join(F.transform("_c", marked(lambda x: x)), " "),
            "marked_protein": F.array_join(F.transform(whole, marked(translate_cds)), ""),
        }
    ).drop("_m", "_c")
