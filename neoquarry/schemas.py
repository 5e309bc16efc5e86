"""Column types of the input tables, as DDL. Names follow the files."""

MAF = (
    "Hugo_Symbol string, Variant_Classification string, Variant_Type string, Chromosome string, Start_Position bigint, "
    "End_Position bigint, Strand string, Reference_Allele string, Tumor_Seq_Allele2 string, Tumor_Sample_Barcode string, "
    "Transcript_ID string, HGVSc string, HGVSp string, HGVSp_Short string, Codons string, Amino_acids string, "
    "Protein_position string, Consequence string, Mutation_Status string, n_alt_count int"
)
GENE_PRED = (
    "name string, chrom string, strand string, txStart bigint, txEnd bigint, cdsStart bigint, cdsEnd bigint, "
    "exonCount int, exonStarts string, exonEnds string, name2 string, exonFrames string"
)
BED12 = (
    "chrom string, leftmost bigint, rightmost bigint, sj_id string, read_count bigint, strand string, thick_start bigint, "
    "thick_end bigint, rgb string, blocks int, block_lengths string, block_starts string"
)
UNIQUE_JUNCTIONS = (
    "chrom string, start_pos bigint, end_pos bigint, strand string, gene string, gene_strand string, isoforms string, "
    "caller_count bigint, all_count bigint, unique_count bigint, sj_id string, sj_strand string, canonical string, "
    "has_skip string, skips string, frame_kept string, frames string, samples string, prevalence_all bigint, "
    "prevalence_control bigint"
)
JUNCTION_PREVALENCE = (
    "chrom string, start_pos bigint, end_pos bigint, gene string, samples string, sample_count bigint, "
    "control_count bigint, read_counts string"
)
FUSIONS = (
    "chroms string, pos_a bigint, pos_b bigint, orientation string, read_span string, read_mate string, "
    "read_break string, contradicting string, bases_left string, bases_right string"
)
VARIANT_EFFECT = (
    "struct<id:string,seq_region_name:string,start:bigint,end:bigint,allele_string:string,variant_class:string,"
    "most_severe_consequence:string,transcript_consequences:array<struct<transcript_id:string,gene_symbol:string,"
    "gene_id:string,strand:int,codons:string,cds_start:int,cds_end:int,amino_acids:string,protein_start:int,"
    "protein_end:int,hgvsc:string,hgvsp:string>>>"
)
