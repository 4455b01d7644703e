"""Column names, thresholds and lookup values of the evidence data model.

Everything in the "fixed values" blocks must equal what the evidence
pipeline has always used; changing any of them changes results.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Filters and thresholds of the evidence transform.
# ---------------------------------------------------------------------------
TRANSFORM_CHROMOSOMES = [str(c) for c in range(23)] + ["X", "Y"]  # includes "0"
BUILD_CHROMOSOMES = [str(c) for c in range(1, 23)] + ["X", "Y"]  # one table each
VALID_GWAS_SOURCES = ["GWAS Catalog"]
MINIMUM_GTEX_VALUE = 0.999975
MAXIMUM_GENE_SNP_DISTANCE = 1000000
MINIMUM_VEP_VALUE = 0.65

# ---------------------------------------------------------------------------
# Gene-to-variant score weights and phase ranges.
# ---------------------------------------------------------------------------
GTEX_WEIGHT = 13.0
FANTOM5_WEIGHT = 3.0
DHS_WEIGHT = 1.5
PCHIC_WEIGHT = 1.5
FUNCGEN_TOTAL_WEIGHT = GTEX_WEIGHT + FANTOM5_WEIGHT + DHS_WEIGHT + PCHIC_WEIGHT
OT_G2V_PHASE_1_MIN = 0.9
OT_G2V_PHASE_1_MAX = 1.0
OT_G2V_PHASE_2_MIN = 0.5
OT_G2V_PHASE_2_MAX = 0.9
OT_G2V_PHASE_3_VALUE = 0.5

# ---------------------------------------------------------------------------
# GTEx tissue columns, in the order that breaks ties
# (the first column holding the row maximum names the tissue).
# ---------------------------------------------------------------------------
GTEX_TISSUES = [
    "GTEx_Thyroid",
    "GTEx_Testis",
    "GTEx_Cells_Transformed_fibroblasts",
    "GTEx_Nerve_Tibial",
    "GTEx_Brain_Frontal_Cortex_BA9",
    "GTEx_Artery_Aorta",
    "GTEx_Vagina",
    "GTEx_Whole_Blood",
    "GTEx_Breast_Mammary_Tissue",
    "GTEx_Ovary",
    "GTEx_Adipose_Subcutaneous",
    "GTEx_Adrenal_Gland",
    "GTEx_Heart_Atrial_Appendage",
    "GTEx_Stomach",
    "GTEx_Brain_Caudate_basal_ganglia",
    "GTEx_Colon_Transverse",
    "GTEx_Brain_Cerebellum",
    "GTEx_Esophagus_Muscularis",
    "GTEx_Liver",
    "GTEx_Muscle_Skeletal",
    "GTEx_Prostate",
    "GTEx_Small_Intestine_Terminal_Ileum",
    "GTEx_Brain_Hypothalamus",
    "GTEx_Spleen",
    "GTEx_Colon_Sigmoid",
    "GTEx_Brain_Anterior_cingulate_cortex_BA24",
    "GTEx_Esophagus_Gastroesophageal_Junction",
    "GTEx_Brain_Hippocampus",
    "GTEx_Brain_Cortex",
    "GTEx_Heart_Left_Ventricle",
    "GTEx_Artery_Tibial",
    "GTEx_Uterus",
    "GTEx_Pituitary",
    "GTEx_Cells_EBV-transformed_lymphocytes",
    "GTEx_Artery_Coronary",
    "GTEx_Adipose_Visceral_Omentum",
    "GTEx_Brain_Nucleus_accumbens_basal_ganglia",
    "GTEx_Brain_Cerebellar_Hemisphere",
    "GTEx_Esophagus_Mucosa",
    "GTEx_Skin_Not_Sun_Exposed_Suprapubic",
    "GTEx_Brain_Putamen_basal_ganglia",
    "GTEx_Lung",
    "GTEx_Pancreas",
    "GTEx_Skin_Sun_Exposed_Lower_leg",
]

# ---------------------------------------------------------------------------
# Variant-effect term scores (term, value), 43 rows.
# ---------------------------------------------------------------------------
ECO_SCORES = [
    ("cttv_mapping_pipeline", 1.0),
    ("curator_inference", 1.0),
    ("trinucleotide_repeat_expansion", 1.0),
    ("sequence_variant", 0.5),
    ("regulatory_region_variant", 0.6),
    ("stop_retained_variant", 0.65),
    ("splice_acceptor_variant", 0.95),
    ("splice_donor_variant", 0.95),
    ("stop_lost", 0.9),
    ("coding_sequence_variant", 0.95),
    ("initiator_codon_variant", 0.7),
    ("missense_variant", 0.7),
    ("stop_gained", 0.95),
    ("frameshift_variant", 0.95),
    ("non_coding_transcript_variant", 0.65),
    ("mature_miRNA_variant", 0.65),
    ("NMD_transcript_variant", 0.65),
    ("5_prime_UTR_variant", 0.65),
    ("3_prime_UTR_variant", 0.65),
    ("incomplete_terminal_codon_variant", 0.9),
    ("intron_variant", 0.65),
    ("intergenic_variant", 0.5),
    ("splice_region_variant", 0.95),
    ("upstream_gene_variant", 0.6),
    ("downstream_gene_variant", 0.6),
    ("TF_binding_site_variant", 0.6),
    ("non_coding_transcript_exon_variant", 0.65),
    ("protein_altering_variant", 0.7),
    ("synonymous_variant", 0.65),
    ("inframe_insertion", 0.7),
    ("inframe_deletion", 0.7),
    ("conservative_inframe_deletion", 0.5),
    ("transcript_amplification", 0.6),
    ("regulatory_region_amplification", 0.6),
    ("TFBS_amplification", 0.6),
    ("transcript_ablation", 1.0),
    ("regulatory_region_ablation", 0.6),
    ("TFBS_ablation", 0.6),
    ("feature_truncation", 0.6),
    ("feature_elongation", 0.6),
    ("start_lost", 0.95),
    ("Nearest gene counting from 5' end", 0.5),
    ("Regulatory nearest gene 5' end", 0.6),
]

# ---------------------------------------------------------------------------
# Missing-value tokens of the delimited-text reader
# ("None" plus the usual NA spellings of dataframe libraries).
# ---------------------------------------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# Evidence columns. The transform keeps these 27 input columns and adds 3.
# ---------------------------------------------------------------------------
EVIDENCE_TYPES = {
    "ld_snp_rsID": T.StringType(),
    "GRCh38_chrom": T.StringType(),
    "GRCh38_pos": T.LongType(),
    "gene_symbol": T.StringType(),
    "gene_id": T.StringType(),
    "GRCh38_gene_chrom": T.StringType(),
    "GRCh38_gene_pos": T.LongType(),
    "disease_name": T.StringType(),
    "disease_efo_id": T.StringType(),
    "score": T.DoubleType(),
    "r2": T.DoubleType(),
    "gwas_source": T.StringType(),
    "gwas_snp": T.StringType(),
    "gwas_pvalue": T.DoubleType(),
    "gwas_odds_ratio": T.DoubleType(),
    "gwas_beta": T.DoubleType(),
    "gwas_size": T.LongType(),
    "gwas_pmid": T.StringType(),
    "gwas_study": T.StringType(),
    "vep_terms": T.StringType(),
    "GTEx": T.DoubleType(),
    "VEP": T.DoubleType(),
    "Fantom5": T.DoubleType(),
    "DHS": T.DoubleType(),
    "PCHiC": T.DoubleType(),
    "Nearest": T.DoubleType(),
    "Regulome": T.DoubleType(),
}
DERIVED_TYPES = {
    "ot_vep": T.DoubleType(),
    "gtex_max_tissue": T.StringType(),
    "gtex_max_value": T.DoubleType(),
}
TRANSFORMED_COLUMNS = list(EVIDENCE_TYPES) + list(DERIVED_TYPES)

# Row key carried through every stage (the "index" of the evidence tables).
KEY = "idx"

# Columns added by the processed build (gene coordinates, lead-variant mapping).
GENE_START = "GRCh38_gene_start"
GENE_END = "GRCh38_gene_end"
LEAD_CHROM = "GRCh38_gwas_snp_chrom"
LEAD_POS = "GRCh38_gwas_snp_pos"

# Tie-break order for representative rows and pages: row key, then the
# lead-variant mapping (a key can fan out over several mappings).
# Least and greatest of a row's four positions, stored in the chromosome layout.
FIRST_POS, LAST_POS = "first_pos", "last_pos"
ROW_ORDER = [KEY, LEAD_CHROM, LEAD_POS]

# Evidence names accepted as locus "must-haves": lower-case name -> column.
MUST_HAVE_COLUMNS = {
    "gtex": "GTEx",
    "vep": "VEP",
    "pchic": "PCHiC",
    "fantom5": "Fantom5",
    "dhs": "DHS",
    "nearest": "Nearest",
    "regulome": "Regulome",
}

# Selection types of the locus queries -> the column(s) they compare.
SIMPLE_SELECTIONS = {
    "gene": "gene_id",
    "variant": "ld_snp_rsID",
    "leadVariant": "gwas_snp",
    "disease": "disease_efo_id",
}
PAIR_SELECTIONS = {
    "geneVariant": ("gene_id", "ld_snp_rsID"),
    "variantLeadVariant": ("ld_snp_rsID", "gwas_snp"),
    "leadVariantDisease": ("gwas_snp", "disease_efo_id"),
}


def evidence_schema(tissues: list[str] | None = None) -> T.StructType:
    """Typed schema of evidence input: the kept columns plus tissue columns."""
    fields = [T.StructField(n, t, True) for n, t in EVIDENCE_TYPES.items()]
    fields += [T.StructField(n, T.DoubleType(), True)
               for n in (GTEX_TISSUES if tissues is None else tissues)]
    return T.StructType(fields)


def transformed_schema(with_key: bool = True) -> T.StructType:
    fields = [T.StructField(KEY, T.LongType(), True)] if with_key else []
    fields += [T.StructField(n, t, True) for n, t in EVIDENCE_TYPES.items()]
    fields += [T.StructField(n, t, True) for n, t in DERIVED_TYPES.items()]
    return T.StructType(fields)
