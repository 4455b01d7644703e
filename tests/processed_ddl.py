# Columns of a processed row; tests build small literal tables from dicts.
PROCESSED_DDL = (
    "idx bigint, ld_snp_rsID string, GRCh38_chrom string, GRCh38_pos bigint, gene_symbol string, "
    "gene_id string, GRCh38_gene_chrom string, GRCh38_gene_pos bigint, disease_name string, "
    "disease_efo_id string, score double, r2 double, gwas_source string, gwas_snp string, "
    "gwas_pvalue double, gwas_odds_ratio double, gwas_beta double, gwas_size bigint, gwas_pmid string, "
    "gwas_study string, vep_terms string, GTEx double, VEP double, Fantom5 double, DHS double, "
    "PCHiC double, Nearest double, Regulome double, ot_vep double, gtex_max_tissue string, "
    "gtex_max_value double, GRCh38_gene_start bigint, GRCh38_gene_end bigint, "
    "GRCh38_gwas_snp_chrom string, GRCh38_gwas_snp_pos bigint"
)
