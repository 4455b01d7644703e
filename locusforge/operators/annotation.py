"""Gene and lead-variant annotation (Q8, Q9; J3-J5, J7; A1-A3; P11).

The annotation tables are DataFrames (Parquet or ``spark.read.jdbc``); ids
are restricted with semi joins, never with id lists built on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.functions.scores import exon_pair, forward_strand, tss

GENE_KEYS = ["gene_id", "description", "tss", "chr", "gene_start", "gene_end", "fwdstrand"]


def primary_regions(seq_region: DataFrame, coord_system_id: int = 4) -> DataFrame:
    """Chromosome-level regions whose name does not contain CHR (any case)."""
    return (seq_region
            .where((F.col("coord_system_id") == coord_system_id) & ~F.col("name").rlike("(?i)CHR"))
            .select("seq_region_id", F.col("name").alias("chr")))


def canonical_exons(exon_transcript: DataFrame, exon: DataFrame, gene: DataFrame,
                    transcript: DataFrame, seq_region: DataFrame) -> DataFrame:
    """One row per exon of each gene's canonical transcript on a primary region."""
    g = (gene.join(primary_regions(seq_region), "seq_region_id")
             .select(F.col("stable_id").alias("gene_id"), "description", "chr",
                     F.col("seq_region_start").alias("gene_start"),
                     F.col("seq_region_end").alias("gene_end"),
                     F.col("canonical_transcript_id").alias("transcript_id")))
    t = transcript.select("transcript_id", F.col("seq_region_strand").alias("strand"))
    e = exon.select("exon_id", F.col("seq_region_start").alias("exon_start"),
                    F.col("seq_region_end").alias("exon_end"))
    rows = (exon_transcript.select("exon_id", "transcript_id")
            .join(g, "transcript_id").join(t, "transcript_id").join(e, "exon_id"))
    fwd = forward_strand("strand")
    return rows.select("gene_id", "description", "chr", "gene_start", "gene_end",
                       fwd.alias("fwdstrand"),
                       tss("gene_start", "gene_end", fwd).alias("tss"),
                       "exon_id", "transcript_id", "exon_start", "exon_end")


def gene_rollup(exon_rows: DataFrame, drop_null_keys: bool = True) -> DataFrame:
    """A1: one row per gene with its exon pairs, sorted.

    Grouping keys with a NULL (e.g. a gene without description) drop the gene,
    as a dataframe group-by does; ``drop_null_keys=False`` keeps them.
    """
    rows = exon_rows
    if drop_null_keys:
        rows = rows.dropna(subset=GENE_KEYS)
    return (rows.groupBy(*GENE_KEYS)
            .agg(F.sort_array(F.collect_list(exon_pair("exon_start", "exon_end"))).alias("exons")))


def build_genes(exon_transcript: DataFrame, exon: DataFrame, gene: DataFrame,
                transcript: DataFrame, seq_region: DataFrame,
                drop_null_keys: bool = True) -> DataFrame:
    """Q8: gene lookup (gene_id, description, tss, chr, start, end, strand, exons)."""
    return gene_rollup(canonical_exons(exon_transcript, exon, gene, transcript, seq_region),
                       drop_null_keys)


def genes_from_dim(gene_dim: DataFrame, exons: DataFrame) -> DataFrame:
    """Gene lookup from a flat gene dimension plus an exon table.

    Exons are aggregated per gene first (narrow key), then joined to the
    dimension, so the wide gene columns never pass through the shuffle twice.
    """
    per_gene = (exons.groupBy("gene_id")
                .agg(F.sort_array(F.collect_list(exon_pair("exon_start", "exon_end"))).alias("exons")))
    fwd = forward_strand("strand")
    return (gene_dim.join(per_gene, "gene_id", "left")
            .select("gene_id", "description",
                    tss("gene_start", "gene_end", fwd).alias("tss"), "chr",
                    "gene_start", "gene_end", fwd.alias("fwdstrand"),
                    F.coalesce("exons", F.array().cast("array<struct<start:bigint,end:bigint>>"))
                    .alias("exons")))


def genes_per_chromosome(genes: DataFrame) -> DataFrame:
    """A2: number of genes per chromosome, most first."""
    return (genes.groupBy("chr").agg(F.count(F.lit(1)).alias("n_genes"))
            .orderBy(F.desc("n_genes"), "chr"))


def distinct_lead_variants(raw: DataFrame) -> DataFrame:
    """A3: distinct non-NULL lead-variant ids of the evidence."""
    return raw.select("gwas_snp").where(F.col("gwas_snp").isNotNull()).distinct()


def variants_in_evidence(variation: DataFrame, raw: DataFrame) -> DataFrame:
    """Variations named in the evidence (semi join, no id list)."""
    ids = distinct_lead_variants(raw)
    return variation.join(ids, variation["name"] == ids["gwas_snp"], "left_semi")


def build_lead_variants(raw: DataFrame, variation: DataFrame, variation_feature: DataFrame,
                        seq_region: DataFrame) -> DataFrame:
    """Q9 (J4 + J5): every mapping of every lead variant of the evidence.

    No region filter: a variant mapped on a chromosome and on an alternative
    haplotype yields two rows (the fan-out of the processed join).
    """
    v = variants_in_evidence(variation, raw).select("variation_id", F.col("name").alias("gwas_snp"))
    vf = variation_feature.select("variation_id", "seq_region_id",
                                  F.col("seq_region_start").alias("position"))
    r = seq_region.select("seq_region_id", F.col("name").alias("seq_region_name"))
    return v.join(vf, "variation_id").join(r, "seq_region_id").select(
        "gwas_snp", "position", "seq_region_name")


def unresolved_genes(raw: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene ids of the evidence with no gene annotation."""
    ids = raw.select("gene_id").where(F.col("gene_id").isNotNull()).distinct()
    return ids.join(genes.select("gene_id"), "gene_id", "left_anti")


def unresolved_lead_variants(raw: DataFrame, leads: DataFrame) -> DataFrame:
    """Lead-variant ids of the evidence with no mapping."""
    return distinct_lead_variants(raw).join(leads.select("gwas_snp"), "gwas_snp", "left_anti")
