"""Nested annotation records -> flat rows.

Gene records carry an array of transcripts, each with an array of exons and
an optional translation; variant records carry an array of mappings. All
access is struct / array expressions, evaluated per row inside the scan
stage: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENE_RECORD_DDL = (
    "struct<id:string, display_name:string, description:string, start:bigint, end:bigint, "
    "strand:int, seq_region_name:string, biotype:string, "
    "Transcript:array<struct<id:string, start:bigint, end:bigint, strand:int, is_canonical:int, "
    "Exon:array<struct<id:string, start:bigint, end:bigint>>, "
    "Translation:struct<start:bigint, end:bigint>>>>"
)
VARIANT_RECORD_DDL = (
    "struct<name:string, MAF:double, ancestral_allele:string, minor_allele:string, "
    "mappings:array<struct<start:bigint, seq_region_name:string>>>"
)


def canonical_transcript(transcripts: Column) -> Column:
    """The transcript flagged canonical; NULL unless exactly one is."""
    canon = F.filter(transcripts, lambda t: t["is_canonical"] == 1)
    return F.when(F.size(canon) == 1, canon[0])


def flatten_gene_record(df: DataFrame, col: str = "gene") -> DataFrame:
    """C11: one flat row per gene record, canonical transcript fields prefixed ``ct_``."""
    g = F.col(col)
    ct = canonical_transcript(g["Transcript"])
    return df.select(
        g["id"].alias("id"),
        g["display_name"].alias("name"),
        g["description"].alias("description"),
        g["start"].alias("start"),
        g["end"].alias("end"),
        (g["strand"] == 1).alias("forwardStrand"),
        g["biotype"].alias("biotype"),
        g["seq_region_name"].alias("chromosome"),
        ct["id"].alias("ct_id"),
        ct["start"].alias("ct_start"),
        ct["end"].alias("ct_end"),
        (ct["strand"] == 1).alias("ct_forwardStrand"),
        F.when(ct["strand"] == 1, ct["start"]).otherwise(ct["end"]).alias("ct_tss"),
        F.transform(ct["Exon"], lambda e: F.struct(e["id"].alias("id"), e["start"].alias("start"),
                                                   e["end"].alias("end"))).alias("ct_exons"),
        ct["Translation"]["start"].alias("ct_translationStart"),
        ct["Translation"]["end"].alias("ct_translationEnd"),
    )


def flatten_variant_record(df: DataFrame, col: str = "variant") -> DataFrame:
    """One flat row per variant record; location from the first mapping
    (NULL when there is none)."""
    v = F.col(col)
    first = F.try_element_at(v["mappings"], F.lit(1))
    return df.select(
        v["name"].alias("id"),
        v["MAF"].alias("maf"),
        v["ancestral_allele"].alias("ancestralAllele"),
        v["minor_allele"].alias("minorAllele"),
        first["start"].alias("position"),
        first["seq_region_name"].alias("chromosome"),
    )
