"""Point lookups (Q4 gene location, Q5 variant location, Q6 search), each in a
single-id form and a batch form that joins a DataFrame of ids.

The single forms filter by a literal, which Parquet checks against row-group
statistics and bloom filters; they are meant for the id-keyed table
(``id_table``) that ``plans.build.write_tables`` stores. The batch forms join a
DataFrame of ids, never looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusforge import schemas as S


# ---------------------------------------------------------------------------
# Q4: gene location
# ---------------------------------------------------------------------------
def gene_location_batch(genes: DataFrame, ids: DataFrame, id_col: str = "gene_id") -> DataFrame:
    """One row per query id: id, symbol (never known), chromosome, start, end.

    Unknown ids keep their row with NULL location fields (``found`` false).
    """
    g = genes.select(F.col("gene_id").alias("_gid"), F.col("chr").alias("chromosome"),
                     F.col("gene_start").alias("start"), F.col("gene_end").alias("end"))
    q = ids.select(F.col(id_col).alias("id"))
    out = q.join(g, q["id"] == g["_gid"], "left")
    return out.select("id", F.lit(None).cast("string").alias("symbol"), "chromosome", "start",
                      "end", F.col("_gid").isNotNull().alias("found"))


def gene_location(genes: DataFrame, gene_id: str) -> DataFrame:
    """0 or 1 row: the gene's location (empty when unknown)."""
    return genes.where(F.col("gene_id") == F.lit(gene_id)).select(
        F.col("gene_id").alias("id"), F.lit(None).cast("string").alias("symbol"),
        F.col("chr").alias("chromosome"), F.col("gene_start").alias("start"), F.col("gene_end").alias("end"))


# ---------------------------------------------------------------------------
# Q5: variant location
# ---------------------------------------------------------------------------
def _first_place(processed: DataFrame, key: str, chromosome: str, position: str) -> DataFrame:
    """(key, chromosome, position) of each id's first row in row order.

    Rows of an id with one place and one lead-variant place differ in idx
    alone: a hash aggregate keeps the smallest, partial before the shuffle. Of
    the few places that are left of an id, the first in row order is taken.
    """
    places = list(dict.fromkeys([S.LEAD_CHROM, S.LEAD_POS, chromosome, position]))
    least = processed.groupBy(key, *places).agg(F.min(S.KEY).alias("_least"),
                                                F.bool_or(F.col(S.KEY).isNull()).alias("_unnumbered"))
    order = [F.col("_unnumbered").desc(), *[F.col(c).asc_nulls_first() for c in ("_least", *places)]]
    first = least.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1")
    return first.select(key, F.col(chromosome).alias("chromosome"), F.col(position).alias("position"))


def variant_dim(processed: DataFrame) -> DataFrame:
    """Per variant id: chromosome and position from its representative row."""
    return _first_place(processed, "ld_snp_rsID", "GRCh38_chrom", "GRCh38_pos")


def lead_variant_dim(processed: DataFrame) -> DataFrame:
    """Per lead-variant id: mapping chromosome and position from its representative row."""
    return _first_place(processed, "gwas_snp", S.LEAD_CHROM, S.LEAD_POS)


def _locations(variant_rows: DataFrame, lead_rows: DataFrame) -> DataFrame:
    """Full outer join of the two per-id dimensions; the variant's own location
    wins, a lead-variant-only id takes its mapping."""
    v = variant_dim(variant_rows).select(F.col("ld_snp_rsID").alias("id"),
                                         F.col("chromosome").alias("_vc"), F.col("position").alias("_vp"),
                                         F.lit(True).alias("_is_var"))
    lv = lead_variant_dim(lead_rows).select(F.col("gwas_snp").alias("id"),
                                            F.col("chromosome").alias("_lc"), F.col("position").alias("_lp"),
                                            F.lit(True).alias("_is_lead"))
    both = v.join(lv, "id", "full_outer")
    is_var = F.coalesce(F.col("_is_var"), F.lit(False))
    return both.select(
        "id",
        F.when(is_var, F.col("_vc")).otherwise(F.col("_lc")).alias("chromosome"),
        F.when(is_var, F.col("_vp")).otherwise(F.col("_lp")).alias("position"),
        F.coalesce(F.col("_is_lead"), F.lit(False)).alias("isLeadVariant"),
        is_var.alias("isVariant"),
    )


def variant_locations(processed: DataFrame) -> DataFrame:
    """Every id that is a variant or a lead variant, with its location."""
    return _locations(processed, processed)


def id_table(processed: DataFrame) -> DataFrame:
    """The id-keyed table of Q5 and Q6: (id, chromosome, position, isLeadVariant, isVariant)."""
    return variant_locations(processed).where(F.col("id").isNotNull())


def variant_location_batch(processed: DataFrame, ids: DataFrame, id_col: str = "variant_id") -> DataFrame:
    """Locations of the query ids that are known (unknown ids drop out).

    Both per-id dimensions are restricted to the query ids with semi joins
    before they are aggregated, so only the relevant rows are grouped.
    """
    q = ids.select(F.col(id_col).alias("_q")).distinct()
    pv = processed.join(q, processed["ld_snp_rsID"] == q["_q"], "left_semi")
    pl = processed.join(q, processed["gwas_snp"] == q["_q"], "left_semi")
    return _locations(pv, pl)


def variant_location(source: DataFrame, variant_id: str) -> DataFrame:
    """0 or 1 row (Q5), from the stored ``id_table`` or from the processed table."""
    wanted = F.lit(variant_id)
    if "isLeadVariant" in source.columns:
        return source.where(F.col("id") == wanted)
    return _locations(source.where(F.col("ld_snp_rsID") == wanted), source.where(F.col("gwas_snp") == wanted))


# ---------------------------------------------------------------------------
# Q6: search (exact id match; a lead variant is labelled 'variant' too)
# ---------------------------------------------------------------------------
def _found(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.col("id").alias("name"), F.lit("variant").alias("type"))


def search_batch(source: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """One row per query string that is a variant or lead-variant id.

    ``source`` is the stored ``id_table`` or the processed table, whose ids are
    made distinct (partially on the map side) before they meet the queries.
    """
    q = queries.select(F.col(query_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    if "isLeadVariant" in source.columns:
        return _found(source.select("id").join(q, "id", "left_semi"))
    ids = (source.select(F.col("ld_snp_rsID").alias("id"))
           .unionByName(source.select(F.col("gwas_snp").alias("id"))))
    return _found(ids.distinct().join(q, "id", "left_semi"))


def search(source: DataFrame, query: str) -> DataFrame:
    """0 or 1 row (Q6), from the stored ``id_table`` or from the processed table."""
    return _found(variant_location(source, query))
