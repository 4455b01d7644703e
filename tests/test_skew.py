"""A key holding a third of all rows: results stay whole and exact."""

import pandas as pd
from pyspark.sql import functions as F

from locusforge import schemas as S
from locusforge.operators import locus as L
from locusforge.operators import lookup as K


def _skewed(ds):
    # a third of the processed rows get the same gene, variant and lead variant
    hot = (F.col("idx") % 3 == 0)
    return (ds.processed
            .withColumn("gene_id", F.when(hot, F.lit("ENSG137")).otherwise(F.col("gene_id")))
            .withColumn("ld_snp_rsID", F.when(hot, F.lit("rsHOT")).otherwise(F.col("ld_snp_rsID")))
            .withColumn("gwas_snp", F.when(hot, F.lit("rsLEAD")).otherwise(F.col("gwas_snp"))))


def _brute_representative(pdf: pd.DataFrame, key: str, cols: list[str]) -> pd.DataFrame:
    order = pdf.sort_values(S.ROW_ORDER, na_position="first", kind="mergesort")
    return order.groupby(key, dropna=False, sort=False).head(1).set_index(key)[cols]


def test_variant_locations_under_skew(spark, ds):
    p = _skewed(ds)
    pdf = p.select("idx", "ld_snp_rsID", "gwas_snp", "GRCh38_chrom", "GRCh38_pos", S.LEAD_CHROM,
                   S.LEAD_POS).toPandas()
    got = {r.id: (r.chromosome, r.position) for r in K.variant_locations(p).collect()}
    want_v = _brute_representative(pdf, "ld_snp_rsID", ["GRCh38_chrom", "GRCh38_pos"])
    for vid, row in want_v.iterrows():
        assert got[vid] == (row.GRCh38_chrom, int(row.GRCh38_pos))
    assert (pdf.ld_snp_rsID == "rsHOT").sum() >= len(pdf) // 3 - 1


def test_gene_variant_edges_under_skew(spark, ds):
    p = _skewed(ds)
    rows = L.window_rows(p, "7", 0, 10**9)
    got = L.gene_variant_edges(rows, ds.genes).collect()
    pdf = rows.select("idx", "gene_id", "ld_snp_rsID", "score", S.LEAD_CHROM, S.LEAD_POS).toPandas()
    pdf["pair"] = pdf.gene_id + "-" + pdf.ld_snp_rsID
    want = _brute_representative(pdf, "pair", ["score"])
    assert len(got) == len(want)
    assert all(r.otG2VScore == want.loc[r.id, "score"] for r in got)
