import pytest
from pyspark.sql import functions as F

from locusforge.operators import locus as L
from locusforge.operators import predicates as P


def _req(**kw):
    return L.Locus("7", 1000, 2000, **kw)


def test_window_edges_inclusive_and_spanning_gene(processed_rows, genes_lookup):
    df = processed_rows(
        dict(idx=1, GRCh38_pos=1000, GRCh38_gene_start=1, GRCh38_gene_end=2, GRCh38_gwas_snp_pos=3),
        dict(idx=2, GRCh38_pos=2000, GRCh38_gene_start=1, GRCh38_gene_end=2, GRCh38_gwas_snp_pos=3),
        dict(idx=3, GRCh38_pos=5, GRCh38_gene_start=500, GRCh38_gene_end=5000, GRCh38_gwas_snp_pos=3),
        dict(idx=4, GRCh38_pos=5, GRCh38_gene_start=1, GRCh38_gene_end=2, GRCh38_gwas_snp_pos=1500),
        dict(idx=5, GRCh38_pos=1500, GRCh38_gene_start=None),              # unresolved gene
        dict(idx=6, GRCh38_pos=1500, GRCh38_gwas_snp_pos=None),            # unresolved lead
    )
    got = sorted(r.idx for r in L.window_rows(df, "7", 1000, 2000).collect())
    assert got == [1, 2, 4]


def test_position_on_other_chromosome_matches(processed_rows):
    # Row belongs to chr_7 by its lead variant; its variant position on chr 8
    # still falls in the window and is not re-checked.
    df = processed_rows(dict(GRCh38_chrom="8", GRCh38_gene_chrom="8", GRCh38_pos=1500,
                             GRCh38_gene_start=1, GRCh38_gene_end=2, GRCh38_gwas_snp_chrom="7",
                             GRCh38_gwas_snp_pos=10))
    assert L.window_rows(df, "7", 1000, 2000).count() == 1
    with pytest.raises(ValueError):
        L.window_rows(df, "0", 1000, 2000)


def test_representative_row_is_one_row(processed_rows, genes_lookup):
    df = processed_rows(
        dict(idx=2, score=0.9, gtex_max_value=0.1, GRCh38_pos=1500),
        dict(idx=1, score=0.3, gtex_max_value=0.7, GRCh38_pos=1500, GRCh38_gwas_snp_chrom="X"),
        dict(idx=1, score=0.4, gtex_max_value=0.8, GRCh38_pos=1500, GRCh38_gwas_snp_chrom="7"),
    )
    out = L.locus(df, genes_lookup("ENSG1"), _req())["geneVariants"].collect()
    assert len(out) == 1
    # smallest (idx, lead chrom, lead pos): idx 1, chrom '7' < 'X'
    assert (out[0].otG2VScore, out[0].gtexMaxValue) == (0.4, 0.8)
    assert out[0].selected is None and out[0].geneTss == 4000 and out[0].nearest is True


def test_selection_flags(processed_rows, genes_lookup):
    df = processed_rows(
        dict(idx=1, GRCh38_pos=1500, gene_id="ENSG1", ld_snp_rsID="rs1", disease_efo_id=None),
        dict(idx=2, GRCh38_pos=1500, gene_id="ENSG2", ld_snp_rsID="rs2", disease_efo_id="EFO_2"),
    )
    g = L.locus(df, genes_lookup("ENSG1", "ENSG2"), _req(selected_id="ENSG2", selected_type="gene"))
    genes = g["genes"].collect()
    assert [(r.id, r.selected) for r in genes] == [("ENSG1", False), ("ENSG2", True)]  # selected last
    d = L.locus(df, genes_lookup("ENSG1", "ENSG2"), _req(selected_id="EFO_2", selected_type="disease"))
    flags = {r.id: r.selected for r in d["diseases"].collect()}
    assert flags == {None: False, "EFO_2": True}   # NULL disease is its own group, flag false
    pair = L.locus(df, genes_lookup("ENSG1", "ENSG2"),
                   _req(selected_id="ENSG2-rs2-extra", selected_type="geneVariant"))
    assert {r.id: r.selected for r in pair["geneVariants"].collect()} == {"ENSG1-rs1": False,
                                                                          "ENSG2-rs2": True}
    one_part = L.locus(df, genes_lookup("ENSG1", "ENSG2"), _req(selected_id="ENSG2",
                                                                selected_type="geneVariant"))
    assert not any(r.selected for r in one_part["geneVariants"].collect())


def test_max_pvalue_empty_and_zero(processed_rows, genes_lookup):
    df = processed_rows(dict(GRCh38_pos=1500, gwas_pvalue=0.0))
    assert L.locus(df, genes_lookup("ENSG1"), _req())["maxGwasPValue"].first()[0] is None
    empty = L.locus(df, genes_lookup("ENSG1"), L.Locus("7", 10**9, 10**9 + 1))
    assert empty["maxGwasPValue"].first()[0] is None


def test_edges_filtered_vertices_not(processed_rows, genes_lookup):
    df = processed_rows(dict(idx=1, GRCh38_pos=1500, score=0.1), dict(idx=2, GRCh38_pos=1500,
                                                                     ld_snp_rsID="rs2", score=0.9))
    out = L.locus(df, genes_lookup("ENSG1"), _req(filters=P.LocusFilters(score=(0.5, 1.0))))
    assert out["variants"].count() == 2
    assert [r.vId for r in out["geneVariants"].collect()] == ["rs2"]
    with pytest.raises(ValueError):
        P.must_have(["bogus"])


def test_edge_endpoints_are_vertices(ds):
    out = L.locus(ds.processed, ds.genes, L.Locus("7", 3000000, 12000000))
    v = {r.id for r in out["variants"].collect()}
    lv = {r.id for r in out["leadVariants"].collect()}
    assert {r.vId for r in out["variantLeadVariants"].collect()} <= v
    assert {r.lvId for r in out["variantLeadVariants"].collect()} <= lv


def test_entry_flagship(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 41
    assert "geneTss" in df.columns and df.where(F.col("id").isNull()).count() == 0


@pytest.mark.parametrize("sf,expected", [
    ("sf0.001", dict(rows=181, genes=13, variants=41, leadVariants=18, diseases=46,
                     geneVariants=41, variantLeadVariants=57, leadVariantDiseases=145, other=56)),
    ("sf0.01", dict(rows=164, genes=14, variants=46, leadVariants=19, diseases=49,
                    geneVariants=46, variantLeadVariants=57, leadVariantDiseases=144, other=53)),
])
def test_default_locus_matches_measured_shape(spark, sf, expected):
    """FIXTURES.md B.7: the default locus measured independently in DuckDB."""
    from locusforge.plans.build import Dataset
    ds = Dataset(spark, f"/root/testdata/{sf}")
    w = L.window_rows(ds.processed, "7", 3000000, 12000000)
    out = L.locus(ds.processed, ds.genes, L.Locus("7", 3000000, 12000000))
    got = {k: out[k].count() for k in expected if k not in ("rows", "other")}
    got["rows"] = w.count()
    got["other"] = w.where("GRCh38_chrom <> '7'").count()
    assert got == expected
