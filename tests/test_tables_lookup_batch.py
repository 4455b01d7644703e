import pytest
from pyspark.sql import functions as F

from locusforge.operators import batch_locus as B
from locusforge.operators import locus as L
from locusforge.operators import lookup as K
from locusforge.operators import tables as TB


def test_pages_concatenate_to_total(ds):
    _, tot = TB.locus_table(ds.processed, "7", 3000000, 12000000)
    total = tot.first().total
    seen = []
    for off in range(0, total + 40, 40):
        pg, _ = TB.locus_table(ds.processed, "7", 3000000, 12000000, offset=off, limit=40)
        seen += [r["index"] for r in pg.collect()]
    assert len(seen) == total == 181
    past, tot2 = TB.locus_table(ds.processed, "7", 3000000, 12000000, offset=10**6, limit=10)
    assert past.count() == 0 and tot2.first().total == total


def test_keyset_equals_offset_paging(ds):
    rows = L.window_rows(ds.processed, "7", 3000000, 12000000)
    first = TB.keyset_page(rows, None, 30).collect()
    last = first[-1]
    nxt = TB.keyset_page(rows, (last["index"], last["_lead_chrom"], last["_lead_pos"]), 30).collect()
    by_offset = TB.page(rows, 30, 30).collect()
    assert [r["index"] for r in nxt] == [r["index"] for r in by_offset]


def test_disease_table_has_no_resolution_filter(ds):
    pg, tot = TB.disease_table(ds.processed, "EFO_7")
    assert tot.first().total == ds.processed.where("disease_efo_id = 'EFO_7'").count() == pg.count()


def test_variant_location_priority(processed_rows):
    df = processed_rows(
        dict(idx=1, ld_snp_rsID="rsA", gwas_snp="rsB", GRCh38_chrom="7", GRCh38_pos=10,
             GRCh38_gwas_snp_chrom="7", GRCh38_gwas_snp_pos=20),
        dict(idx=2, ld_snp_rsID="rsB", gwas_snp="rsC", GRCh38_chrom="8", GRCh38_pos=30,
             GRCh38_gwas_snp_chrom=None, GRCh38_gwas_snp_pos=None),
    )
    b = K.variant_location(df, "rsB").first()
    assert (b.isVariant, b.isLeadVariant, b.chromosome, b.position) == (True, True, "8", 30)
    c = K.variant_location(df, "rsC").first()
    assert (c.isVariant, c.isLeadVariant, c.chromosome, c.position) == (False, True, None, None)
    assert K.variant_location(df, "rsZ").count() == 0
    s = K.search(df, "rsC").collect()
    assert [(r.id, r.name, r.type) for r in s] == [("rsC", "rsC", "variant")]
    assert K.search(df, "rsZ").count() == 0


def test_gene_location(ds):
    one = K.gene_location(ds.gene_dim, "ENSG137").collect()
    assert len(one) == 1 and one[0].symbol is None and one[0].chromosome == "7"
    assert K.gene_location(ds.gene_dim, "ENSG23").count() == 0   # 23 % 23 == 0: no gene


def _pairs(df):
    # idx is not unique after the lead-variant fan-out: the mapping is part of the row key
    cols = ["locus_id", "idx", "chrom", "GRCh38_gwas_snp_chrom", "GRCh38_gwas_snp_pos"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_batch_locus_agrees_with_single_windows(ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    a, b = _pairs(B.batch_locus_rows(ds.membership, loci)), _pairs(B.batch_locus_rows(ds.processed, loci, 250_000))
    assert a == b and len(a) == len(set(a)) and len(a) > 0
    # equals a loop of single-window queries on a few loci
    for r in loci.orderBy("locus_id").limit(5).collect():
        single = L.window_rows(ds.processed, r.chrom, r.start, r.end).count()
        assert single == sum(1 for p in a if p[0] == r.locus_id)


def test_a_window_without_end_makes_no_more_bins_than_the_data(ds):
    wide = ds.spark.createDataFrame([("all", "7", -(10 ** 15), 10 ** 15), ("none", "7", 5, 4), ("far", "7", 10 ** 12, 10 ** 13)],
                                    "locus_id string, chrom string, start bigint, end bigint")
    got = B.batch_locus_rows(ds.membership, wide, 10_000)
    assert got.where("locus_id <> 'all'").count() == 0
    assert got.count() == L.window_rows(ds.processed, "7", 0, 10 ** 12).count() > 0


def test_binned_with_chosen_bin_size(ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    b = B.choose_bin_size(loci)
    assert B.MIN_BIN <= b <= B.MAX_BIN
    auto = _pairs(B.batch_locus_rows(ds.membership, loci, bin_size=None))
    fixed = _pairs(B.batch_locus_rows(ds.membership, loci, bin_size=1_000_000))
    assert auto == fixed


def test_batch_vertices_per_locus(ds):
    loci = B.loci_per_chromosome(ds.gene_dim, 3000000, 12000000)
    pairs = B.batch_locus_rows(ds.membership, loci)
    genes = L.gene_vertices(pairs, ds.genes, keys=["locus_id"]).where(F.col("locus_id") == "chr7")
    single = L.gene_vertices(L.window_rows(ds.processed, "7", 3000000, 12000000), ds.genes)
    assert sorted(r.id for r in genes.collect()) == sorted(r.id for r in single.collect())


def test_lookups_agree_on_the_id_table_and_the_processed_table(ds):
    qs = ds.evidence.selectExpr("gwas_snp AS query")
    ids = ds.ids.cache()
    a = sorted(r.id for r in K.search_batch(ds.processed, qs).collect())
    assert a == sorted(r.id for r in K.search_batch(ids, qs).collect()) and len(a) > 10
    for vid in ("rs342", a[0], "nope", "rs100"):
        assert K.variant_location(ids, vid).collect() == K.variant_location(ds.processed, vid).collect()
        assert K.search(ids, vid).collect() == K.search(ds.processed, vid).collect()
    ids.unpersist()


def test_keyset_pages_cover_all_rows_under_any_sort(ds):
    rows = ds.processed.where("disease_efo_id = 'EFO_7'").withColumn(
        "gwas_odds_ratio", F.when(F.col("idx") % 3 == 0, F.lit(None)).otherwise(F.col("idx") % 5).cast("double"))
    for sort in ((), ("-gwasPValue",), ("gwasOddsRatio", "-r2"), ("-gwasOddsRatio", "efoId")):
        whole = [r["index"] for r in TB.page(rows, 0, None, TB.sort_columns(sort)).collect()]
        got, after = [], ()
        while page := TB.keyset_page(rows, after, 17, sort).collect():
            got += [r["index"] for r in page]
            after = TB.cursor(page[-1], sort)
        assert got == whole and len(got) > 50, sort
        assert [r["index"] for r in TB.page(rows, 20, None, TB.sort_columns(sort)).collect()] == whole[20:]
    with pytest.raises(ValueError):
        TB.keyset_page(rows, (1, 2), 5)


def test_range_arguments_need_exactly_two_values(ds):
    from locusforge.operators import predicates as P
    base = TB.locus_table(ds.processed, "7", 3000000, 12000000)[1].first().total
    for bad in [(0.5,), (0.1, 0.2, 0.3), ()]:
        f = P.LocusFilters(score=bad, r2=bad, pvalue=bad)
        assert f.predicate() is None
        assert TB.locus_table(ds.processed, "7", 3000000, 12000000, f)[1].first().total == base
    with pytest.raises(ValueError):
        TB.sort_columns(["noSuchField"])
    with pytest.raises(ValueError):
        TB.locus_table(ds.processed, "7", 1, 2, P.LocusFilters(must_haves=("score",)))


def test_locus_batch_equals_single_requests(ds):
    loci = B.loci_per_chromosome(ds.gene_dim, 3000000, 12000000)
    batch = L.locus_batch(ds.membership, ds.genes, loci, materialize=True)
    single = L.locus(ds.processed, ds.genes, L.Locus("7", 3000000, 12000000))
    for key in ["genes", "variants", "leadVariants", "diseases", "geneVariants",
                "variantLeadVariants", "leadVariantDiseases"]:
        b = sorted(r.id or "" for r in batch[key].where(F.col("locus_id") == "chr7").collect())
        s = sorted(r.id or "" for r in single[key].collect())
        assert b == s, key
    bp = batch["maxGwasPValue"].where(F.col("locus_id") == "chr7").first().maxGwasPValue
    assert bp == single["maxGwasPValue"].first().maxGwasPValue
