"""Sums over windows without a row for each window and id; batch outputs one at a time."""

import pytest
from pyspark.sql import functions as F

from locusforge.operators import batch_locus as B
from locusforge.operators import locus as L
from locusforge.operators import predicates as P

LOCI = "locus_id string, chrom string, start bigint, end bigint"


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def loci(ds):
    wide = ds.spark.createDataFrame([("all of 7", "7", 0, 300_000_000), ("far too long", "9", -5, 10 ** 15),
                                     ("backwards", "7", 10, 5), ("no such table", "MT", 0, 10 ** 9),
                                     ("two", "7", 0, 9_000_000), ("two", "7", 5_000_000, 60_000_000), ("two", "X", 0, 10 ** 8),
                                     (None, "3", 0, 20_000_000), (None, "4", 0, 20_000_000),
                                     ("twin", "5", 0, 50_000_000), ("twin", "5", 0, 50_000_000)], LOCI)
    return B.loci_around_genes(ds.gene_dim, 100_000).unionByName(wide)


@pytest.mark.parametrize("bin_size", [10_000, 1_000_000, None])
def test_sums_by_first_places_are_those_of_the_pairs(ds, loci, bin_size):
    want = B.locus_summary(B.batch_locus_rows(ds.membership, loci, bin_size))
    got = B.summarise(ds.processed, loci, bin_size)
    assert got.columns == want.columns
    assert _rows(got) == _rows(want) != []


def test_rows_alike_null_ids_and_places_that_meet(spark, processed_rows):
    rows = processed_rows(
        dict(idx=1, GRCh38_pos=5100, GRCh38_gwas_snp_pos=5100), dict(idx=1, GRCh38_pos=5100, GRCh38_gwas_snp_pos=5100),
        dict(idx=2, gene_id=None, ld_snp_rsID=None, GRCh38_pos=None, gwas_pvalue=float("nan")),
        dict(idx=3, disease_efo_id=None, gwas_pvalue=None, GRCh38_gene_end=-7, GRCh38_pos=-9))
    loci = spark.createDataFrame([("w", "7", 4000, 6000), ("x", "7", 5100, 5100), ("y", "7", -10, -7), ("z", "7", 0, 10 ** 9)],
                                 LOCI)
    want = B.locus_summary(B.batch_locus_rows(rows, loci))
    assert _rows(B.summarise(rows, loci)) == _rows(want) != []


def test_no_id_is_held_for_a_window(ds, loci):
    """What the windows shuffle are sums of places: nothing is grouped by window and id."""
    once = B.locus_summary(B.batch_locus_rows(B.first_places(ds.processed), loci))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan.split("Join Inner")[0]


@pytest.mark.parametrize("name", list(L.OWN))
def test_an_output_by_itself_is_that_of_all_eight(ds, loci, name):
    filters = P.LocusFilters(("VEP",), (0.2, 0.6), pvalue=(7.5, 8.5))
    alone = L.locus_batch(ds.membership, ds.genes, loci, filters, materialize=True, outputs=[name])
    lazy = L.locus_batch(ds.membership, ds.genes, loci, filters)[name]
    assert list(alone) == [name] and alone[name].columns == lazy.columns
    assert _rows(alone[name]) == _rows(lazy) != []


def test_an_output_by_itself_stores_its_own_columns(spark, ds, loci, monkeypatch):
    stored, write = [], type(spark.range(1).write).parquet

    def noted(writer, path, *args, **kw):
        stored.append(writer._df.columns)
        return write(writer, path, *args, **kw)
    monkeypatch.setattr(type(spark.range(1).write), "parquet", noted)
    L.locus_batch(ds.membership, ds.genes, loci, materialize=True, outputs=["diseases"])
    L.locus_batch(ds.membership, ds.genes, loci, materialize=True, outputs=["maxGwasPValue"])
    assert len(stored) == 1 and "disease_name" in stored[0] and "vep_terms" not in stored[0]
