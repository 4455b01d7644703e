"""Windows met in their home cells: no pair of window and row is shuffled."""

import re

import pytest

from locusforge.operators import batch_locus as B
from locusforge.operators import locus as L
from locusforge.operators import predicates as P

LOCI = "locus_id string, chrom string, start bigint, end bigint"


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(L.OWN))
def test_what_windows_hold_is_not_shuffled(ds, name):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    out = L.locus_batch(ds.membership, ds.genes, loci, P.LocusFilters(score=(0.2, 0.6)), materialize=True, outputs=[name])
    lazy = L.locus_batch(ds.membership, ds.genes, loci, P.LocusFilters(score=(0.2, 0.6)))
    assert not re.search(r"hashpartitioning\(locus_id#\d+, (?!chrom)", _plan(out[name]))
    assert _rows(out[name]) == _rows(lazy[name]) != []


def test_sums_of_windows_are_made_where_they_meet(ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    got = B.summarise(ds.membership, loci, 1_000_000)
    assert not re.search(r"hashpartitioning\((chrom#\d+, _uwidth#\d+L, _cell#\d+L, )?locus_id", _plan(got))
    assert _rows(got) == _rows(B.locus_summary(B.batch_locus_rows(ds.membership, loci)))


def test_long_lists_negative_places_and_windows_of_all_lengths(spark, processed_rows, genes_lookup):
    """One disease with far more places in a cell than the head of a list, the first rows outside most windows."""
    near = dict(GRCh38_gene_start=-40, GRCh38_gene_end=3)
    rows = processed_rows(*[dict(idx=i, GRCh38_pos=9000 - 150 * i, gwas_snp=f"rs{i % 7}", gwas_pvalue=(i + 1) * 1e-9,
                                 GRCh38_gwas_snp_pos=20_000 + i, **near) for i in range(60)],
                          dict(idx=99, gwas_pvalue=None, GRCh38_pos=-70_000, GRCh38_gwas_snp_pos=-70_000, **near))
    loci = spark.createDataFrame(
        [(f"{s}+{n}", "7", s, s + n) for n in (0, 5, 400, 9_999, 10_000, 80_000, 700_000, 3_000_000)
         for s in (-70_000, -40, -5, 0, 150, 8990, 19_999, 20_055)] + [("backwards", "7", 9, 1), ("none", "MT", 0, 10)], LOCI)
    lazy = L.locus_batch(rows, genes_lookup("ENSG1"), loci)
    for name in L.OWN:
        alone = L.locus_batch(rows, genes_lookup("ENSG1"), loci, materialize=True, outputs=[name])[name]
        assert _rows(alone) == _rows(lazy[name]) != [], name
    assert _rows(B.summarise(rows, loci)) == _rows(B.locus_summary(B.batch_locus_rows(rows, loci)))


def test_windows_that_share_an_id_are_told_apart_from_the_others(spark):
    loci = spark.createDataFrame([("a", "7", 0, 9), ("b", "7", 0, 9), ("b", "X", 5, 9), ("c", "7", 0, B.LONGEST),
                                  ("d", "7", 9, 0), ("d", "7", 3, 4)], LOCI)
    alone, others, _ = B.split_loci(loci, B.LONGEST)
    assert {r["locus_id"] for r in alone.collect()} == {"a", "d"}
    assert sorted(r["locus_id"] for r in others.collect()) == ["b", "b", "c"]
    assert B.split_loci(loci.where("locus_id = 'a'"))[1] is None


def test_windows_alone_are_looked_up_in_few_copies_of_narrow_rows(spark, ds, monkeypatch):
    """Nothing is stored, a row of three near places stands in one or two cells, and the lead join carries no payload."""
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    alone, others, cell = B.split_loci(loci, B.LONGEST)
    assert others is None
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda *args, **kw: pytest.fail("stored"))
    for name in L.OWN:
        L.locus_batch(ds.ranked_membership, ds.genes, loci, materialize=True, outputs=[name])
    rows = ds.membership.where(P.resolved())
    copies = B._to_cells(rows, B.home_cells(alone, cell, B.TIMES), P.POSITIONS).count()
    assert 0 < copies < 2 * rows.count()
    found = L.locus_batch(ds.ranked_membership, ds.genes, loci, materialize=True, outputs=["leadVariants"])["leadVariants"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "vep_terms" not in plan.split("xxhash64")[0]


def test_ties_of_the_row_order_are_those_of_the_row_hash(ds):
    """The hash made before the lead join is that of the finished rows."""
    made = ds.ranked_membership.select("idx", "ld_snp_rsID", "chrom", "GRCh38_gwas_snp_pos", L.REST)
    after = L.ranked_rows(ds.membership).select(*made.columns)
    assert _rows(made) == _rows(after) != []


@pytest.mark.parametrize("times", [1, B.TIMES])
def test_a_window_meets_its_places_in_its_home_cell(spark, times):
    places = [-300_000, -275_001, -10_001, -10_000, -1, 0, 1, 9_999, 10_000, 79_999, 80_000, 2_200_007, 2 ** 62]
    rows = spark.createDataFrame([("7", p) for p in places], "chrom string, p bigint")
    loci = spark.createDataFrame([(f"{s}+{n}", "7", s, s + n) for s in [p - d for p in places for d in (0, 1, 9_999)]
                                  for n in (0, 9_999, 10_000, 275_000, 2 ** 57)], LOCI).distinct()
    windows = B.home_cells(loci, 275_001, times)
    near = B._to_cells(rows, windows, ["p"])
    met = B._in_cells(near, windows, near["p"].between(windows["_ls"], windows["_le"])).select("locus_id", "p")
    want = [(r.locus_id, p) for r in loci.collect() for p in places if r.start <= p <= r.end]
    assert sorted(map(tuple, met.collect())) == sorted(want)


def test_the_maximum_makes_no_list_of_places(ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    found = L.locus_batch(ds.membership, ds.genes, loci, materialize=True, outputs=["maxGwasPValue"])["maxGwasPValue"]
    plan = _plan(found)
    assert "collect_list" not in plan and "SortAggregate" not in plan
    assert _rows(found) == _rows(L.locus_batch(ds.membership, ds.genes, loci)["maxGwasPValue"]) != []
