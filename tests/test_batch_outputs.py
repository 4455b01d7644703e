"""The one-pass form of the batch outputs and the nested bins of the window join."""

import pytest
from pyspark.sql import functions as F

from locusforge.operators import batch_locus as B
from locusforge.operators import locus as L
from locusforge.operators import lookup as K
from locusforge.operators import predicates as P
from locusforge.operators.processed import chromosome_membership


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


@pytest.fixture(scope="module")
def loci(ds):
    wide = ds.spark.createDataFrame([("all of 7", "7", 0, 300_000_000), ("far too long", "9", -5, 10 ** 15),
                                     ("backwards", "7", 10, 5), ("no such table", "MT", 0, 10 ** 9)],
                                    "locus_id string, chrom string, start bigint, end bigint")
    return B.loci_around_genes(ds.gene_dim, 100_000).unionByName(wide)


@pytest.mark.parametrize("selection, layout", [(None, True), (("ENSG137", "gene"), False)])
def test_one_pass_gives_what_the_lazy_outputs_give(ds, loci, selection, layout):
    source = ds.membership if layout else ds.processed
    filters, flag = P.LocusFilters(score=(0.2, 0.6), pvalue=(7.5, 8.5)), selection and P.selection(*selection)
    once = L.locus_batch(source, ds.genes, loci, filters, flag, materialize=True)
    lazy = L.locus_batch(source, ds.genes, loci, filters, flag)
    assert list(once) == list(lazy)
    for name in once:
        assert once[name].columns == lazy[name].columns
        assert _rows(once[name]) == _rows(lazy[name]) != []


def test_rows_of_equal_idx_and_null_idx(spark, processed_rows, genes_lookup):
    """Fan-out copies share an idx: only those in the window count, the first of them in row order."""
    rows = processed_rows(
        dict(idx=2, gwas_snp="rsL", GRCh38_gwas_snp_pos=99, GRCh38_pos=10 ** 7, GRCh38_gene_start=10 ** 7,
             GRCh38_gene_end=10 ** 7),
        dict(idx=2, gwas_snp="rsL", GRCh38_gwas_snp_pos=5100), dict(idx=2, gwas_snp="rsL", GRCh38_gwas_snp_pos=5050),
        dict(idx=None, gwas_snp="rsM", GRCh38_gwas_snp_pos=5900), dict(idx=-7, gwas_snp="rsM", GRCh38_gwas_snp_pos=5001),
        dict(idx=1, gene_id=None, ld_snp_rsID=None, gwas_pvalue=float("nan")))
    loci = spark.createDataFrame([("w", "7", 4000, 6000)], "locus_id string, chrom string, start bigint, end bigint")
    once = L.locus_batch(rows, genes_lookup("ENSG1"), loci, materialize=True)
    assert {(r["id"], r["position"]) for r in once["leadVariants"].collect()} == {
        ("rsL", 5050), ("rsM", 5900), ("rs9", 5200)}
    lazy = L.locus_batch(rows, genes_lookup("ENSG1"), loci)
    for name in once:
        assert _rows(once[name]) == _rows(lazy[name])


def test_groups_are_hash_aggregates(spark, ds, loci, monkeypatch):
    """No sort by group: what is written are partial and final hash aggregates over one scan of the pairs."""
    plans = []
    write = type(spark.range(1).write).parquet

    def noted(writer, path, *args, **kw):
        plans.append(_plan(writer._df))
        return write(writer, path, *args, **kw)
    monkeypatch.setattr(type(spark.range(1).write), "parquet", noted)
    source = chromosome_membership(ds.processed)
    once = L.grouped_once(source, ds.genes, loci, P.LocusFilters(), None, B.DEFAULT_BIN)
    keyed, groups = plans[-2:]
    assert "Aggregate" not in keyed
    assert "SortAggregate" not in groups and groups.count("Expand") == 1 and "partial_min(row_key" in groups
    for name, df in once.items():
        assert "SortAggregate" not in _plan(df), name
    assert "SortAggregate" not in _plan(K.id_table(ds.processed))


def test_windows_are_copied_a_bounded_number_of_times(spark, loci):
    for bin_size in (B.MIN_BIN, B.DEFAULT_BIN, B.MAX_BIN):
        copies = B.window_bins(loci, bin_size).groupBy("locus_id").count().agg(F.max("count")).first()[0]
        assert copies <= B.SPAN + 1
    longest = spark.createDataFrame([("x", "1", 0, 2 ** 54)], "locus_id string, chrom string, start bigint, end bigint")
    assert B.window_bins(longest, B.MIN_BIN).count() <= B.SPAN + 1


@pytest.mark.parametrize("bin_size", [10_000, None])
def test_window_join_against_the_plain_predicate(ds, loci, bin_size):
    rows = B.batch_locus_rows(ds.processed, loci, bin_size)
    assert set(rows.columns) == {"locus_id", "chrom", *ds.processed.columns}
    got = rows.groupBy("locus_id").agg(F.count(F.lit(1)).alias("n"))
    member = chromosome_membership(ds.processed).where(P.resolved()).toPandas()
    want = {}
    for r in loci.collect():
        own = member[member.chrom == r.chrom]
        inside = sum(own[p].between(r.start, r.end).astype(int) for p in P.POSITIONS) > 0
        if inside.any():
            want[r.locus_id] = int(inside.sum())
    assert {r.locus_id: r.n for r in got.collect()} == want and "all of 7" in want and "far too long" in want


def test_the_source_is_read_once(spark, ds, tmp_path):
    ds.processed.write.parquet(str(tmp_path / "processed"))
    stored = spark.read.parquet(str(tmp_path / "processed"))
    windows = spark.createDataFrame([("w", "7", 0, 9)], "locus_id string, chrom string, start bigint, end bigint")
    assert _plan(B.batch_locus_rows(stored, windows)).count("FileScan parquet") == 1
