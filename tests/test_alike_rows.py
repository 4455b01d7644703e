"""Rows that agree in keys and places are told apart before they are copied to cells, and lists are shuffled once."""

import re

import pytest

from locusforge.operators import batch_locus as B
from locusforge.operators import locus as L
from locusforge.operators import predicates as P

LOCI = "locus_id string, chrom string, start bigint, end bigint"
OUTPUTS = ["genes", "leadVariants", "geneVariants"]


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture
def alike(processed_rows):
    """Forty rows of two lead variants at four variant places, some without a gene or variant chromosome; four rows under one idx."""
    return processed_rows(
        *[dict(idx=50 - i, gwas_snp=f"rs{i % 2}", GRCh38_pos=1_000_000 + 500_000 * (i % 4), gene_symbol=f"S{i}", score=i / 100,
               gene_id=None if i % 10 == 7 else "ENSG1", GRCh38_chrom="X" if i % 10 == 3 else "7") for i in range(40)],
        *[dict(idx=5, gwas_snp="rs0", GRCh38_pos=1_000_000, gene_symbol=s) for s in ("b", "a", "c", "a")])


def test_one_of_alike_rows_is_left_and_it_is_the_first(alike):
    rows = B._member_rows(L.ranked_rows(L.one_copy(alike)))
    left = B.first_alike(rows, ["gene_id"], [*L.ORDER, "gene_symbol"])
    places = ["chrom", "gwas_snp", "gene_id", *P.POSITIONS]
    assert left.count() == rows.select(*places).distinct().count() < rows.count()
    least = rows.groupBy(*places).agg({"idx": "min"})
    assert _rows(left.select(*places, "idx")) == _rows(least)


@pytest.mark.parametrize("name", OUTPUTS)
def test_outputs_of_alike_rows_are_those_of_all_rows(spark, alike, genes_lookup, name):
    loci = spark.createDataFrame([(f"{c}{s}+{n}", c, s, s + n) for c in ("7", "X") for s in (0, 900_000, 1_499_000, 2_400_000)
                                  for n in (5_000, 200_000, 1_500_000, B.LONGEST)], LOCI)
    filters = P.LocusFilters(score=(0.05, 0.9))
    alone = L.locus_batch(alike, genes_lookup("ENSG1"), loci, filters, materialize=True, outputs=[name])[name]
    every = L.locus_batch(alike, genes_lookup("ENSG1"), loci, filters, materialize=True)[name]
    assert _rows(alone) == _rows(every) != []


def test_lead_variants_carry_no_hash_of_the_rest(ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    made = L.locus_batch(ds.ranked_membership, ds.genes, loci, materialize=True, outputs=["leadVariants"])["leadVariants"]
    assert "xxhash64" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_genes_are_shuffled_once(spark, ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        made = L.locus_batch(ds.ranked_membership, ds.genes, loci, materialize=True, outputs=["genes"])["genes"]
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert not re.search(r"hashpartitioning\(_k0#", plan)
