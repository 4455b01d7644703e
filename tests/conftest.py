from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from processed_ddl import PROCESSED_DDL  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from locusforge.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="locusforge-test-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ds(spark):
    from locusforge.plans.build import Dataset
    return Dataset(spark, SF0001)

DEFAULT_ROW = dict(
    idx=1, ld_snp_rsID="rs1", GRCh38_chrom="7", GRCh38_pos=5000, gene_symbol="G1", gene_id="ENSG1",
    GRCh38_gene_chrom="7", GRCh38_gene_pos=5100, disease_name="d1", disease_efo_id="EFO_1", score=0.5,
    r2=0.8, gwas_source="GWAS Catalog", gwas_snp="rs9", gwas_pvalue=1e-8, gwas_odds_ratio=None,
    gwas_beta=0.1, gwas_size=1000, gwas_pmid="PMID1", gwas_study="GCST1", vep_terms="intron_variant",
    GTEx=0.5, VEP=0.0, Fantom5=0.0, DHS=0.0, PCHiC=0.0, Nearest=1.0, Regulome=0.0, ot_vep=0.65,
    gtex_max_tissue="t", gtex_max_value=0.5, GRCh38_gene_start=4000, GRCh38_gene_end=6000,
    GRCh38_gwas_snp_chrom="7", GRCh38_gwas_snp_pos=5200,
)


@pytest.fixture
def processed_rows(spark):
    def make(*overrides):
        rows = []
        for o in overrides:
            r = dict(DEFAULT_ROW)
            r.update(o)
            rows.append(r)
        names = [c.split()[0] for c in PROCESSED_DDL.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PROCESSED_DDL)
    return make


@pytest.fixture
def genes_lookup(spark):
    def make(*genes):
        return spark.createDataFrame(
            [(g, "desc", 4000, "7", 4000, 6000, True, [(4000, 4100)]) for g in genes],
            "gene_id string, description string, tss bigint, chr string, gene_start bigint, "
            "gene_end bigint, fwdstrand boolean, exons array<struct<start:bigint,end:bigint>>")
    return make
