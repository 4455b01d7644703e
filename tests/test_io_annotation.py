import gzip
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from locusforge.operators import annotation as A
from locusforge.session import scratch_path
from locusforge.sources import evidence as R
from locusforge.sources import sinks


def test_absent_column_and_malformed_value_fail(spark):
    d = tempfile.mkdtemp(prefix="lf-tsv-")
    path = os.path.join(d, "ev.tsv")
    with open(path, "w") as f:
        f.write("GRCh38_pos\tscore\n463.0\t0.5\n1.2E7\tNA\n")
    with pytest.raises(ValueError, match="gwas_source"):
        R.read_evidence(spark, path, tissues=[])
    rows = R.read_evidence(spark, path, tissues=["GTEx_absent"], columns=["GRCh38_pos", "score"]).collect()
    assert [(r.GRCh38_pos, r.score, r.GTEx_absent) for r in rows] == [(463, 0.5, None), (12000000, None, None)]
    for bad in ("abc\t1", "463.5\t1", "1\txyz"):
        with open(path, "w") as f:
            f.write(f"GRCh38_pos\tscore\n{bad}\n")
        with pytest.raises(Exception, match="abc|463.5|xyz"):
            R.read_evidence(spark, path, tissues=[], columns=["GRCh38_pos", "score"]).collect()
        got = R.read_evidence(spark, path, tissues=[], columns=["GRCh38_pos", "score"], malformed="null").first()
        assert None in (got.GRCh38_pos, got.score)


def test_rows_in_file_order(spark):
    """Files of very different size: the index follows their names, not Spark's packing."""
    d, n = tempfile.mkdtemp(prefix="lf-order-"), 0
    for k, size in enumerate((3, 500, 1, 90)):
        with open(os.path.join(d, f"part-{k}.tsv"), "w") as f:
            f.write("score\n" + "".join(f"{n + i}\n" for i in range(size)))
        n += size
    rows = R.read_evidence(spark, d, tissues=[], columns=["score"], add_index=True).collect()
    assert sorted((r.idx, r.score) for r in rows) == [(i, float(i)) for i in range(n)]
    first = R.read_evidence(spark, d, tissues=[], columns=["score"], nrows=7).collect()
    assert [r.score for r in first] == list(range(7)) and first[0].asDict().keys() == {"score"}


def test_read_evidence_tsv_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="lf-tsv-")
    path = os.path.join(d, "ev.tsv.gz")
    header = ["", "ld_snp_rsID", "GRCh38_pos", "gwas_pvalue", "vep_terms", "extra_col", "GTEx_x"]
    lines = ["\t".join(header),
             "\t".join(["0", "rs1", "100", "1e-8", "None", "zzz", "NaN"]),
             "\t".join(["1", "NA", "", "nan", "missense_variant", "zzz", "0.5"]),
             "\t".join(["2", "rs3", "abc", "NULL", "", "zzz", "1"])]
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    df = R.read_evidence(spark, path, tissues=["GTEx_x"], key_column="_c0", malformed="null",
                         columns=["ld_snp_rsID", "GRCh38_pos", "gwas_pvalue", "vep_terms"])
    rows = df.orderBy("idx").collect()
    assert [r.ld_snp_rsID for r in rows] == ["rs1", None, "rs3"]
    assert [r.GRCh38_pos for r in rows] == [100, None, None]      # "abc" -> NULL on demand
    assert [r.gwas_pvalue for r in rows] == [1e-8, None, None]
    assert [r.vep_terms for r in rows] == [None, "missense_variant", None]
    assert [r.GTEx_x for r in rows] == [None, 0.5, 1.0]
    assert "extra_col" not in df.columns


def test_terms_tsv_and_join_form(spark):
    d = tempfile.mkdtemp(prefix="lf-terms-")
    path = os.path.join(d, "terms.tsv")
    with open(path, "w") as f:
        f.write("url\tterm\tvalue\nu1\tmissense_variant\t0.7\nu2\tstop_gained\t0.95\nu3\tNone\t1.\n")
    terms = R.read_terms(spark, path)
    assert terms.where("term IS NULL").count() == 1
    pairs = [("missense_variant", 0.7), ("stop_gained", 0.95)]
    ev = spark.createDataFrame([(1, "stop_gained,x"), (2, "missense_variant"), (3, None)],
                               "idx bigint, vep_terms string")
    from locusforge.functions.scores import ot_vep
    lit_form = {r.idx: r.v for r in ev.select("idx", ot_vep("vep_terms", pairs).alias("v")).collect()}
    join_form = {r.idx: r.ot_vep for r in R.ot_vep_by_join(ev, terms).collect()}
    assert lit_form == join_form == {1: 0.95, 2: 0.7, 3: 0.0}


def test_row_index_dense(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 3).alias("v"))
    out = R.with_row_index(df).collect()
    assert sorted(r.idx for r in out) == list(range(1000))
    assert all(r.v == r.idx * 3 for r in out)


def test_sample_rows_is_key_ordered(ds):
    got = [r.idx for r in R.sample_rows(ds.evidence, 5).collect()]
    assert got == sorted(got) and len(got) == 5


def test_layout_equals_membership_predicate(spark, ds):
    path = sinks.write_by_chromosome(ds.processed, scratch_path(spark, "t-layout"))
    layout = sinks.read_by_chromosome(spark, path)
    assert dict((f.name, f.dataType.simpleString()) for f in layout.schema.fields)["chrom"] == "string"
    from locusforge.operators.processed import chromosome_table
    for c in ["7", "X", "1"]:
        a = sorted(r.idx for r in chromosome_table(layout, c).select("idx").collect())
        b = sorted(r.idx for r in chromosome_table(ds.processed, c).select("idx").collect())
        assert a == b
    # one copy per table: rows belong to at most 3 tables
    per_row = layout.groupBy("idx", "GRCh38_gwas_snp_pos").count().agg(F.max("count")).first()[0]
    assert per_row <= 3


def test_gene_lookup_json_roundtrip(spark, ds):
    path = sinks.write_gene_lookup(ds.genes, scratch_path(spark, "t-genes"))
    back = sinks.read_gene_lookup(spark, path)
    a = {r.gene_id: (r.tss, list(map(tuple, r.exons))) for r in ds.genes.collect()}
    b = {r.gene_id: (r.tss, list(map(tuple, r.exons))) for r in back.collect()}
    assert a == b


def test_gene_rollup_drops_null_keys(spark):
    rows = spark.createDataFrame(
        [("G1", "d", "7", 10, 20, True, 15, 1, 11, 12), ("G1", "d", "7", 10, 20, True, 15, 2, 13, 14),
         ("G2", None, "7", 10, 20, True, 15, 3, 11, 12)],
        "gene_id string, description string, chr string, gene_start bigint, gene_end bigint, "
        "fwdstrand boolean, tss bigint, exon_id bigint, exon_start bigint, exon_end bigint")
    out = A.gene_rollup(rows).collect()
    assert [(r.gene_id, [tuple(e) for e in r.exons]) for r in out] == [("G1", [(11, 12), (13, 14)])]
    assert A.gene_rollup(rows, drop_null_keys=False).count() == 2


def test_primary_regions_case_insensitive(spark):
    sr = spark.createDataFrame([(1, "7", 4), (2, "CHR_HSCHR7_1", 4), (3, "chr_patch", 4), (4, "8", 2)],
                               "seq_region_id int, name string, coord_system_id int")
    assert [r.chr for r in A.primary_regions(sr).collect()] == ["7"]


def test_built_dimensions(ds):
    genes = ds.built_genes()
    # patches (p%37==0) and genes without description (p%31==0) are gone
    ids = {r.gene_id for r in genes.select("gene_id").collect()}
    assert "ENSG37" not in ids and "ENSG31" not in ids and "ENSG1" in ids
    leads = ds.built_lead_variants()
    assert leads.where("gwas_snp = 'rs34'").count() == 0          # 34 % 17 == 0: no mapping
    assert A.unresolved_lead_variants(ds.raw, leads).count() > 0
