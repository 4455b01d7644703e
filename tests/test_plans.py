"""Physical-plan properties the scale design relies on."""

import uuid

from pyspark.sql import functions as F

from locusforge import fixtures as FX
from locusforge import schemas as S
from locusforge.operators import batch_locus as B
from locusforge.operators import locus as L
from locusforge.operators import lookup as K
from locusforge.operators import tables as TB
from locusforge.operators.filters import transform_predicate
from locusforge.operators.processed import build_processed
from locusforge.plans.transform import transform
from locusforge.session import scratch_path
from locusforge.sources import sinks


def _plan(df) -> str:
    # scan metadata (pushed filters, read schema) is truncated at 100 chars by default
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_transform_filters_reach_the_scan(spark, ds):
    path = scratch_path(spark, "plan-ev")
    ds.evidence.write.parquet(path)
    plan = _plan(spark.read.parquet(path).where(transform_predicate()).select("idx"))
    assert "PushedFilters: [IsNotNull(gwas_source)" in plan
    assert "EqualTo(gwas_source,GWAS Catalog)" in plan
    assert "In(GRCh38_chrom" in plan
    # column pruning: the tissue columns are not read for this projection
    assert "GTEx_t00" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_layout_window_prunes_partitions(spark, ds):
    path = sinks.write_by_chromosome(ds.processed, scratch_path(spark, "plan-layout"))
    layout = sinks.read_by_chromosome(spark, path)
    plan = _plan(L.window_rows(layout, "7", 3000000, 12000000))
    assert "PartitionFilters: [isnotnull(chrom" in plan and "(chrom#" in plan and "= 7)" in plan
    assert "GreaterThanOrEqual(GRCh38_pos,3000000)" in plan
    assert "LessThanOrEqual(first_pos,12000000)" in plan and "GreaterThanOrEqual(last_pos,3000000)" in plan


def _scanned(df) -> int:
    """Rows that the scan hands on when ``df`` runs, after row groups and pages were skipped."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_far_lead_variants_do_not_spoil_row_groups(spark, processed_rows):
    """Every hundredth row has its lead variant far away; the others are skipped by their envelope."""
    n = F.col("id")
    rows = processed_rows({}).drop("idx", "GRCh38_pos", "GRCh38_gene_start", "GRCh38_gene_end", S.LEAD_POS)
    at = n * 1000
    rows = spark.range(100_000).crossJoin(F.broadcast(rows)).select(
        n.alias("idx"), at.alias("GRCh38_pos"), (at - 500).alias(S.GENE_START), (at + 500).alias(S.GENE_END),
        F.when(n % 100 == 0, (at + 50_000_000) % 100_000_000).otherwise(at + 200).alias(S.LEAD_POS), *rows.columns)
    layout = sinks.read_by_chromosome(spark, sinks.write_by_chromosome(rows, scratch_path(spark, "spans"), 8))
    by_position = scratch_path(spark, "by-position")
    (layout.drop(S.FIRST_POS, S.LAST_POS).repartitionByRange(8, "GRCh38_pos").sortWithinPartitions("GRCh38_pos")
     .write.partitionBy("chrom").parquet(by_position))
    before = sinks.read_by_chromosome(spark, by_position)
    for start, end in ((30_000_000, 31_000_000), (0, 10), (99_999_000, 10 ** 9), (200_000_000, 300_000_000)):
        found = [sorted(r.idx for r in L.window_rows(t, "7", start, end).select("idx").collect())
                 for t in (layout, before, rows)]
        assert found[0] == found[1] == found[2]
    now, then = (_scanned(L.window_rows(t, "7", 30_000_000, 31_000_000).select("idx")) for t in (layout, before))
    print(f"rows scanned: {now} with envelopes, {then} by position")
    assert 2 * now < then


def test_unknown_positions_in_the_envelope(spark, processed_rows):
    rows = processed_rows({"idx": 1, "GRCh38_pos": None}, {"idx": 2, S.LEAD_POS: None},
                          {"idx": 3, "GRCh38_pos": None, S.GENE_START: None, S.GENE_END: None, S.LEAD_POS: None})
    layout = sinks.read_by_chromosome(spark, sinks.write_by_chromosome(rows, scratch_path(spark, "unknown")))
    got = {r.idx: (r.first_pos, r.last_pos) for r in layout.collect()}
    assert got == {1: (4000, 6000), 2: (4000, 6000), 3: (None, None)}
    assert [r.idx for r in L.window_rows(layout, "7", 5200, 5200).collect()] == [1]


def test_representative_rows_aggregate_before_the_shuffle(ds):
    plan = _plan(L.variant_vertices(ds.processed))
    assert "partial_min(struct(" in plan
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning")


def test_no_broadcast_hint_on_growing_tables(ds):
    for df in (ds.processed, L.locus(ds.processed, ds.genes, L.Locus("7", 1, 2))["genes"]):
        assert "strategy=broadcast" not in df._jdf.queryExecution().analyzed().toString()


def _jobs_while(spark, build) -> int:
    """Jobs that ``build`` starts, counted by the status tracker under a group of its own."""
    group = f"plan-building-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "no job expected")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_building_plans_runs_no_job(spark, ds):
    processed = spark.read.parquet(sinks.write_processed(ds.processed, scratch_path(spark, "plan-processed")))
    genes, loci = ds.genes, B.loci_around_genes(ds.gene_dim, 100_000)
    raw, dim, leads, evidence = ds.raw, ds.gene_dim, ds.lead_variant, ds.evidence  # reads the footers
    assert _jobs_while(spark, lambda: spark.range(9).count()) >= 1
    assert _jobs_while(spark, lambda: (
        L.locus(processed, genes, L.Locus("7", 1, 10 ** 9)), L.locus_batch(processed, genes, loci),
        K.search_batch(processed, evidence.selectExpr("gwas_snp AS query")), K.id_table(processed),
        K.variant_location(processed, "rs1"), build_processed(raw, dim, leads))) == 0


def test_single_lookups_push_the_id(spark, ds):
    ids = spark.read.parquet(sinks.write_id_table(ds.ids, scratch_path(spark, "plan-ids")))
    for df in (K.variant_location(ids, "rs342"), K.search(ids, "rs342")):
        assert "EqualTo(id,rs342)" in _plan(df)
    processed = spark.read.parquet(sinks.write_processed(ds.processed, scratch_path(spark, "plan-processed")))
    assert "EqualTo(gwas_snp,rs1)" in _plan(K.variant_location(processed, "rs1"))
    path = scratch_path(spark, "plan-genes")
    ds.genes.write.parquet(path)
    assert "EqualTo(gene_id,ENSG137)" in _plan(K.gene_location(spark.read.parquet(path), "ENSG137"))


def test_transform_code_size(spark, ds):
    """Term list, tissue array and maximum are columns of their own, not expanded where they are used."""
    path = scratch_path(spark, "plan-codegen")
    ds.evidence.write.parquet(path)
    df = transform(spark.read.parquet(path), tissues=FX.FIXTURE_TISSUES)
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 10_000


def test_offset_without_limit_stays_distributed(ds):
    plan = _plan(TB.page(ds.processed, 5, None))
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan


def test_binned_locus_join_is_an_equi_join(ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    plan = _plan(B.batch_locus_rows(ds.membership, loci))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "_bin" in plan and "_lbin" in plan


def test_no_python_udfs_in_transform(ds):
    plan = _plan(ds.raw)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_keyset_pages_come_from_one_window(ds):
    """The second page does not join the evidence again."""
    from locusforge.plans import catalog
    page = catalog.queries()["keyset_page"](ds.spark, ds.sf_dir)
    assert "lineitem" not in page._jdf.queryExecution().optimizedPlan().toString()
    assert [r["index"] for r in page.collect()] == [r["index"] for r in TB.page(
        L.window_rows(ds.processed, catalog.CHROM, catalog.START, catalog.END), catalog.PAGE_OFFSET, catalog.PAGE_LIMIT).collect()]
