"""Deep pages by the rank index, rows numbered while they are written, heavy keys split on purpose."""

import os

import pytest
from pyspark.sql import functions as F

from locusforge.api import EvidenceAPI
from locusforge.operators import ranks as RK
from locusforge.operators import tables as TB
from locusforge.operators.processed import build_processed, heavy_keys
from locusforge.plans.transform import transform
from locusforge.session import scratch_path
from locusforge.sources import evidence as E
from locusforge.sources import sinks


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def deep(spark):
    """1,200,000 rows of one disease in many files, each index twice, beside a small disease and rows without one."""
    from processed_ddl import PROCESSED_DDL
    base = spark.createDataFrame([], PROCESSED_DDL)
    ids = spark.range(1_200_000).select(
        F.when(F.col("id") >= 10, (F.col("id") / 2).cast("long")).alias("idx"),
        F.col("id").alias("GRCh38_gwas_snp_pos"), F.col("id").alias("GRCh38_pos"),
        F.when(F.col("id") % 1000 == 7, "EFO_2").when(F.col("id") % 1000 == 8, None).otherwise("EFO_1").alias("disease_efo_id"))
    rows = ids.select(*[F.col(f.name) if f.name in ids.columns else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in base.schema.fields])
    path = scratch_path(spark, "deep")
    (rows.repartitionByRange(24, *sinks.PROCESSED_KEYS).sortWithinPartitions(*sinks.PROCESSED_KEYS)
     .write.option("maxRecordsPerFile", 30_001).parquet(path))
    index = RK.write_rank_index(RK.rank_index(spark.read.parquet(path), 10_000), scratch_path(spark, "ranks"))
    return path, spark.read.parquet(index)


@pytest.mark.parametrize("offset, limit", [(0, 3), (7, 20), (29_995, 40), (1_000_000, 50), (1_197_590, 50), (5_000_000, 5),
                                           (12, 0)])
def test_a_page_at_any_depth_equals_the_sorted_table(spark, deep, offset, limit):
    path, index = deep
    # By the rule of the rows; a plain sort at this depth keeps a million whole rows in one task.
    order = [i for i in range(1_200_000) if i % 1000 not in (7, 8)][offset:offset + limit]
    got = RK.disease_page(index, path, "EFO_1", offset, limit).select("index", "vPos", "efoId")
    assert _rows(got) == [(i // 2 if i >= 10 else None, i, "EFO_1") for i in order]


def test_a_deep_page_reads_the_files_of_one_page(spark, deep):
    path, index = deep
    files = len(spark.read.parquet(path).inputFiles())
    assert files > 30
    assert len(RK.disease_page(index, path, "EFO_1", 1_000_000, 50).inputFiles()) <= 2
    assert len(TB.page(spark.read.parquet(path), 1_000_000, 50).inputFiles()) == files


def test_totals_come_from_the_index(spark, deep):
    path, index = deep
    for disease in ("EFO_1", "EFO_2", "none such"):
        want = spark.read.parquet(path).where(F.col("disease_efo_id") == disease).count()
        assert RK.disease_total(index, disease).first().total == want


def test_files_in_any_order_give_the_same_pages(spark, deep):
    """Rows hashed over files: the ranges of all files meet."""
    path, _ = deep
    mixed = scratch_path(spark, "mixed")
    spark.read.parquet(path).where("idx < 20000 OR idx IS NULL").repartition(5, "GRCh38_gwas_snp_pos").write.parquet(mixed)
    index = RK.rank_index(spark.read.parquet(mixed), 1000)
    rows = spark.read.parquet(mixed).where("disease_efo_id = 'EFO_1'")
    for offset in (0, 5, 12_990):
        assert _rows(RK.disease_page(index, mixed, "EFO_1", offset, 30)) == _rows(TB.page(rows, offset, 30))


def test_an_empty_table_has_empty_pages(spark, deep):
    path, _ = deep
    none = scratch_path(spark, "none")
    spark.read.parquet(path).where("false").write.parquet(none)
    index = RK.rank_index(spark.read.parquet(none))
    assert _rows(RK.disease_page(index, none, "EFO_1", 0, 10)) == []
    assert RK.disease_total(index, "EFO_1").first().total == 0


def test_the_api_pages_by_rank(spark, ds):
    path = sinks.write_processed(ds.processed, scratch_path(spark, "processed"))
    ranks = RK.rank_index(spark.read.parquet(path))
    plain = EvidenceAPI(ds.processed, ds.processed, ds.genes, ds.ids)
    api = EvidenceAPI(ds.processed, spark.read.parquet(path), ds.genes, ds.ids, ranks, path)
    for args in (dict(offset=3, limit=7), dict(limit=5, sort=("-gwasPValue",)), dict(offset=4), dict(limit=2, after=())):
        got, want = api.diseaseTable("EFO_7", **args), plain.diseaseTable("EFO_7", **args)
        assert _rows(got["rows"]) == _rows(want["rows"])
        assert _rows(got["total"]) == _rows(want["total"])


# --- numbering while writing ------------------------------------------------
def _numbered(spark, folder, tissues=()):
    rows = E.read_evidence(spark, folder, list(tissues), add_places=True)
    path = E.write_numbered(transform(rows, list(tissues), also=(E.FILE, E.BLOCK)), scratch_path(spark, "numbered"),
                            scratch_path(spark, "scanned"))
    return E.read_transformed(spark, path)


@pytest.mark.parametrize("packed, cost", [("64k", "0"), ("128m", "4m")])
def test_rows_are_numbered_as_they_stand_in_the_files(spark, ds, packed, cost):
    folder = scratch_path(spark, "evidence")
    (ds.evidence.repartitionByRange(5, "idx").sortWithinPartitions("idx").drop("idx")
     .write.option("sep", "\t").option("header", True).csv(folder))
    settings = {"spark.sql.files.maxPartitionBytes": packed, "spark.sql.files.openCostInBytes": cost}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = _numbered(spark, folder)
        columns = ["idx", "gene_id", "ld_snp_rsID", "gwas_snp", "disease_efo_id", "score"]
        want = E.with_file_row_index(E.read_delimited(spark, folder), "_row")
        want = transform(E.typed_evidence(want, [], key_column="_row"), [])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(i, *r[1:]) for i, r in enumerate(_rows(want.select(*columns).orderBy("idx")))]
    assert _rows(got.select(*columns).orderBy("idx")) == want and want
    # The tables are built from stored rows; the text is not parsed again.
    assert all(name.endswith(".parquet") for name in got.inputFiles())
    assert set(got.columns).isdisjoint({E.FILE, E.BLOCK, E.PLACE})


def test_nothing_kept_is_an_empty_table(spark, ds):
    folder = scratch_path(spark, "evidence")
    ds.evidence.drop("idx").limit(3).withColumn("gwas_source", F.lit("elsewhere")).write.option("sep", "\t").option(
        "header", True).csv(folder)
    got = _numbered(spark, folder)
    assert got.columns[0] == "idx" and _rows(got) == []


def test_places_need_the_rows_as_scanned(spark):
    with pytest.raises(ValueError, match="scanned"):
        E.read_evidence(spark, "nowhere", [], add_places=True, num_partitions=4)


# --- heavy keys -------------------------------------------------------------
@pytest.fixture
def planted(spark, ds):
    """A third of the rows under one lead variant with three mappings; some rows have none."""
    many = ds.raw.crossJoin(spark.range(6).withColumnRenamed("id", "copy"))
    raw = (many.withColumn("idx", F.col("idx") * 6 + F.col("copy")).drop("copy")
           .withColumn("gwas_snp", F.when(F.col("idx") % 3 == 0, "rsHOT").when(F.col("idx") % 97 == 0, None)
                       .otherwise(F.col("gwas_snp"))))
    hot = spark.createDataFrame([("rsHOT", "7", p) for p in (1, 2, 3)],
                                "gwas_snp string, seq_region_name string, position long")
    return raw, ds.lead_variant.select("gwas_snp", "seq_region_name", "position").unionByName(hot)


def _largest_part(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_heavy_keys_are_found_with_their_parts(spark, planted):
    raw, _ = planted
    n = raw.count()
    heavy = heavy_keys(raw, "gwas_snp", 64)
    assert set(heavy) >= {"rsHOT"} and 20 <= heavy["rsHOT"] <= 24
    counts = {r[0]: r[1] for r in raw.groupBy("gwas_snp").count().collect()}
    assert all(counts[k] * 64 >= 4 * n for k in heavy)
    assert heavy_keys(raw.where("false"), "gwas_snp", 64) == {}
    assert heavy_keys(raw.withColumn("gwas_snp", F.lit(None).cast("string")), "gwas_snp", 64) == {}


def test_a_hot_lead_variant_is_spread_without_aqe(spark, planted, ds):
    raw, leads = planted
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plain = build_processed(raw, ds.gene_dim, leads)
        split = build_processed(raw, ds.gene_dim, leads, heavy_keys(raw, "gwas_snp"))
        assert split.columns == plain.columns
        key = ["idx", "GRCh38_gwas_snp_chrom", "GRCh38_gwas_snp_pos", "gene_id", "GRCh38_gene_start"]
        rows = [sorted(map(str, df.select(*key).collect())) for df in (plain, split)]
        assert rows[0] == rows[1]
        n = len(rows[0])
        assert _largest_part(plain) > n / 3
        assert _largest_part(split) < n / 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_written_table_is_whole(spark, planted, ds):
    raw, leads = planted
    path = sinks.write_joined(raw, ds.gene_dim, leads, scratch_path(spark, "joined"), 32)
    assert os.path.isdir(path)
    want = build_processed(raw, ds.gene_dim, leads)
    got = spark.read.parquet(path)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
