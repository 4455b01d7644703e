"""Registered queries and their oracle SQL, with the shared parameters.

``queries()`` maps a name to a (spark, sf_dir) -> DataFrame callable that
reads the whole test tables through ``Dataset``; ``oracle_sql()`` maps the
same names to DuckDB SQL from ``plans.oracle``. Computed columns carry the
same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge import fixtures as FX
from locusforge import schemas as S
from locusforge.api import EvidenceAPI
from locusforge.functions import nested, scores
from locusforge.operators import annotation as A
from locusforge.operators import batch_locus as B
from locusforge.operators import filters as T
from locusforge.operators import locus as L
from locusforge.operators import lookup as K
from locusforge.operators import predicates as P
from locusforge.operators import ranks as RK
from locusforge.operators import tables as TB
from locusforge.operators.processed import build_processed, heavy_keys
from locusforge.plans import oracle as O
from locusforge.plans.build import Dataset, build_from_file
from locusforge.plans.transform import transform as T_transform
from locusforge.session import scratch_path
from locusforge.sources import evidence as R
from locusforge.sources import sinks as K_

Query = Callable[[SparkSession, str], DataFrame]

# Query parameters shared by the Spark side and the oracle side.
CHROM, START, END = FX.DEFAULT_LOCUS
MUST_HAVES = ("VEP", "nearest")
SCORE = (0.2, 0.6)
R2 = (0.7, 0.9)
PVALUE = (7.5, 8.5)
SEL_GENE = "ENSG137"
SEL_DISEASE = "EFO_7"
SEL_GENE_VARIANT = "ENSG85-rs342"
SEL_LEAD_DISEASE = "rs171-EFO_27"
SEL_VARIANT, SEL_LEAD, SEL_VARIANT_LEAD = "rs342", "rs171", "rs342-rs171"
PAGE_OFFSET, PAGE_LIMIT = 10, 25
GENE_ID = "ENSG137"
VARIANT_ID = "rs342"
LEAD_ONLY_ID = "rs100"
BOTH_ID = "rs1000"
GENE_FLANK = 100_000
BIN_SIZE = 1_000_000
# Tasks that processed_split deals for: many, so that keys of the small tables are heavy.
HEAVY_PARTITIONS = 4000


def exons_text(c: Column) -> Column:
    """Exon list as 'start-end;start-end' (sorted), for value comparison."""
    return F.array_join(F.transform(c, lambda e: F.concat(e["start"].cast("string"), F.lit("-"),
                                                          e["end"].cast("string"))), ";")


def _ds(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(spark, sf_dir)


def _filter_query(pred: Callable[[], Column], cols: list[str]) -> Query:
    return lambda spark, sf: _ds(spark, sf).evidence.where(pred()).select("idx", *cols)


def _locus_child(child: str, **kw) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ds = _ds(spark, sf)
        req = L.Locus(CHROM, START, END,
                      P.LocusFilters(kw.get("must_haves", ()), kw.get("score"), kw.get("r2"),
                                     kw.get("pvalue")),
                      kw.get("sel_id"), kw.get("sel_type"))
        out = L.locus(ds.processed, ds.genes, req)[child]
        return out.withColumn("exons", exons_text(F.col("exons"))) if child == "genes" else out
    return run


def _edge_kw() -> dict:
    return dict(score=SCORE, pvalue=PVALUE)


def _all_filters_kw() -> dict:
    return dict(must_haves=MUST_HAVES, score=SCORE, r2=R2, pvalue=PVALUE)


def _window_pred_query(pred: Callable[[], Column | None]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = L.window_rows(_ds(spark, sf).processed, CHROM, START, END)
        p = pred()
        return (rows.where(p) if p is not None else rows).select(
            "idx", "gene_id", "ld_snp_rsID", "gwas_snp", "disease_efo_id", S.LEAD_CHROM, S.LEAD_POS)
    return run


WINDOW_COLS_SQL = f"idx, gene_id, ld_snp_rsID, gwas_snp, disease_efo_id, {S.LEAD_CHROM}, {S.LEAD_POS}"


def _window_pred_sql(cond: str | None) -> str:
    return O.with_ctes(["processed"], [("u", O.window_sql(CHROM, START, END))],
                       f"SELECT {WINDOW_COLS_SQL} FROM u" + (f" WHERE {cond}" if cond else ""))


# ---------------------------------------------------------------------------
# Spark callables
# ---------------------------------------------------------------------------
def _transform_full(spark, sf):
    return _ds(spark, sf).raw


def _ot_vep(spark, sf):
    return _ds(spark, sf).evidence.select("idx", "vep_terms", scores.ot_vep("vep_terms").alias("ot_vep"))


def _gtex_max(spark, sf):
    return _ds(spark, sf).evidence.select(
        "idx", scores.gtex_max_tissue(FX.FIXTURE_TISSUES).alias("gtex_max_tissue"),
        scores.gtex_max_value(FX.FIXTURE_TISSUES).alias("gtex_max_value"))


def _g2v(spark, sf):
    return scores.with_g2v_score(_ds(spark, sf).evidence).select("idx", "ot_g2v_score",
                                                                 "ot_g2v_score_reason")


def _g2v_nonzero(spark, sf):
    return scores.with_g2v_score(_ds(spark, sf).evidence, drop_zero=True).select(
        "idx", "ot_g2v_score", "ot_g2v_score_reason")


def _gene_dim(spark, sf):
    return _ds(spark, sf).built_genes().withColumn("exons", exons_text(F.col("exons")))


def _genes_per_chrom(spark, sf):
    return A.genes_per_chromosome(_ds(spark, sf).built_genes())


def _canonical_exons(spark, sf):
    s, d = spark, sf
    return A.canonical_exons(FX.ens_exon_transcript(s, d), FX.ens_exon(s, d), FX.ens_gene(s, d),
                             FX.ens_transcript(s, d), FX.ens_seq_region(s, d))


def _lead_variants(spark, sf):
    return _ds(spark, sf).built_lead_variants()


def _variants_semi(spark, sf):
    return A.variants_in_evidence(FX.variation(spark, sf), _ds(spark, sf).raw)


def _distinct_leads(spark, sf):
    return A.distinct_lead_variants(_ds(spark, sf).raw)


def _processed(spark, sf):
    return _ds(spark, sf).processed


def _membership(spark, sf):
    return _ds(spark, sf).membership.select("idx", "chrom", S.LEAD_CHROM, S.LEAD_POS)


def _unresolved_genes(spark, sf):
    ds = _ds(spark, sf)
    return A.unresolved_genes(ds.raw, ds.gene_dim)


def _unresolved_leads(spark, sf):
    ds = _ds(spark, sf)
    return A.unresolved_lead_variants(ds.raw, ds.lead_variant)


def _locus_table(kind: str, **kw) -> Query:
    def run(spark, sf):
        ds = _ds(spark, sf)
        filters = P.LocusFilters(kw.get("must_haves", ()), kw.get("score"), kw.get("r2"), kw.get("pvalue"))
        pg, tot = TB.locus_table(ds.processed, CHROM, START, END, filters, kw.get("sel_id"),
                                 kw.get("sel_type"), kw.get("offset", 0), kw.get("limit"), kw.get("sort", ()))
        return tot if kind == "total" else pg
    return run


def _disease_table(kind: str, offset=0, limit=None, sort=()) -> Query:
    def run(spark, sf):
        pg, tot = TB.disease_table(_ds(spark, sf).processed, SEL_DISEASE, offset, limit, sort)
        return tot if kind == "total" else pg
    return run


def _ranked(kind: str) -> Query:
    """O2 and A4 by the rank index of the stored processed table."""
    def run(spark, sf):
        path = K_.write_processed(_ds(spark, sf).processed, scratch_path(spark, "processed"))
        index = spark.read.parquet(RK.write_rank_index(RK.rank_index(spark.read.parquet(path)),
                                                       scratch_path(spark, "ranks")))
        return (RK.disease_total(index, SEL_DISEASE) if kind == "total" else
                RK.disease_page(index, path, SEL_DISEASE, PAGE_OFFSET, PAGE_LIMIT))
    return run


def _processed_split(spark, sf):
    """J2 with the lead variants of most rows split on purpose."""
    ds = _ds(spark, sf)
    heavy = heavy_keys(ds.raw, "gwas_snp", HEAVY_PARTITIONS)
    return build_processed(ds.raw, ds.gene_dim, ds.lead_variant, heavy)


def _gene_location(spark, sf):
    return K.gene_location(_ds(spark, sf).gene_dim, GENE_ID)


def _gene_location_batch(spark, sf):
    ds = _ds(spark, sf)
    return K.gene_location_batch(ds.gene_dim, ds.evidence.select("gene_id").distinct())


def _variant_location(vid: str) -> Query:
    return lambda spark, sf: K.variant_location(_ds(spark, sf).processed, vid)


def _variant_location_batch(spark, sf):
    return K.variant_locations(_ds(spark, sf).processed)


def _search(spark, sf):
    return K.search(_ds(spark, sf).processed, VARIANT_ID)


def _search_batch(spark, sf):
    ds = _ds(spark, sf)
    qs = (ds.evidence.select(F.col("ld_snp_rsID").alias("query"))
          .unionByName(ds.evidence.select(F.col("gwas_snp").alias("query"))))
    return K.search_batch(ds.processed, qs)


def _batch_small(spark, sf):
    ds = _ds(spark, sf)
    loci = B.loci_per_chromosome(ds.gene_dim, START, END)
    return B.summarise(ds.membership, loci)


def _batch_binned(spark, sf):
    ds = _ds(spark, sf)
    loci = B.loci_around_genes(ds.gene_dim, GENE_FLANK)
    return B.summarise(ds.membership, loci, BIN_SIZE)


def _batch_auto(spark, sf):
    ds = _ds(spark, sf)
    loci = B.loci_around_genes(ds.gene_dim, GENE_FLANK)
    return B.summarise(ds.processed, loci, None)


def _roundtrip_tsv(spark, sf):
    path = K_.write_transformed(_ds(spark, sf).raw, scratch_path(spark, "transformed-tsv"), fmt="tsv")
    return R.read_transformed(spark, path, fmt="tsv")


def _roundtrip_parquet(spark, sf):
    path = K_.write_processed(_ds(spark, sf).processed, scratch_path(spark, "processed"))
    return spark.read.parquet(path)


def _layout_locus(child: str) -> Query:
    def run(spark, sf):
        ds = _ds(spark, sf)
        path = K_.write_by_chromosome(ds.processed, scratch_path(spark, "by-chrom"))
        layout = K_.read_by_chromosome(spark, path)
        out = L.locus(layout, ds.genes, L.Locus(CHROM, START, END))[child]
        return out.withColumn("exons", exons_text(F.col("exons"))) if child == "genes" else out
    return run


def _layout_membership(spark, sf):
    path = K_.write_by_chromosome(_ds(spark, sf).processed, scratch_path(spark, "by-chrom"))
    return K_.read_by_chromosome(spark, path).select("idx", "chrom", S.LEAD_CHROM, S.LEAD_POS)


def _gene_lookup_json(spark, sf):
    path = K_.write_gene_lookup(_ds(spark, sf).genes, scratch_path(spark, "genes-json"))
    return K_.read_gene_lookup(spark, path).withColumn("exons", exons_text(F.col("exons")))


def _sample_rows(spark, sf):
    return R.sample_rows(_ds(spark, sf).evidence, 500).select("idx", "gene_id", "gwas_snp", "score")


def _evidence_tsv(spark, sf, columns=None) -> str:
    """The evidence as gzipped TSV files; ``columns`` replaces some of them."""
    path = scratch_path(spark, "evidence-tsv")
    rows = _ds(spark, sf).evidence.withColumns(columns or {})
    rows.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return path


def _first_rows(spark, sf):
    """R2: the first 500 rows by key of evidence files in any order."""
    return R.read_evidence(spark, _evidence_tsv(spark, sf), tissues=[], key_column="idx", nrows=500,
                           columns=["gene_id", "gwas_snp", "score"]).select("idx", "gene_id", "gwas_snp", "score")


def _row_index(spark, sf):
    """Transformed rows written in order, numbered again as they stand in the files."""
    ordered = _ds(spark, sf).raw.repartitionByRange("idx").sortWithinPartitions("idx")
    path = K_.write_transformed(ordered, scratch_path(spark, "transformed-idx"))
    return R.read_transformed(spark, path, add_index=True).select(
        "idx", "gene_id", "ld_snp_rsID", "gwas_snp", "score")


def _ot_vep_join(spark, sf):
    ev = _ds(spark, sf).evidence.select("idx", "vep_terms")
    return R.ot_vep_by_join(ev, R.terms_table(spark))


def _read_terms(spark, sf):
    """The term table from a TSV file with other columns, joined to the evidence."""
    path = scratch_path(spark, "terms-tsv")
    (R.terms_table(spark).select(F.lit("u").alias("url"), "value", "term")
     .write.option("sep", "\t").option("header", True).csv(path))
    ev = _ds(spark, sf).evidence.select("idx", "vep_terms")
    return R.ot_vep_by_join(ev, R.read_terms(spark, path))


def _float_integers(spark, sf):
    """R1 on a file that writes whole numbers as floats (463.0, 1.2E7)."""
    whole = [n for n, t in S.EVIDENCE_TYPES.items() if t.simpleString() == "bigint"]
    path = _evidence_tsv(spark, sf, {c: F.col(c).cast("double") for c in whole})
    ev = R.read_evidence(spark, path, tissues=FX.FIXTURE_TISSUES, key_column="idx")
    return T_transform(ev, tissues=FX.FIXTURE_TISSUES)


def _from_file_rows(spark, sf):
    """R5 while writing: the transformed rows of a TSV, parsed once, numbered as they stand in its files."""
    base = scratch_path(spark, "numbered")
    (FX.evidence(spark, sf, in_order=True).drop("idx")
     .write.option("sep", "\t").option("header", True).csv(f"{base}/evidence"))
    rows = R.read_evidence(spark, f"{base}/evidence", FX.FIXTURE_TISSUES, add_places=True)
    kept = T_transform(rows, FX.FIXTURE_TISSUES, also=(R.FILE, R.BLOCK))
    path = R.write_numbered(kept, f"{base}/transformed", f"{base}/scanned")
    return R.read_transformed(spark, path).select("idx", "gene_id", "ld_snp_rsID", "gwas_snp", "score")


def _from_file(spark, sf):
    """A TSV without an index column to the served tables, and a locus from these."""
    ds, base = _ds(spark, sf), scratch_path(spark, "from-file")
    (FX.evidence(spark, sf, in_order=True).drop("idx")
     .write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(f"{base}/evidence"))
    paths = build_from_file(spark, f"{base}/evidence", ds.genes, ds.lead_variant, f"{base}/tables",
                            tissues=FX.FIXTURE_TISSUES)
    api = EvidenceAPI.from_tables(spark, paths)
    return api.locus(CHROM, START, END)["geneVariants"]


def _api(ds) -> EvidenceAPI:
    return EvidenceAPI(ds.processed, ds.processed, ds.genes, ds.ids)


def _api_keyset(sort: tuple[str, ...]) -> Query:
    """All rows of a disease after the first page, by cursor."""
    def run(spark, sf):
        api = _api(_ds(spark, sf))
        first = api.diseaseTable(SEL_DISEASE, limit=PAGE_OFFSET, sort=sort, after=())["rows"].collect()
        rest = api.diseaseTable(SEL_DISEASE, sort=sort, after=TB.cursor(first[-1], sort))["rows"]
        return rest.drop("_lead_chrom", "_lead_pos")
    return run


def _stored_ids(spark, sf):
    path = K_.write_id_table(_ds(spark, sf).ids, scratch_path(spark, "ids"))
    return spark.read.parquet(path)


def _pair_batch(spark, sf):
    """P8 for every lead-variant-disease pair of the evidence at once."""
    ds = _ds(spark, sf)
    ids = ds.evidence.select(F.concat("gwas_snp", F.lit("-"), "disease_efo_id").alias("selected_id"))
    rows = L.window_rows(ds.processed, CHROM, START, END)
    return P.selected_rows(rows, ids, "leadVariantDisease").select("idx", "selected_id")


# Columns that lack their number (NaN) in every 7th row of the queries below.
HOLES = ["GTEx", "Nearest", "gwas_pvalue"]


def _holes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col("idx") % 7 == 0, F.lit(float("nan"))).otherwise(F.col(c))
                           for c in columns})


def _nan_transform(spark, sf):
    evidence = _holes(_ds(spark, sf).evidence, [*HOLES, *FX.FIXTURE_TISSUES[:2]])
    return T_transform(evidence, tissues=FX.FIXTURE_TISSUES)


def _nan_window(spark, sf):
    return L.window_rows(_holes(_ds(spark, sf).processed, HOLES), CHROM, START, END)


def _nan_must_have(spark, sf):
    return _nan_window(spark, sf).where(P.must_have(("gtex", "nearest"))).select("idx")


def _nan_nearest(spark, sf):
    """C10 and A11 on NaN: the row is served and not nearest."""
    rows = TB.full_row(_nan_window(spark, sf))
    return rows.select("index", F.coalesce("nearest", F.lit(False)).alias("nearest"))


def _nan_max_pvalue(spark, sf):
    return L.max_gwas_pvalue(_nan_window(spark, sf))


def _nested_gene(spark, sf):
    flat = nested.flatten_gene_record(FX.gene_records(spark, sf))
    text = F.array_join(F.transform("ct_exons", lambda e: F.concat(
        e["id"], F.lit(":"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ";")
    return flat.withColumn("ct_exons", text)


def _nested_variant(spark, sf):
    return nested.flatten_variant_record(FX.variant_records(spark, sf))


def _stream_transform(spark, sf):
    from locusforge.streaming.transform_stream import start_transform_stream
    src, sink = scratch_path(spark, "stream-src"), scratch_path(spark, "stream-sink")
    _ds(spark, sf).evidence.write.parquet(src)
    start_transform_stream(spark, src, sink, tissues=FX.FIXTURE_TISSUES,
                           available_now=True).awaitTermination()
    return spark.read.parquet(sink)


def _stream_funnel(spark, sf):
    from locusforge.streaming.transform_stream import start_funnel_stream
    src, sink = scratch_path(spark, "stream-src"), scratch_path(spark, "funnel-sink")
    _ds(spark, sf).evidence.write.parquet(src)
    start_funnel_stream(spark, src, sink, tissues=FX.FIXTURE_TISSUES).awaitTermination()
    out = spark.read.parquet(sink).withColumn("epoch", F.col("epoch").cast("int"))
    last = out.agg(F.max("epoch").alias("_e"))
    return out.join(last, out["epoch"] == last["_e"]).drop("epoch", "_e")


def _r1_tsv_transform(spark, sf):
    """R1 end to end: evidence as TSV text (44 tissue columns) -> typed read -> transform."""
    path = _evidence_tsv(spark, sf)
    ev = R.read_evidence(spark, path, tissues=FX.FIXTURE_TISSUES, key_column="idx")
    return T_transform(ev, tissues=FX.FIXTURE_TISSUES)


def _batch_locus_genes(spark, sf):
    ds = _ds(spark, sf)
    loci = B.loci_around_genes(ds.gene_dim, GENE_FLANK)
    out = L.locus_batch(ds.ranked_membership, ds.genes, loci, bin_size=BIN_SIZE, materialize=True,
                        outputs=["genes"])["genes"]
    return out.withColumn("exons", exons_text(F.col("exons")))


def _annotation_parquet(spark, sf):
    """Annotation tables stored as Parquet, read back by name, gene build on top."""
    from locusforge.sources.annotation import GENE_TABLES, read_parquet_tables
    makers = {"exon_transcript": FX.ens_exon_transcript, "exon": FX.ens_exon, "gene": FX.ens_gene,
              "transcript": FX.ens_transcript, "seq_region": FX.ens_seq_region}
    base = scratch_path(spark, "annotation")
    paths = {}
    for name in GENE_TABLES:
        paths[name] = f"{base}/{name}"
        makers[name](spark, sf).write.parquet(paths[name])
    t = read_parquet_tables(spark, paths)
    genes = A.build_genes(t["exon_transcript"], t["exon"], t["gene"], t["transcript"], t["seq_region"])
    return genes.withColumn("exons", exons_text(F.col("exons")))


def _locus_batch(child: str) -> Query:
    def run(spark, sf):
        ds = _ds(spark, sf)
        loci = B.loci_around_genes(ds.gene_dim, GENE_FLANK)
        return L.locus_batch(ds.ranked_membership, ds.genes, loci, P.LocusFilters(**_edge_kw()), materialize=True,
                             outputs=[child])[child]
    return run


def _keyset_page(spark, sf):
    # Both pages are read from the stored window: the evidence is joined once.
    path = scratch_path(spark, "window")
    L.window_rows(_ds(spark, sf).processed, CHROM, START, END).write.parquet(path)
    rows = spark.read.parquet(path)
    first = TB.keyset_page(rows, None, PAGE_OFFSET).collect()   # one small page on the driver
    last = first[-1]
    return TB.keyset_page(rows, (last["index"], last["_lead_chrom"], last["_lead_pos"]),
                          PAGE_LIMIT).drop("_lead_chrom", "_lead_pos")


QUERIES: dict[str, Query] = {
    # T3-T8, A14
    "filter_source": _filter_query(T.gwas_source_ok, ["gwas_source"]),
    "filter_chrom": _filter_query(T.chromosomes_ok, ["GRCh38_chrom", "GRCh38_gene_chrom"]),
    "filter_same_chrom": _filter_query(T.same_chromosome, ["GRCh38_chrom", "GRCh38_gene_chrom"]),
    "filter_distance": _filter_query(T.within_distance, ["GRCh38_pos", "GRCh38_gene_pos"]),
    "filter_evidence": _filter_query(T.evidence_gate, ["GTEx", "VEP", "PCHiC", "Fantom5", "DHS", "Nearest"]),
    "filter_funnel": lambda spark, sf: T.filter_funnel(_ds(spark, sf).evidence),
    # Q7, C1-C4, S1-S4
    "transform_full": _transform_full,
    "ot_vep": _ot_vep,
    "gtex_max": _gtex_max,
    "g2v_score": _g2v,
    "g2v_score_nonzero": _g2v_nonzero,
    # Q8, Q9, A1-A3, J3-J5, J7
    "gene_dim": _gene_dim,
    "annotation_parquet": _annotation_parquet,
    "genes_per_chrom": _genes_per_chrom,
    "canonical_exons": _canonical_exons,
    "lead_variants": _lead_variants,
    "variants_semi": _variants_semi,
    "distinct_lead_variants": _distinct_leads,
    # Q10, K3, J7
    "processed": _processed,
    "chrom_membership": _membership,
    "unresolved_genes": _unresolved_genes,
    "unresolved_leads": _unresolved_leads,
    # P1-P8 on the default window
    "locus_window": _window_pred_query(lambda: None),
    "p_must_have": _window_pred_query(lambda: P.must_have(MUST_HAVES)),
    "p_score": _window_pred_query(lambda: P.score_range(SCORE)),
    "p_r2": _window_pred_query(lambda: P.r2_range(R2)),
    "p_pvalue": _window_pred_query(lambda: P.pvalue_range(PVALUE)),
    "p_entity": _window_pred_query(lambda: P.selection(SEL_DISEASE, "disease")),
    "p_pair": _window_pred_query(lambda: P.selection(SEL_LEAD_DISEASE, "leadVariantDisease")),
    # Q1: A5-A13, J6, O1, A6
    "locus_genes": _locus_child("genes"),
    "locus_variants": _locus_child("variants"),
    "locus_lead_variants": _locus_child("leadVariants"),
    "locus_diseases": _locus_child("diseases"),
    "locus_gene_variants": _locus_child("geneVariants", **_edge_kw()),
    "locus_variant_leads": _locus_child("variantLeadVariants", **_edge_kw()),
    "locus_lead_diseases": _locus_child("leadVariantDiseases", **_edge_kw()),
    "locus_max_pvalue": _locus_child("maxGwasPValue"),
    "locus_gene_variants_unfiltered": _locus_child("geneVariants"),
    "locus_genes_selected": _locus_child("genes", sel_id=SEL_GENE, sel_type="gene"),
    "locus_diseases_selected": _locus_child("diseases", sel_id=SEL_DISEASE, sel_type="disease"),
    "locus_gene_variants_selected": _locus_child("geneVariants", sel_id=SEL_GENE_VARIANT,
                                                 sel_type="geneVariant"),
    "locus_lead_diseases_selected": _locus_child("leadVariantDiseases", sel_id=SEL_LEAD_DISEASE,
                                                 sel_type="leadVariantDisease"),
    # Q2, Q3, C10, O2-O4, A4
    "locus_table_page": _locus_table("page", offset=PAGE_OFFSET, limit=PAGE_LIMIT),
    "locus_table_total": _locus_table("total"),
    "locus_table_filtered_page": _locus_table("page", **_edge_kw(), offset=0, limit=PAGE_LIMIT),
    "locus_table_filtered_total": _locus_table("total", **_edge_kw()),
    "locus_table_all_filters_total": _locus_table("total", **_all_filters_kw()),
    "locus_table_selected_total": _locus_table("total", sel_id=SEL_GENE, sel_type="gene"),
    "table_sorted_page": _locus_table("page", offset=0, limit=PAGE_LIMIT, sort=("-gwasPValue",)),
    "disease_table_page": _disease_table("page", PAGE_OFFSET, PAGE_LIMIT),
    "disease_table_total": _disease_table("total"),
    # Q4-Q6
    "gene_location": _gene_location,
    "gene_location_batch": _gene_location_batch,
    "variant_location": _variant_location(VARIANT_ID),
    "variant_location_lead_only": _variant_location(LEAD_ONLY_ID),
    "variant_location_both": _variant_location(BOTH_ID),
    "variant_location_batch": _variant_location_batch,
    "search": _search,
    "search_batch": _search_batch,
    # J8
    "batch_locus_small": _batch_small,
    "batch_locus_binned": _batch_binned,
    "batch_locus_auto": _batch_auto,
    "batch_locus_genes": _batch_locus_genes,
    "batch_locus_gene_variants": _locus_batch("geneVariants"),
    "batch_locus_max_pvalue": _locus_batch("maxGwasPValue"),
    "keyset_page": _keyset_page,
    # Structured Streaming forms of Q7 and A14
    "stream_transform": _stream_transform,
    "stream_funnel": _stream_funnel,
    # C11, C12, P12
    "nested_gene": _nested_gene,
    "nested_variant": _nested_variant,
    # R1-R5, K1-K4 round trips
    "roundtrip_tsv": _roundtrip_tsv,
    "r1_tsv_transform": _r1_tsv_transform,
    "roundtrip_processed": _roundtrip_parquet,
    "roundtrip_partitioned": _layout_membership,
    "layout_locus_genes": _layout_locus("genes"),
    "layout_locus_gene_variants": _layout_locus("geneVariants"),
    "gene_lookup_json": _gene_lookup_json,
    "sample_rows": _sample_rows,
    "first_rows": _first_rows,
    "disease_table_ranked_page": _ranked("page"),
    "disease_table_ranked_total": _ranked("total"),
    "processed_split": _processed_split,
    "build_from_file_rows": _from_file_rows,
    "row_index": _row_index,
    "ot_vep_join": _ot_vep_join,
    "read_terms": _read_terms,
    "r1_float_integers": _float_integers,
    "build_from_file": _from_file,
    # Cursor paging, stored lookups, all selections, missing numbers
    "api_keyset_all": _api_keyset(()),
    "api_keyset_sorted": _api_keyset(("-gwasPValue",)),
    "disease_table_sorted_page": _disease_table("page", 0, PAGE_LIMIT, ("-gwasPValue",)),
    "disease_table_rest": _disease_table("page", PAGE_OFFSET),
    "variant_location_stored": lambda spark, sf: K.variant_location(_stored_ids(spark, sf), VARIANT_ID),
    "search_stored": lambda spark, sf: K.search(_stored_ids(spark, sf), LEAD_ONLY_ID),
    "search_batch_stored": lambda spark, sf: K.search_batch(
        _stored_ids(spark, sf), _ds(spark, sf).evidence.select(F.col("gwas_snp").alias("query"))),
    "p_variant": _window_pred_query(lambda: P.selection(SEL_VARIANT, "variant")),
    "p_lead_variant": _window_pred_query(lambda: P.selection(SEL_LEAD, "leadVariant")),
    "p_gene_variant": _window_pred_query(lambda: P.selection(SEL_GENE_VARIANT, "geneVariant")),
    "p_variant_lead_variant": _window_pred_query(lambda: P.selection(SEL_VARIANT_LEAD, "variantLeadVariant")),
    "p_pair_batch": _pair_batch,
    "locus_variants_selected": _locus_child("variants", sel_id=SEL_VARIANT, sel_type="variant"),
    "locus_lead_variants_selected": _locus_child("leadVariants", sel_id=SEL_LEAD, sel_type="leadVariant"),
    "locus_variant_leads_selected": _locus_child("variantLeadVariants", sel_id=SEL_VARIANT_LEAD,
                                                 sel_type="variantLeadVariant"),
    "batch_locus_variants": _locus_batch("variants"),
    "batch_locus_lead_variants": _locus_batch("leadVariants"),
    "batch_locus_diseases": _locus_batch("diseases"),
    "batch_locus_variant_leads": _locus_batch("variantLeadVariants"),
    "batch_locus_lead_diseases": _locus_batch("leadVariantDiseases"),
    "nan_transform": _nan_transform,
    "nan_must_have": _nan_must_have,
    "nan_nearest": _nan_nearest,
    "nan_max_pvalue": _nan_max_pvalue,
}


def _oracle() -> dict[str, str]:
    ev = lambda cond, cols: O.with_ctes(["evidence"], [], f"SELECT idx, {cols} FROM evidence WHERE {cond}")
    edge = _edge_kw()
    loc = (CHROM, START, END)
    order_desc_p = "gwas_pvalue DESC NULLS LAST, "
    return {
        "filter_source": ev(O.T3, "gwas_source"),
        "filter_chrom": ev(O.T45, "GRCh38_chrom, GRCh38_gene_chrom"),
        "filter_same_chrom": ev(O.T6, "GRCh38_chrom, GRCh38_gene_chrom"),
        "filter_distance": ev(O.T7, "GRCh38_pos, GRCh38_gene_pos"),
        "filter_evidence": ev(O.T8, "GTEx, VEP, PCHiC, Fantom5, DHS, Nearest"),
        "filter_funnel": (funnel_sql := O.with_ctes(["evidence"], [], (
            "SELECT count(*) AS input_rows, "
            f"count(*) FILTER (WHERE {O.T3}) AS after_gwas_source, "
            f"count(*) FILTER (WHERE {O.T3} AND {O.T45}) AS after_chromosomes, "
            f"count(*) FILTER (WHERE {O.T3} AND {O.T45} AND {O.T6}) AS after_same_chromosome, "
            f"count(*) FILTER (WHERE {O.T3} AND {O.T45} AND {O.T6} AND {O.T7}) AS after_distance, "
            f"count(*) FILTER (WHERE {O.T_ALL}) AS after_evidence_gate FROM evidence"))),
        "transform_full": O.with_ctes(["raw"], [], "SELECT * FROM raw"),
        "ot_vep": O.with_ctes(["evidence"], [], f"SELECT idx, vep_terms, {O.OT_VEP} AS ot_vep FROM evidence"),
        "gtex_max": O.with_ctes(["evidence"], [], f"SELECT idx, {O.GTISSUE} AS gtex_max_tissue, "
                                f"{O.GMAX} AS gtex_max_value FROM evidence"),
        "g2v_score": O.g2v_sql(),
        "g2v_score_nonzero": f"SELECT * FROM ({O.g2v_sql()}) s WHERE ot_g2v_score > 0",
        "gene_dim": O.GENE_DIM_SQL,
        "annotation_parquet": O.GENE_DIM_SQL,
        "genes_per_chrom": O.GENES_PER_CHROM_SQL,
        "canonical_exons": O.with_ctes(["ens_seq_region", "ens_gene", "ens_transcript", "ens_exon",
                                        "ens_exon_transcript"], [("ce", O.CANONICAL_EXONS_SQL)],
                                       "SELECT * FROM ce"),
        "lead_variants": O.with_ctes(["raw", "ens_seq_region", "variation", "variation_feature"], [], (
            "SELECT v.name AS gwas_snp, vf.seq_region_start AS position, r.name AS seq_region_name "
            "FROM variation v JOIN variation_feature vf ON v.variation_id = vf.variation_id "
            "JOIN ens_seq_region r ON vf.seq_region_id = r.seq_region_id "
            "WHERE v.name IN (SELECT gwas_snp FROM raw)")),
        "variants_semi": O.with_ctes(["raw", "variation"], [],
                                     "SELECT * FROM variation WHERE name IN (SELECT gwas_snp FROM raw)"),
        "distinct_lead_variants": O.with_ctes(["raw"], [], "SELECT DISTINCT gwas_snp FROM raw "
                                              "WHERE gwas_snp IS NOT NULL"),
        "processed": O.with_ctes(["processed"], [], "SELECT * FROM processed"),
        "chrom_membership": O.with_ctes(["member"], [], f"SELECT idx, chrom, {S.LEAD_CHROM}, "
                                        f"{S.LEAD_POS} FROM member"),
        "unresolved_genes": O.with_ctes(["raw", "gene_dim"], [], (
            "SELECT DISTINCT gene_id FROM raw WHERE gene_id IS NOT NULL AND gene_id NOT IN "
            "(SELECT gene_id FROM gene_dim)")),
        "unresolved_leads": O.with_ctes(["raw", "lead_variant"], [], (
            "SELECT DISTINCT gwas_snp FROM raw WHERE gwas_snp IS NOT NULL AND gwas_snp NOT IN "
            "(SELECT gwas_snp FROM lead_variant)")),
        "locus_window": _window_pred_sql(None),
        "p_must_have": _window_pred_sql(O.must_have_sql(MUST_HAVES)),
        "p_score": _window_pred_sql(O.range_sql("score", SCORE)),
        "p_r2": _window_pred_sql(O.range_sql("r2", R2)),
        "p_pvalue": _window_pred_sql(O.pvalue_sql(PVALUE)),
        "p_entity": _window_pred_sql(O.selection_sql(SEL_DISEASE, "disease")),
        "p_pair": _window_pred_sql(O.selection_sql(SEL_LEAD_DISEASE, "leadVariantDisease")),
        "locus_genes": O.locus_child_sql("genes", *loc),
        "locus_variants": O.locus_child_sql("variants", *loc),
        "locus_lead_variants": O.locus_child_sql("leadVariants", *loc),
        "locus_diseases": O.locus_child_sql("diseases", *loc),
        "locus_gene_variants": O.locus_child_sql("geneVariants", *loc, **edge),
        "locus_variant_leads": O.locus_child_sql("variantLeadVariants", *loc, **edge),
        "locus_lead_diseases": O.locus_child_sql("leadVariantDiseases", *loc, **edge),
        "locus_max_pvalue": O.locus_child_sql("maxGwasPValue", *loc),
        "locus_gene_variants_unfiltered": O.locus_child_sql("geneVariants", *loc),
        "locus_genes_selected": O.locus_child_sql("genes", *loc, sel_id=SEL_GENE, sel_type="gene"),
        "locus_diseases_selected": O.locus_child_sql("diseases", *loc, sel_id=SEL_DISEASE,
                                                     sel_type="disease"),
        "locus_gene_variants_selected": O.locus_child_sql("geneVariants", *loc, sel_id=SEL_GENE_VARIANT,
                                                          sel_type="geneVariant"),
        "locus_lead_diseases_selected": O.locus_child_sql("leadVariantDiseases", *loc,
                                                          sel_id=SEL_LEAD_DISEASE,
                                                          sel_type="leadVariantDisease"),
        "locus_table_page": O.locus_table_sql("page", *loc, offset=PAGE_OFFSET, limit=PAGE_LIMIT),
        "locus_table_total": O.locus_table_sql("total", *loc),
        "locus_table_filtered_page": O.locus_table_sql("page", *loc, **edge, offset=0, limit=PAGE_LIMIT),
        "locus_table_filtered_total": O.locus_table_sql("total", *loc, **edge),
        "locus_table_all_filters_total": O.locus_table_sql("total", *loc, **_all_filters_kw()),
        "locus_table_selected_total": O.locus_table_sql("total", *loc, sel_id=SEL_GENE, sel_type="gene"),
        "table_sorted_page": O.locus_table_sql("page", *loc, offset=0, limit=PAGE_LIMIT,
                                               order_prefix=order_desc_p),
        "disease_table_page": O.disease_table_sql("page", SEL_DISEASE, PAGE_OFFSET, PAGE_LIMIT),
        "disease_table_ranked_page": O.disease_table_sql("page", SEL_DISEASE, PAGE_OFFSET, PAGE_LIMIT),
        "disease_table_ranked_total": O.disease_table_sql("total", SEL_DISEASE),
        "processed_split": O.with_ctes(["processed"], [], "SELECT * FROM processed"),
        "disease_table_total": O.disease_table_sql("total", SEL_DISEASE),
        "gene_location": O.gene_location_sql(GENE_ID),
        "gene_location_batch": O.gene_location_sql(None),
        "variant_location": O.variant_location_sql(VARIANT_ID),
        "variant_location_lead_only": O.variant_location_sql(LEAD_ONLY_ID),
        "variant_location_both": O.variant_location_sql(BOTH_ID),
        "variant_location_batch": O.variant_locations_sql(),
        "search": O.search_sql(VARIANT_ID),
        "search_batch": O.search_sql(None),
        "batch_locus_small": O.batch_locus_sql(O.loci_per_chromosome_sql(START, END), ["gene_dim"]),
        "batch_locus_binned": O.batch_locus_sql(O.loci_around_genes_sql(GENE_FLANK), ["gene_dim"]),
        "batch_locus_auto": O.batch_locus_sql(O.loci_around_genes_sql(GENE_FLANK), ["gene_dim"]),
        "stream_transform": O.with_ctes(["raw"], [], "SELECT * FROM raw"),
        "stream_funnel": funnel_sql,
        "nested_gene": O.NESTED_GENE_SQL,
        "nested_variant": O.NESTED_VARIANT_SQL,
        "roundtrip_tsv": O.with_ctes(["raw"], [], "SELECT * FROM raw"),
        "r1_tsv_transform": O.with_ctes(["raw"], [], "SELECT * FROM raw"),
        "batch_locus_genes": O.batch_locus_genes_sql(O.loci_around_genes_sql(GENE_FLANK)),
        "batch_locus_gene_variants": O.batch_locus_gene_variants_sql(
            O.loci_around_genes_sql(GENE_FLANK), O.filters_sql(**_edge_kw())),
        "batch_locus_max_pvalue": O.batch_locus_max_pvalue_sql(O.loci_around_genes_sql(GENE_FLANK)),
        "keyset_page": O.keyset_page_sql(CHROM, START, END, PAGE_OFFSET, PAGE_LIMIT),
        "roundtrip_processed": O.with_ctes(["processed"], [], "SELECT * FROM processed"),
        "roundtrip_partitioned": O.with_ctes(["member"], [], f"SELECT idx, chrom, {S.LEAD_CHROM}, "
                                             f"{S.LEAD_POS} FROM member"),
        "layout_locus_genes": O.locus_child_sql("genes", *loc),
        "layout_locus_gene_variants": O.locus_child_sql("geneVariants", *loc),
        "gene_lookup_json": O.with_ctes(["genes"], [], "SELECT * FROM genes"),
        "sample_rows": O.with_ctes(["evidence"], [], "SELECT idx, gene_id, gwas_snp, score FROM evidence "
                                   "ORDER BY idx LIMIT 500"),
        "first_rows": O.with_ctes(["evidence"], [], "SELECT idx, gene_id, gwas_snp, score FROM evidence "
                                  "ORDER BY idx LIMIT 500"),
        "row_index": (dense_sql := O.with_ctes(["raw"], [], (
            "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, gene_id, ld_snp_rsID, gwas_snp, score FROM raw"))),
        "build_from_file_rows": dense_sql,
        "ot_vep_join": (vep_sql := O.with_ctes(["evidence"], [], f"SELECT idx, vep_terms, {O.OT_VEP} AS ot_vep "
                                               "FROM evidence")),
        "read_terms": vep_sql,
        "r1_float_integers": O.with_ctes(["raw"], [], "SELECT * FROM raw"),
        "build_from_file": O.locus_child_sql("geneVariants", *loc),
        "api_keyset_all": (rest_sql := O.disease_table_sql("page", SEL_DISEASE, PAGE_OFFSET)),
        "api_keyset_sorted": O.disease_table_sql("page", SEL_DISEASE, PAGE_OFFSET, None, order_desc_p),
        "disease_table_sorted_page": O.disease_table_sql("page", SEL_DISEASE, 0, PAGE_LIMIT, order_desc_p),
        "disease_table_rest": rest_sql,
        "variant_location_stored": O.variant_location_sql(VARIANT_ID),
        "search_stored": O.search_sql(LEAD_ONLY_ID),
        "search_batch_stored": O.with_ctes(["processed", "evidence"], [], (
            "SELECT DISTINCT gwas_snp AS id, gwas_snp AS name, 'variant' AS type FROM evidence WHERE gwas_snp IN "
            "(SELECT ld_snp_rsID FROM processed) OR gwas_snp IN (SELECT gwas_snp FROM processed)")),
        "p_variant": _window_pred_sql(O.selection_sql(SEL_VARIANT, "variant")),
        "p_lead_variant": _window_pred_sql(O.selection_sql(SEL_LEAD, "leadVariant")),
        "p_gene_variant": _window_pred_sql(O.selection_sql(SEL_GENE_VARIANT, "geneVariant")),
        "p_variant_lead_variant": _window_pred_sql(O.selection_sql(SEL_VARIANT_LEAD, "variantLeadVariant")),
        "p_pair_batch": O.pair_batch_sql(*loc, "leadVariantDisease"),
        "locus_variants_selected": O.locus_child_sql("variants", *loc, sel_id=SEL_VARIANT, sel_type="variant"),
        "locus_lead_variants_selected": O.locus_child_sql("leadVariants", *loc, sel_id=SEL_LEAD,
                                                          sel_type="leadVariant"),
        "locus_variant_leads_selected": O.locus_child_sql("variantLeadVariants", *loc, sel_id=SEL_VARIANT_LEAD,
                                                          sel_type="variantLeadVariant"),
        **{name: O.batch_child_sql(child, O.loci_around_genes_sql(GENE_FLANK), O.filters_sql(**edge))
           for name, child in [("batch_locus_variants", "variants"), ("batch_locus_lead_variants", "leadVariants"),
                               ("batch_locus_diseases", "diseases"),
                               ("batch_locus_variant_leads", "variantLeadVariants"),
                               ("batch_locus_lead_diseases", "leadVariantDiseases")]},
        "nan_transform": O.missing_transform_sql([*HOLES, *FX.FIXTURE_TISSUES[:2]]),
        "nan_must_have": O.missing_window_sql(*loc, HOLES, "SELECT idx FROM u WHERE GTEx > 0.999975 AND Nearest > 0"),
        "nan_nearest": O.missing_window_sql(*loc, HOLES, 'SELECT idx AS "index", coalesce(Nearest > 0, false) '
                                            "AS nearest FROM u"),
        "nan_max_pvalue": O.missing_window_sql(*loc, HOLES, "SELECT CASE WHEN min(gwas_pvalue) > 0 THEN "
                                               '-log10(min(gwas_pvalue)) END AS "maxGwasPValue" FROM u'),
    }


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return _oracle()
