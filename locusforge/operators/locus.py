"""Q1: drawable entities of a genomic window.

Vertices (genes, variants, lead variants, diseases) and the maximum
-log10 p-value come from the *unfiltered* window; the three edge lists from
the *filtered* one. Every output is a lazy DataFrame: an output nobody reads
is never computed.

Representative rows: a group's non-key columns all come from the one row with
the smallest (idx, lead chromosome, lead position), NULLs first. This is a
``min(struct(order..., payload...))`` aggregate, which Spark computes partially
on the map side, so a hot group is reduced before the shuffle instead of
landing whole in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import schemas as S
from locusforge.functions.scores import composite_id, greater_than, missing_as_null, neg_log10
from locusforge.operators import predicates as P
from locusforge.operators.processed import chromosome_table, one_copy, row_hash
from locusforge.session import scratch_path


def representative(df: DataFrame, keys: Sequence[str], payload: dict[str, Column],
                   flag: Column | None = None, order: Sequence[str] = S.ROW_ORDER,
                   info: DataFrame | None = None) -> DataFrame:
    """Group by ``keys``; take all ``payload`` columns from the first row in ``order``; add ``info`` by gene_id.

    ``flag`` (a row predicate) becomes ``selected``: true when any row of the
    group satisfies it; a NULL boolean when there is no selection.
    """
    rep = F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                         *[c.alias(n) for n, c in payload.items()])).alias("_rep")
    sel = (F.count_if(flag) > 0) if flag is not None else F.lit(None).cast("boolean")
    grouped = df.groupBy(*keys).agg(rep, sel.alias("selected"))
    found = grouped.select(*keys, *[F.col(f"_rep.{n}").alias(n) for n in payload], "selected")
    return found if info is None else found.join(info, "gene_id", "left")


Pick = Callable[..., DataFrame]


def _finish(df: DataFrame, cols: Sequence[str], has_selection: bool, sort_key: str) -> DataFrame:
    out = df.select(*cols)
    # Selected entities come last; the id makes the order total.
    return out.orderBy("selected", sort_key) if has_selection else out


def selection_flag(selected_id: str | None, selected_type: str | None) -> Column | None:
    return P.selection(selected_id, selected_type)


@dataclass
class Locus:
    """A locus request: a window on one chromosome table plus edge filters."""

    chrom: str
    start: int
    end: int
    filters: P.LocusFilters = field(default_factory=P.LocusFilters)
    selected_id: str | None = None
    selected_type: str | None = None

    @property
    def flag(self) -> Column | None:
        return selection_flag(self.selected_id, self.selected_type)


def window_rows(source: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Unfiltered window: chromosome table rows, resolved (P1), in window.

    The chromosome layout stores an envelope of each row's positions, which is
    tested first: it lets a scan skip row groups where the OR over four
    positions alone cannot.
    """
    if S.FIRST_POS in source.columns:
        source = source.where(P.in_envelope(start, end))
    return chromosome_table(source, chrom).where(P.resolved() & P.in_window(start, end))


def gene_vertices(unfiltered: DataFrame, genes: DataFrame, flag: Column | None = None,
                  keys: Sequence[str] = (), pick: Pick = representative) -> DataFrame:
    """A7 + J6: genes of the window with their annotation (strand, TSS, exons)."""
    info = genes.select("gene_id", "description", F.col("fwdstrand").alias("forwardStrand"),
                        "tss", F.col("gene_start").alias("start"),
                        F.col("gene_end").alias("end"), "exons")
    reps = pick(unfiltered, [*keys, "gene_id"], {
        "symbol": F.col("gene_symbol"),
        "chromosome": F.col("GRCh38_gene_chrom"),
    }, flag, info=info)
    out = reps.withColumnRenamed("gene_id", "id")
    cols = [*keys, "id", "symbol", "description", "chromosome", "tss", "start", "end",
            "forwardStrand", "exons", "selected"]
    return _finish(out, cols, flag is not None and not keys, "id")


def variant_vertices(unfiltered: DataFrame, flag: Column | None = None,
                     keys: Sequence[str] = (), pick: Pick = representative) -> DataFrame:
    """Variants of the window and their position."""
    out = pick(unfiltered, [*keys, "ld_snp_rsID"], {"position": F.col("GRCh38_pos")}, flag)
    out = out.withColumnRenamed("ld_snp_rsID", "id")
    return _finish(out, [*keys, "id", "position", "selected"], flag is not None and not keys, "id")


def lead_variant_vertices(unfiltered: DataFrame, flag: Column | None = None,
                          keys: Sequence[str] = (), pick: Pick = representative) -> DataFrame:
    """Lead variants of the window and their position."""
    out = pick(unfiltered, [*keys, "gwas_snp"], {"position": F.col(S.LEAD_POS)}, flag)
    out = out.withColumnRenamed("gwas_snp", "id")
    return _finish(out, [*keys, "id", "position", "selected"], flag is not None and not keys, "id")


def disease_vertices(unfiltered: DataFrame, flag: Column | None = None,
                     keys: Sequence[str] = (), pick: Pick = representative) -> DataFrame:
    """A10: diseases of the window (a NULL disease id is its own group)."""
    out = pick(unfiltered, [*keys, "disease_efo_id"], {"name": F.col("disease_name")}, flag)
    out = out.withColumnRenamed("disease_efo_id", "id")
    return _finish(out, [*keys, "id", "name", "selected"], flag is not None and not keys, "id")


def gene_variant_edges(filtered: DataFrame, genes: DataFrame, flag: Column | None = None,
                       keys: Sequence[str] = (), pick: Pick = representative) -> DataFrame:
    """A11 + J6: gene-variant edges; geneTss comes from the gene annotation."""
    tss = genes.select("gene_id", F.col("tss").alias("geneTss"))
    reps = pick(filtered, [*keys, "gene_id", "ld_snp_rsID"], {
        "geneSymbol": F.col("gene_symbol"),
        "geneChromosome": F.col("GRCh38_gene_chrom"),
        "vPos": F.col("GRCh38_pos"),
        "otG2VScore": F.col("score"),
        "gtexMaxTissue": F.col("gtex_max_tissue"),
        "gtexMaxValue": F.col("gtex_max_value"),
        "vep": F.col("ot_vep"),
        "vepTerms": F.col("vep_terms"),
        "gtex": F.col("GTEx"),
        "pchic": F.col("PCHiC"),
        "fantom5": F.col("Fantom5"),
        "dhs": F.col("DHS"),
        "nearest": greater_than("Nearest", 0.0),
    }, flag, info=tss)
    out = (reps.withColumn("id", composite_id("gene_id", "ld_snp_rsID"))
           .withColumnRenamed("gene_id", "geneId").withColumnRenamed("ld_snp_rsID", "vId"))
    cols = [*keys, "id", "geneId", "geneSymbol", "geneChromosome", "geneTss", "vId", "vPos",
            "otG2VScore", "gtexMaxTissue", "gtexMaxValue", "vep", "vepTerms", "gtex", "pchic",
            "fantom5", "dhs", "nearest", "selected"]
    return _finish(out, cols, flag is not None and not keys, "id")


def variant_lead_variant_edges(filtered: DataFrame, flag: Column | None = None,
                               keys: Sequence[str] = (), pick: Pick = representative) -> DataFrame:
    """Variant-lead variant edges with r2."""
    reps = pick(filtered, [*keys, "ld_snp_rsID", "gwas_snp"], {
        "vPos": F.col("GRCh38_pos"), "lvPos": F.col(S.LEAD_POS), "r2": F.col("r2")}, flag)
    out = (reps.withColumn("id", composite_id("ld_snp_rsID", "gwas_snp"))
           .withColumnRenamed("ld_snp_rsID", "vId").withColumnRenamed("gwas_snp", "lvId"))
    cols = [*keys, "id", "vId", "vPos", "lvId", "lvPos", "r2", "selected"]
    return _finish(out, cols, flag is not None and not keys, "id")


def lead_variant_disease_edges(filtered: DataFrame, flag: Column | None = None,
                               keys: Sequence[str] = (), pick: Pick = representative) -> DataFrame:
    """Lead variant-disease edges with the GWAS statistics."""
    reps = pick(filtered, [*keys, "gwas_snp", "disease_efo_id"], {
        "lvPos": F.col(S.LEAD_POS), "efoName": F.col("disease_name"),
        "gwasPValue": F.col("gwas_pvalue"), "gwasOddsRatio": F.col("gwas_odds_ratio"),
        "gwasBeta": F.col("gwas_beta"), "gwasStudy": F.col("gwas_study"),
        "gwasPMId": F.col("gwas_pmid"), "gwasSize": F.col("gwas_size")}, flag)
    out = (reps.withColumn("id", composite_id("gwas_snp", "disease_efo_id"))
           .withColumnRenamed("gwas_snp", "lvId").withColumnRenamed("disease_efo_id", "efoId"))
    cols = [*keys, "id", "lvId", "lvPos", "efoId", "efoName", "gwasPValue", "gwasOddsRatio",
            "gwasBeta", "gwasStudy", "gwasPMId", "gwasSize", "selected"]
    return _finish(out, cols, flag is not None and not keys, "id")


def max_gwas_pvalue(unfiltered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A5 + C9: -log10 of the smallest p-value (NULL for an empty window or p=0; NaN is missing)."""
    agg = F.min(missing_as_null("gwas_pvalue")).alias("_minp")
    grouped = unfiltered.groupBy(*keys).agg(agg) if keys else unfiltered.agg(agg)
    return grouped.select(*keys, neg_log10("_minp").alias("maxGwasPValue"))


class LocusOutputs(dict):
    """The eight outputs by name. ``release()`` drops the cached window, if there is one."""

    window: DataFrame | None = None

    def release(self) -> None:
        if self.window is not None:
            self.window.unpersist()
            self.window = None


def locus(source: DataFrame, genes: DataFrame, request: Locus, cache: bool = False) -> LocusOutputs:
    """All eight outputs of a locus request, as lazy DataFrames.

    ``source`` is the processed table or its chromosome layout. With
    ``cache=True`` the window is cached once and shared by the eight outputs
    until ``release()`` is called on the result.
    """
    unfiltered = window_rows(source, request.chrom, request.start, request.end)
    if cache:
        unfiltered = unfiltered.cache()
    edge_pred = request.filters.predicate()
    filtered = unfiltered.where(edge_pred) if edge_pred is not None else unfiltered
    flag = request.flag
    out = LocusOutputs({
        "genes": gene_vertices(unfiltered, genes, flag),
        "variants": variant_vertices(unfiltered, flag),
        "leadVariants": lead_variant_vertices(unfiltered, flag),
        "diseases": disease_vertices(unfiltered, flag),
        "geneVariants": gene_variant_edges(filtered, genes, flag),
        "variantLeadVariants": variant_lead_variant_edges(filtered, flag),
        "leadVariantDiseases": lead_variant_disease_edges(filtered, flag),
        "maxGwasPValue": max_gwas_pvalue(unfiltered),
    })
    out.window = unfiltered if cache else None
    return out


def locus_batch(source: DataFrame, genes: DataFrame, loci: DataFrame,
                filters: P.LocusFilters = P.LocusFilters(), flag: Column | None = None,
                bin_size: int | None = None,
                materialize: bool = False, outputs: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Q1 for a whole table of windows (locus_id, chrom, start, end) in one job.

    Rows are matched to windows by the batch locus join (J8); every output is
    grouped by ``locus_id`` first, so each window gets exactly what a single
    ``locus`` request would return for it. Windows without any row are
    absent (a single request would return empty lists and a NULL maximum).

    ``materialize=True`` is meant for all eight outputs: rows are keyed and the
    window join runs once, over narrow rows, with all groupings in one pass
    (``grouped_once``); what they are is stored in the shared folder and the
    outputs read it. ``outputs`` names those that are wanted, if not all: then
    each is made by itself of its own columns, and nothing is stored. Without
    ``materialize`` every output is a lazy plan of its own.
    """
    from locusforge.operators.batch_locus import DEFAULT_BIN, batch_locus_rows
    if materialize:
        return grouped_once(source, genes, loci, filters, flag, bin_size or DEFAULT_BIN, outputs)
    pairs = batch_locus_rows(source, loci, bin_size or DEFAULT_BIN)
    edge_pred = filters.predicate()
    filtered = pairs.where(edge_pred) if edge_pred is not None else pairs
    k = ["locus_id"]
    return {
        "genes": gene_vertices(pairs, genes, flag, k),
        "variants": variant_vertices(pairs, flag, k),
        "leadVariants": lead_variant_vertices(pairs, flag, k),
        "diseases": disease_vertices(pairs, flag, k),
        "geneVariants": gene_variant_edges(filtered, genes, flag, k),
        "variantLeadVariants": variant_lead_variant_edges(filtered, flag, k),
        "leadVariantDiseases": lead_variant_disease_edges(filtered, flag, k),
        "maxGwasPValue": max_gwas_pvalue(pairs, k),
    }


# Keys of the three kinds of edges, and the kind whose groups each other output is
# rolled up from.
EDGES: dict[str, list[str]] = {
    "geneVariants": ["gene_id", "ld_snp_rsID"],
    "variantLeadVariants": ["ld_snp_rsID", "gwas_snp"],
    "leadVariantDiseases": ["gwas_snp", "disease_efo_id"],
}
ROLLED_UP = {"genes": "geneVariants", "variants": "geneVariants", "leadVariants": "variantLeadVariants",
             "diseases": "leadVariantDiseases", "maxGwasPValue": "geneVariants"}
# Keys of an output that is made by itself.
OWN = EDGES | {"genes": ["gene_id"], "variants": ["ld_snp_rsID"], "leadVariants": ["gwas_snp"],
               "diseases": ["disease_efo_id"], "maxGwasPValue": []}
# Columns of the rows that an output reads beside its keys, positions and the row order.
PAYLOAD = {
    "genes": ["gene_symbol"], "variants": [], "leadVariants": [], "diseases": ["disease_name"],
    "geneVariants": ["gene_symbol", "score", "gtex_max_tissue", "gtex_max_value", "ot_vep", "vep_terms", "GTEx", "PCHiC",
                     "Fantom5", "DHS", "Nearest"],
    "variantLeadVariants": ["r2"],
    "leadVariantDiseases": ["disease_name", "gwas_odds_ratio", "gwas_beta", "gwas_study", "gwas_pmid", "gwas_size"]}
# Outputs of which many rows have the same keys and places.
ALIKE = ["genes", "leadVariants", "geneVariants"]
ROW_KEY = "row_key"
# The ``row_hash`` of a source that has it already, and the order of rows with it.
REST = "_rest"
ORDER = [*S.ROW_ORDER, REST]


def ranked_rows(source: DataFrame) -> DataFrame:
    """``source`` with the hash that decides between rows of one idx, lead chromosome and lead position."""
    return source if REST in source.columns else source.withColumn(REST, row_hash(source.columns))


def keyed_rows(source: DataFrame) -> DataFrame:
    """The resolved rows of ``source`` once each, stored, with a ``row_key`` in row order.

    The key is a long that is unique and grows with (idx, lead chromosome, lead
    position), NULLs first; equal ones are in the order of a hash of the rest. It
    is given while range-partitioned, sorted rows are written, so it needs no
    counting, and what was committed does not change.
    """
    rows = ranked_rows(one_copy(source).where(P.resolved()))
    path = scratch_path(rows.sparkSession, "keyed-rows")
    (rows.repartitionByRange(*S.ROW_ORDER).sortWithinPartitions(*ORDER)
     .withColumn(ROW_KEY, F.monotonically_increasing_id()).drop(REST).write.parquet(path))
    return rows.sparkSession.read.parquet(path)


def looked_up(source: DataFrame, genes: DataFrame, loci: DataFrame, filters: P.LocusFilters,
              bin_size: int, outputs: Sequence[str]) -> dict[str, DataFrame]:
    """Some ``outputs`` of every window, each by itself: its rows are looked up in the windows' home cells.

    ``batch_locus.first_rows`` makes them without a row for each pair, of the
    columns of the source that the output reads. Windows that share an id and
    very long ones are grouped from pairs, by the output's own keys; only where
    there are some, rows are read twice and so stored, with these columns.
    """
    from locusforge.operators import batch_locus as B
    alone, others, cell = B.split_loci(loci.select("locus_id", "chrom", "start", "end").distinct(), B.LONGEST)
    windows = B.home_cells(alone, cell, B.TIMES)
    windows_of_few = B.home_cells(alone, cell, B.FEW_TIMES)
    rows = ranked_rows(source)
    picked = [name for name in outputs if name in PAYLOAD]
    if others is not None and picked:
        read = {"chrom", *ORDER, *P.POSITIONS, *P.CHROMOSOME_COLUMNS, "score", "r2", "gwas_pvalue",
                *(S.MUST_HAVE_COLUMNS.values() if filters.must_haves else []),
                *[c for name in picked for c in OWN[name] + PAYLOAD[name] + (["gwas_snp"] if name in ALIKE else [])]}
        path = scratch_path(source.sparkSession, "batch-rows")
        rows.where(P.resolved()).select(*[c for c in rows.columns if c in read]).write.parquet(path)
        rows = source.sparkSession.read.parquet(path)
    edge_pred = filters.predicate()
    edges = rows if edge_pred is None else rows.where(edge_pred)
    pvalue = missing_as_null("gwas_pvalue")

    def pick(found_in: DataFrame, keys: Sequence[str], payload: dict[str, Column], flag: Column | None,
             info: DataFrame | None = None) -> DataFrame:
        name = next(n for n, own in OWN.items() if own == keys[1:])
        meeting = windows_of_few if name == "diseases" else windows
        # Rows of one place in the row order are alike in all that lead variants read: no hash of the rest decides.
        order = S.ROW_ORDER if name == "leadVariants" else ORDER
        read = [*order, *PAYLOAD[name], *(["GRCh38_gene_chrom"] if "gene_id" in keys else [])]
        found = B.first_rows(found_in, meeting, keys[1:], F.struct(*order), payload, info,
                             read if name in ALIKE else None, by_gene=name == "genes").withColumn(
            "selected", F.lit(None).cast("boolean"))
        if others is None:
            return found
        pairs = B.batch_locus_rows(found_in, others, bin_size)
        return found.unionByName(representative(pairs, keys, payload, order=order, info=info))

    k = ["locus_id"]

    def least() -> DataFrame:
        found = B.least_values(source, windows, pvalue).select(*k, neg_log10("_least").alias("maxGwasPValue"))
        return found if others is None else found.unionByName(
            max_gwas_pvalue(B.batch_locus_rows(source, others, bin_size), k))
    made = {
        "genes": lambda: gene_vertices(rows, genes, None, k, pick),
        "variants": lambda: variant_vertices(rows, None, k, pick),
        "leadVariants": lambda: lead_variant_vertices(rows, None, k, pick),
        "diseases": lambda: disease_vertices(rows, None, k, pick),
        "geneVariants": lambda: gene_variant_edges(edges, genes, None, k, pick),
        "variantLeadVariants": lambda: variant_lead_variant_edges(edges, None, k, pick),
        "leadVariantDiseases": lambda: lead_variant_disease_edges(edges, None, k, pick),
        "maxGwasPValue": least,
    }
    return {name: make() for name, make in made.items() if name in outputs}


def grouped_once(source: DataFrame, genes: DataFrame, loci: DataFrame, filters: P.LocusFilters,
                 flag: Column | None, bin_size: int, outputs: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The eight outputs of every window from one pass over the (locus, row) pairs.

    A group's representative row is the one with the smallest ``row_key``, a
    long, so the groupings of the three kinds of edges are one hash aggregate
    (grouping sets), partial before its only shuffle: no pair is sorted, and a
    hot key is reduced where its rows are. A group knows its first row and its
    first row that passes the edge filters; vertices and the maximum follow
    from the groups. The payload of the chosen rows is fetched by key.

    A few ``outputs`` without a selection are made each by itself (``looked_up``).
    """
    from locusforge.operators.batch_locus import batch_locus_rows
    if outputs is not None and flag is None:
        return looked_up(source, genes, loci, filters, bin_size, outputs)
    spark = source.sparkSession
    wanted = [*OWN] if outputs is None else list(outputs)
    edge_pred = filters.predicate()
    rows = keyed_rows(source)
    edge = F.lit(True) if edge_pred is None else F.coalesce(edge_pred, F.lit(False))
    selected = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    ids = ["gene_id", "ld_snp_rsID", "gwas_snp", "disease_efo_id"]
    pairs = batch_locus_rows(rows, loci, bin_size).select(
        "locus_id", *ids, ROW_KEY, edge.alias("edge"), selected.alias("flag"),
        missing_as_null("gwas_pvalue").alias("pvalue"))
    columns = ["locus_id", *ids]
    # The bit of a column is set in the grouping id where the column is not a key.
    number = {name: sum(1 << k for k, c in enumerate(reversed(columns)) if c not in ("locus_id", *keys))
              for name, keys in EDGES.items()}
    marks = [] if flag is None else [F.bool_or("flag").alias("any"),
                                     F.bool_or(F.col("flag") & F.col("edge")).alias("any_edge")]
    groups = pairs.groupingSets([["locus_id", *keys] for keys in EDGES.values()], *columns).agg(
        F.grouping_id().alias("number"), F.min(ROW_KEY).alias("first"),
        F.min(F.when(F.col("edge"), F.col(ROW_KEY))).alias("first_edge"), F.min("pvalue").alias("pvalue"), *marks)
    output = F.coalesce(*[F.when(F.col("number") == n, name) for name, n in number.items()])
    path = scratch_path(spark, "locus-groups")
    groups.select("*", output.alias("output")).drop("number").write.parquet(path)
    stored = spark.read.parquet(path)

    def groups_of(name: str, keys: Sequence[str]) -> DataFrame:
        """(keys, first, any): the chosen row of every group of an output."""
        if name in EDGES:
            return stored.where((F.col("output") == name) & F.col("first_edge").isNotNull()).select(
                *keys, F.col("first_edge").alias("first"), *([F.col("any_edge").alias("any")] if marks else []))
        edges = stored.where(F.col("output") == ROLLED_UP[name])
        return edges.groupBy(*keys).agg(F.min("first").alias("first"), *([F.bool_or("any").alias("any")] if marks else []))

    def fetched(name: str) -> Pick:
        def pick(_, keys: Sequence[str], payload: dict[str, Column], marked: Column | None,
                 info: DataFrame | None = None) -> DataFrame:
            sel = F.col("any") if marked is not None else F.lit(None).cast("boolean")
            found = groups_of(name, keys).select(*keys, F.col("first").alias("_first"), sel.alias("selected"))
            values = rows.select(F.col(ROW_KEY).alias("_key"), *[c.alias(f"_{n}") for n, c in payload.items()])
            found = (found.join(values, found["_first"] == values["_key"])
                     .select(*keys, *[F.col(f"_{n}").alias(n) for n in payload], "selected"))
            return found if info is None else found.join(info, "gene_id", "left")
        return pick

    k = ["locus_id"]
    least = stored.where(F.col("output") == ROLLED_UP["maxGwasPValue"]).groupBy(*k).agg(F.min("pvalue").alias("pvalue"))
    made = {
        "genes": lambda: gene_vertices(rows, genes, flag, k, fetched("genes")),
        "variants": lambda: variant_vertices(rows, flag, k, fetched("variants")),
        "leadVariants": lambda: lead_variant_vertices(rows, flag, k, fetched("leadVariants")),
        "diseases": lambda: disease_vertices(rows, flag, k, fetched("diseases")),
        "geneVariants": lambda: gene_variant_edges(rows, genes, flag, k, fetched("geneVariants")),
        "variantLeadVariants": lambda: variant_lead_variant_edges(rows, flag, k, fetched("variantLeadVariants")),
        "leadVariantDiseases": lambda: lead_variant_disease_edges(rows, flag, k, fetched("leadVariantDiseases")),
        "maxGwasPValue": lambda: least.select(*k, neg_log10("pvalue").alias("maxGwasPValue")),
    }
    return {name: make() for name, make in made.items() if name in wanted}
