"""Paged evidence tables (Q2 locus table, Q3 disease table; C10, O2-O4, A4).

A page is (rows, total): two lazy DataFrames over the same filtered rows.
Pages are ordered by (idx, lead chromosome, lead position) so that offset
paging is deterministic; ``orderBy(...).offset().limit()`` plans as a
per-partition top-k, and ``keyset_page`` avoids deep offsets altogether.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import schemas as S
from locusforge.functions.scores import greater_than
from locusforge.operators import predicates as P
from locusforge.operators.locus import window_rows
from locusforge.sources.evidence import with_row_index

# Evidence row as served (source column -> API name).
FULL_ROW: list[tuple[str, str]] = [
    (S.KEY, "index"),
    ("gene_id", "geneId"),
    ("gene_symbol", "geneSymbol"),
    ("GRCh38_gene_chrom", "geneChromosome"),
    ("GRCh38_gene_pos", "geneTss"),
    ("ld_snp_rsID", "vId"),
    ("GRCh38_chrom", "variantChromosome"),
    ("GRCh38_pos", "vPos"),
    ("gwas_snp", "lvId"),
    ("disease_efo_id", "efoId"),
    ("disease_name", "efoName"),
    ("score", "otG2VScore"),
    ("gtex_max_tissue", "gtexMaxTissue"),
    ("gtex_max_value", "gtexMaxValue"),
    ("ot_vep", "vep"),
    ("vep_terms", "vepTerms"),
    ("GTEx", "gtex"),
    ("PCHiC", "pchic"),
    ("Fantom5", "fantom5"),
    ("DHS", "dhs"),
    ("Nearest", "nearest"),
    ("r2", "r2"),
    ("gwas_pvalue", "gwasPValue"),
    ("gwas_odds_ratio", "gwasOddsRatio"),
    ("gwas_beta", "gwasBeta"),
    ("gwas_size", "gwasSize"),
    ("gwas_pmid", "gwasPMId"),
    ("gwas_study", "gwasStudy"),
]
API_TO_SOURCE = {api: src for src, api in FULL_ROW}


def full_row(df: DataFrame, keep_order_columns: bool = False) -> DataFrame:
    """C10 projection; ``nearest`` is served as a boolean (Nearest > 0)."""
    cols = [greater_than(src, 0.0).alias(api) if api == "nearest" else F.col(src).alias(api)
            for src, api in FULL_ROW]
    if keep_order_columns:
        cols += [F.col(S.LEAD_CHROM).alias("_lead_chrom"), F.col(S.LEAD_POS).alias("_lead_pos")]
    return df.select(*cols)


def _row_order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in S.ROW_ORDER]


def page(rows: DataFrame, offset: int = 0, limit: int | None = None,
         sort: Sequence[Column] = ()) -> DataFrame:
    """Rows ordered by ``sort`` then the row order, sliced, projected."""
    ordered = rows.orderBy(*sort, *_row_order())
    if limit is not None:
        return full_row(ordered.offset(int(offset)).limit(int(limit)) if offset else ordered.limit(int(limit)))
    if offset:
        # All rows from a place on: numbered in order, part by part, so the
        # rows never meet on the driver.
        ordered = with_row_index(ordered, "_place").where(F.col("_place") >= int(offset)).drop("_place")
    return full_row(ordered)


def total(rows: DataFrame) -> DataFrame:
    """A4: number of rows under the page's own filters."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def sort_columns(fields: Sequence[str]) -> list[Column]:
    """API field names, '-' prefix for descending (NULLs last when descending)."""
    out = []
    for f in fields:
        desc = f.startswith("-")
        name = f[1:] if desc else f
        if name not in API_TO_SOURCE:
            raise ValueError(f"unknown sort field {name!r}")
        c = F.col(API_TO_SOURCE[name])
        out.append(c.desc_nulls_last() if desc else c.asc_nulls_first())
    return out


def _keys(sort: Sequence[str]) -> list[tuple[str, str, bool]]:
    """(output name, source column, descending) of the sort fields and the row key."""
    keys = [(f.lstrip("-"), API_TO_SOURCE[f.lstrip("-")], f.startswith("-")) for f in sort]
    return [*keys, ("index", S.KEY, False), ("_lead_chrom", S.LEAD_CHROM, False), ("_lead_pos", S.LEAD_POS, False)]


def cursor(row, sort: Sequence[str] = ()) -> tuple:
    """The ``after`` value of a page row: its sort fields and row key."""
    return tuple(row[name] for name, _, _ in _keys(sort))


def keyset_page(rows: DataFrame, after: tuple | None, limit: int | None, sort: Sequence[str] = ()) -> DataFrame:
    """Scalable paging: the ``limit`` rows (None: all) strictly after the row key ``after``.

    ``after`` is the ``cursor`` of the last row of the previous page (None or () for
    the first page), under the same ``sort``. Cost does not grow with depth.
    """
    order = sort_columns(sort)
    if after:
        keys = _keys(sort)
        if len(after) != len(keys):
            raise ValueError(f"the cursor needs {len(keys)} values, {[k for k, _, _ in keys]}")
        beyond, same = F.lit(False), F.lit(True)
        for (_, column, descending), value in zip(keys, after):
            c = F.col(column)
            # NULLs stand first in ascending and last in descending order.
            if value is None:
                past = F.lit(False) if descending else c.isNotNull()
            else:
                past = (c < F.lit(value)) | c.isNull() if descending else c > F.lit(value)
            beyond = beyond | (same & F.coalesce(past, F.lit(False)))
            same = same & c.eqNullSafe(F.lit(value))
        rows = rows.where(beyond)
    ordered = rows.orderBy(*order, *_row_order())
    return full_row(ordered if limit is None else ordered.limit(int(limit)), keep_order_columns=True)


def locus_table_rows(source: DataFrame, chrom: str, start: int, end: int,
                     filters: P.LocusFilters = P.LocusFilters(),
                     selected_id: str | None = None, selected_type: str | None = None) -> DataFrame:
    """Q2 rows: window (P1, P2) AND edge filters (P3-P6) AND selection."""
    rows = window_rows(source, chrom, start, end)
    pred = P.and_all(filters.predicate(), P.selection(selected_id, selected_type))
    return rows.where(pred)


def locus_table(source: DataFrame, chrom: str, start: int, end: int,
                filters: P.LocusFilters = P.LocusFilters(),
                selected_id: str | None = None, selected_type: str | None = None,
                offset: int = 0, limit: int | None = None,
                sort: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Q2: (page, total) of the filtered locus rows."""
    rows = locus_table_rows(source, chrom, start, end, filters, selected_id, selected_type)
    return page(rows, offset, limit, sort_columns(sort)), total(rows)


def disease_table(processed: DataFrame, efo_id: str, offset: int = 0,
                  limit: int | None = None, sort: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Q3: (page, total) of all processed rows of one disease (no P1 filter)."""
    rows = processed.where(P.equals("disease_efo_id", efo_id))
    return page(rows, offset, limit, sort_columns(sort)), total(rows)
