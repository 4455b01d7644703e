"""Row-level evidence functions as Spark Column expressions (no Python UDFs).

The term lookup tests literal arrays, row maxima are array functions and phases
are ``when`` chains: no lambda, so nothing falls out of whole-stage codegen for
its kind.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import schemas as S

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing_as_null(x: ColumnOrName) -> Column:
    """NaN -> NULL, so that every comparison on a missing value is false."""
    c = _c(x)
    return F.when(~F.isnan(c), c)


# ---------------------------------------------------------------------------
# Best known variant-effect term score
# ---------------------------------------------------------------------------
TermPairs = Iterable[tuple[str, float]]


def default_terms() -> list[tuple[str, float]]:
    return list(S.ECO_SCORES)


def term_list(vep_terms: ColumnOrName) -> Column:
    return F.split(_c(vep_terms), ",")


def best_term_score(vep_terms: ColumnOrName, terms: TermPairs | None = None,
                    parts: Column | None = None) -> Column:
    """Largest value of the comma-separated terms found in ``terms``; 0 if none.

    Terms are split on ',' with no trimming, so ' stop_gained' is unknown.
    Terms are grouped by value and tested from the highest value down with
    ``arrays_overlap``: a handful of codegen-friendly checks per row instead
    of a per-element lambda. ``parts`` is the ``term_list``, where it has a
    column of its own.
    """
    levels: dict[float, list[str]] = {}
    for term, value in (terms if terms is not None else default_terms()):
        if term is not None and value is not None:
            levels.setdefault(float(value), []).append(term)
    parts = term_list(vep_terms) if parts is None else parts
    out = None
    for value in sorted(levels, reverse=True):
        hit = F.arrays_overlap(parts, F.array(*[F.lit(t) for t in levels[value]]))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


def ot_vep(vep_terms: ColumnOrName, terms: TermPairs | None = None,
           minimum: float = S.MINIMUM_VEP_VALUE, parts: Column | None = None) -> Column:
    """Best term score when it reaches ``minimum`` (inclusive), else 0: only such terms are looked for."""
    high = [(t, v) for t, v in (terms if terms is not None else default_terms()) if v is not None and v >= minimum]
    return best_term_score(vep_terms, high, parts)


# ---------------------------------------------------------------------------
# Best tissue
# ---------------------------------------------------------------------------
def tissue_values(cols: Sequence[ColumnOrName]) -> Column:
    """The tissue columns as one array, which C3 and C4 both read."""
    return F.array(*[_c(c).cast("double") for c in cols])


def max_of_tissues(values: Column) -> Column:
    """Largest value of the array; NULL and NaN are skipped, NULL if none is left."""
    return F.array_max(F.array_remove(values, F.lit(float("nan"))))


def tissue_of_max(values: Column, largest: Column, names: Sequence[str]) -> Column:
    """Name of the first place that holds ``largest``; NULL without one."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.try_element_at(labels, F.nullif(F.array_position(values, largest), F.lit(0)).cast("int"))


def gtex_max_value(cols: Sequence[ColumnOrName]) -> Column:
    """Row maximum over the tissue columns (C3); missing values are skipped."""
    return max_of_tissues(tissue_values(cols))


def gtex_max_tissue(cols: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """Name of the first tissue column holding the row maximum (C4); NULL if all missing."""
    return tissue_of_max(tissue_values(cols), gtex_max_value(cols), list(names or cols))


# ---------------------------------------------------------------------------
# Gene-to-variant score and its reason
# ---------------------------------------------------------------------------
def linear_map(x: ColumnOrName, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Map [x0, x1] linearly onto [y0, y1] (no clamping)."""
    return (_c(x) - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)) + F.lit(y0)


def _gt(c: ColumnOrName, thr: float) -> Column:
    # NULL-safe "greater than": missing compares false.
    return F.coalesce(greater_than(c, thr), F.lit(False))


def greater_than(c: ColumnOrName, thr: float) -> Column:
    """``c > thr`` with NaN false. NaN sorts above +inf in Spark, so the upper
    bound excludes it while both comparisons stay pushable to Parquet."""
    x = _c(c)
    return (x > F.lit(thr)) & (x <= F.lit(float("inf")))


def funcgen_score(gtex: ColumnOrName, pchic: ColumnOrName, fantom5: ColumnOrName,
                  dhs: ColumnOrName) -> Column:
    """Weighted functional-genomics evidence in [0, 1]."""
    parts = [
        F.when(_gt(gtex, S.MINIMUM_GTEX_VALUE), _c(gtex) * S.GTEX_WEIGHT).otherwise(0.0),
        F.when(_gt(pchic, 0.0), _c(pchic) * S.PCHIC_WEIGHT).otherwise(0.0),
        F.when(_gt(fantom5, 0.0), _c(fantom5) * S.FANTOM5_WEIGHT).otherwise(0.0),
        F.when(_gt(dhs, 0.0), _c(dhs) * S.DHS_WEIGHT).otherwise(0.0),
    ]
    return (parts[0] + parts[1] + parts[2] + parts[3]) / F.lit(S.FUNCGEN_TOTAL_WEIGHT)


def g2v_score(vep_terms: ColumnOrName, gtex: ColumnOrName, pchic: ColumnOrName,
              fantom5: ColumnOrName, dhs: ColumnOrName, nearest: ColumnOrName,
              terms: TermPairs | None = None) -> Column:
    """Four phases: strong VEP term, functional genomics, nearest gene, none."""
    vep = best_term_score(vep_terms, terms)
    fg = funcgen_score(gtex, pchic, fantom5, dhs)
    return (F.when(vep >= F.lit(S.MINIMUM_VEP_VALUE),
                   linear_map(vep, S.MINIMUM_VEP_VALUE, 1.0, S.OT_G2V_PHASE_1_MIN, S.OT_G2V_PHASE_1_MAX))
            .when(fg > 0, linear_map(fg, 0.0, 1.0, S.OT_G2V_PHASE_2_MIN, S.OT_G2V_PHASE_2_MAX))
            .when(_gt(nearest, 0.0), F.lit(S.OT_G2V_PHASE_3_VALUE))
            .otherwise(F.lit(0.0)))


def g2v_reason(vep_terms: ColumnOrName, gtex: ColumnOrName, pchic: ColumnOrName,
               fantom5: ColumnOrName, dhs: ColumnOrName, nearest: ColumnOrName,
               terms: TermPairs | None = None) -> Column:
    """'1:VEP', '2:<sources joined by ;>', '3:Nearest' or ''."""
    vep = best_term_score(vep_terms, terms)
    sources = F.concat_ws(
        ";",
        F.when(_gt(gtex, S.MINIMUM_GTEX_VALUE), F.lit("GTEx")),
        F.when(_gt(pchic, 0.0), F.lit("PCHiC")),
        F.when(_gt(fantom5, 0.0), F.lit("Fantom5")),
        F.when(_gt(dhs, 0.0), F.lit("DHS")),
    )
    return (F.when(vep >= F.lit(S.MINIMUM_VEP_VALUE), F.lit("1:VEP"))
            .when(sources != "", F.concat(F.lit("2:"), sources))
            .when(_gt(nearest, 0.0), F.lit("3:Nearest"))
            .otherwise(F.lit("")))


def with_g2v_score(df: DataFrame, terms: TermPairs | None = None, drop_zero: bool = False) -> DataFrame:
    """Add ``ot_g2v_score`` and ``ot_g2v_score_reason``; optionally drop score 0."""
    args = ("vep_terms", "GTEx", "PCHiC", "Fantom5", "DHS", "Nearest")
    out = (df.withColumn("ot_g2v_score", g2v_score(*args, terms=terms))
             .withColumn("ot_g2v_score_reason", g2v_reason(*args, terms=terms)))
    return out.where(F.col("ot_g2v_score") > 0) if drop_zero else out


# ---------------------------------------------------------------------------
# Strand, TSS, exon pair, composite id, -log10
# ---------------------------------------------------------------------------
def forward_strand(strand: ColumnOrName) -> Column:
    """1 -> true, -1 -> false, anything else NULL."""
    s = _c(strand)
    return F.when(s == 1, F.lit(True)).when(s == -1, F.lit(False))


def tss(start: ColumnOrName, end: ColumnOrName, fwd: ColumnOrName) -> Column:
    """Transcription start site: start on the forward strand, else end."""
    return F.when(_c(fwd), _c(start)).otherwise(_c(end))


def exon_pair(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.struct(_c(start).alias("start"), _c(end).alias("end"))


def composite_id(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a-b``; NULL when either side is NULL (concat, not concat_ws)."""
    return F.concat(_c(a), F.lit("-"), _c(b))


def neg_log10(p: ColumnOrName) -> Column:
    """-log10(p); NULL for p <= 0 or NULL."""
    c = _c(p)
    return F.when(c > 0, -F.log10(c))
