"""Row predicates of the locus, table and lookup queries.

Every predicate is a typed Column built from literals: user input is never
pasted into SQL text, and evidence names go through a whitelist.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import schemas as S
from locusforge.functions.scores import greater_than

POSITIONS = [S.GENE_START, S.GENE_END, "GRCh38_pos", S.LEAD_POS]
CHROMOSOME_COLUMNS = ["GRCh38_gene_chrom", "GRCh38_chrom", S.LEAD_CHROM]


def resolved() -> Column:  # P1
    """Gene start, gene end and lead-variant position are all known."""
    return (F.col(S.GENE_START).isNotNull() & F.col(S.GENE_END).isNotNull()
            & F.col(S.LEAD_POS).isNotNull())


def in_window(start: int, end: int) -> Column:  # P2 (positions part)
    """Any of gene start, gene end, variant, lead variant in [start, end].

    An endpoint test, not an overlap test: a gene spanning the whole window
    does not match by itself.
    """
    s, e = F.lit(int(start)), F.lit(int(end))
    out = None
    for p in POSITIONS:
        c = F.col(p).between(s, e)
        out = c if out is None else out | c
    return out


def in_envelope(start: int, end: int) -> Column:
    """The stored envelope of a row's positions meets [start, end]: every row in the window passes."""
    return (F.col(S.FIRST_POS) <= F.lit(int(end))) & (F.col(S.LAST_POS) >= F.lit(int(start)))


def check_chromosome(chrom: str) -> str:
    chrom = str(chrom)
    if chrom not in S.BUILD_CHROMOSOMES:
        raise ValueError(f"no chromosome table for {chrom!r}")
    return chrom


def chromosome_member(chrom: str) -> Column:  # P2 (table part)
    """Row belongs to the chromosome table: any of 3 chromosome columns matches."""
    c = F.lit(check_chromosome(chrom))
    return ((F.col("GRCh38_gene_chrom") == c) | (F.col("GRCh38_chrom") == c)
            | (F.col(S.LEAD_CHROM) == c))


def must_have(names: Sequence[str] | None) -> Column | None:  # P3
    """AND over evidence names: gtex above its threshold, others above 0."""
    out = None
    for name in names or []:
        key = str(name).lower()
        if key not in S.MUST_HAVE_COLUMNS:
            raise ValueError(f"unknown evidence name {name!r}")
        thr = S.MINIMUM_GTEX_VALUE if key == "gtex" else 0.0
        c = greater_than(S.MUST_HAVE_COLUMNS[key], thr)
        out = c if out is None else out & c
    return out


def _range(col: str, bounds: Sequence[float] | None) -> Column | None:
    # Range arguments apply only when exactly two values are given.
    if bounds is None or len(bounds) != 2:
        return None
    return (F.col(col) >= F.lit(float(bounds[0]))) & (F.col(col) <= F.lit(float(bounds[1])))


def score_range(bounds):  # P4
    return _range("score", bounds)


def r2_range(bounds):  # P5
    return _range("r2", bounds)


def pvalue_bounds(neg_log10_range: Sequence[float]) -> tuple[float, float]:
    """[a, b] in -log10 space -> (10^-b, 10^-a) in p-value space."""
    a, b = float(neg_log10_range[0]), float(neg_log10_range[1])
    return 10.0 ** -b, 10.0 ** -a


def pvalue_range(neg_log10_range):  # P6
    if neg_log10_range is None or len(neg_log10_range) != 2:
        return None
    lo, hi = pvalue_bounds(neg_log10_range)
    return (F.col("gwas_pvalue") >= F.lit(lo)) & (F.col("gwas_pvalue") <= F.lit(hi))


def split_pair(selected_id: str) -> tuple[str | None, str | None]:
    """First two '-'-separated parts of a composite id (missing part -> None)."""
    parts = str(selected_id).split("-")
    return parts[0], (parts[1] if len(parts) > 1 else None)


def selection(selected_id: str | None, selected_type: str | None) -> Column | None:  # P7, P8
    """Row predicate of a selection; None when there is no (known) selection."""
    if selected_id is None or selected_type is None:
        return None
    if selected_type in S.SIMPLE_SELECTIONS:
        return F.col(S.SIMPLE_SELECTIONS[selected_type]) == F.lit(str(selected_id))
    if selected_type in S.PAIR_SELECTIONS:
        a_col, b_col = S.PAIR_SELECTIONS[selected_type]
        a, b = split_pair(selected_id)
        return (F.col(a_col) == F.lit(a)) & (F.col(b_col) == F.lit(b).cast("string"))
    return None


def selected_rows(rows: DataFrame, selections: DataFrame, selected_type: str) -> DataFrame:
    """P7 and P8 for a table of ids (``selected_id``): the rows of each id, tagged with it.

    A pair id is the first two parts between '-', joined on both columns; an
    id without a second part selects nothing, a repeated id its rows once.
    """
    ids = selections.select("selected_id").where("selected_id IS NOT NULL").distinct()
    if selected_type in S.SIMPLE_SELECTIONS:
        ids = ids.withColumn("_a", F.col("selected_id"))
        return rows.join(ids, rows[S.SIMPLE_SELECTIONS[selected_type]] == ids["_a"]).drop("_a")
    a_col, b_col = S.PAIR_SELECTIONS[selected_type]
    parts = F.split("selected_id", "-")
    ids = ids.withColumns({"_a": F.get(parts, F.lit(0)), "_b": F.get(parts, F.lit(1))})
    return rows.join(ids, (rows[a_col] == ids["_a"]) & (rows[b_col] == ids["_b"])).drop("_a", "_b")


def equals(col: str, value: str) -> Column:  # P9, P10
    return F.col(col) == F.lit(value)


@dataclass(frozen=True)
class LocusFilters:
    """Edge filters of a locus query (P3-P6), all optional."""

    must_haves: tuple[str, ...] = ()
    score: tuple[float, float] | None = None
    r2: tuple[float, float] | None = None
    pvalue: tuple[float, float] | None = None

    def predicate(self) -> Column | None:
        out = None
        for c in (must_have(self.must_haves), score_range(self.score), r2_range(self.r2),
                  pvalue_range(self.pvalue)):
            if c is not None:
                out = c if out is None else out & c
        return out


def and_all(*cols: Column | None) -> Column:
    out = F.lit(True)
    for c in cols:
        if c is not None:
            out = out & c
    return out
