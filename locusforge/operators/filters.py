"""Evidence filters T3-T8 and the one-pass filter funnel.

Each filter is a Column predicate, so Catalyst pushes them into the scan and
fuses them into one codegen stage; the funnel counts every stage in a single
aggregation instead of one job per stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import schemas as S
from locusforge.functions.scores import greater_than


def _gt(name: str, thr: float) -> Column:
    return greater_than(name, thr)


def gwas_source_ok(sources: Sequence[str] = S.VALID_GWAS_SOURCES) -> Column:  # T3
    return F.col("gwas_source").isin(list(sources))


def chromosomes_ok(chroms: Sequence[str] = S.TRANSFORM_CHROMOSOMES) -> Column:  # T4 + T5
    allowed = list(chroms)
    return F.col("GRCh38_chrom").isin(allowed) & F.col("GRCh38_gene_chrom").isin(allowed)


def same_chromosome() -> Column:  # T6
    return F.col("GRCh38_chrom") == F.col("GRCh38_gene_chrom")


def within_distance(max_distance: int = S.MAXIMUM_GENE_SNP_DISTANCE) -> Column:  # T7
    return F.abs(F.col("GRCh38_pos") - F.col("GRCh38_gene_pos")) <= F.lit(max_distance)


def evidence_gate(min_gtex: float = S.MINIMUM_GTEX_VALUE) -> Column:  # T8
    return (_gt("GTEx", min_gtex) | _gt("VEP", 0.0) | _gt("PCHiC", 0.0)
            | _gt("Fantom5", 0.0) | _gt("DHS", 0.0) | _gt("Nearest", 0.0))


STAGES: list[tuple[str, callable]] = [
    ("after_gwas_source", gwas_source_ok),
    ("after_chromosomes", chromosomes_ok),
    ("after_same_chromosome", same_chromosome),
    ("after_distance", within_distance),
    ("after_evidence_gate", evidence_gate),
]


def filter_gwas_source(df: DataFrame) -> DataFrame:
    return df.where(gwas_source_ok())


def filter_chromosomes(df: DataFrame) -> DataFrame:
    return df.where(chromosomes_ok())


def filter_same_chromosome(df: DataFrame) -> DataFrame:
    return df.where(same_chromosome())


def filter_distance(df: DataFrame) -> DataFrame:
    return df.where(within_distance())


def filter_evidence(df: DataFrame) -> DataFrame:
    return df.where(evidence_gate())


def transform_predicate() -> Column:
    """Conjunction of T3-T8 (the rows the transform keeps).

    A NULL predicate drops a row exactly like false, so no NULL handling is
    added: plain comparisons stay pushable into the Parquet scan.
    """
    out = None
    for _, stage in STAGES:
        out = stage() if out is None else out & stage()
    return out


def filter_funnel(df: DataFrame) -> DataFrame:
    """One row: input count and the count after each cumulative stage.

    ``count_if`` counts only true, so a NULL stage result counts as dropped.
    """
    aggs = [F.count(F.lit(1)).alias("input_rows")]
    cond = None
    for name, stage in STAGES:
        cond = stage() if cond is None else cond & stage()
        aggs.append(F.count_if(cond).alias(name))
    return df.agg(*aggs)
