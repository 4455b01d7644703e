"""Q7: the evidence transform (filters, derived scores, projection)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusforge import schemas as S
from locusforge.functions import scores
from locusforge.operators.filters import transform_predicate
from locusforge.session import compiled_methods


def nan_as_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN becomes NULL in the double columns among ``columns``."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: scores.missing_as_null(c) for c in columns if c in doubles})


def derive_scores(df: DataFrame, tissues: Sequence[str] = S.GTEX_TISSUES,
                  terms: scores.TermPairs | None = None) -> DataFrame:
    """Replace the tissue columns by ot_vep, gtex_max_tissue, gtex_max_value (C2-C4); NaN becomes NULL.

    The term list, the tissue array and its maximum are columns of their own
    steps, so each is computed once a row and the generated methods stay small.
    """
    values, parts, largest = "_tissues", "_terms", "gtex_max_value"
    kept = [c for c in df.columns if c not in set(tissues)]
    found = df.select(*kept, scores.term_list("vep_terms").alias(parts),
                      scores.tissue_values(list(tissues)).alias(values))
    found = nan_as_null(found, kept).withColumn(largest, scores.max_of_tissues(F.col(values)))
    tissue = scores.tissue_of_max(F.col(values), F.col(largest), list(tissues))
    return found.select(*kept, scores.ot_vep("vep_terms", terms, parts=F.col(parts)).alias("ot_vep"),
                        tissue.alias("gtex_max_tissue"), largest)


def transform(evidence: DataFrame, tissues: Sequence[str] = S.GTEX_TISSUES,
              terms: scores.TermPairs | None = None, key: str | None = S.KEY,
              also: Sequence[str] = ()) -> DataFrame:
    """Filter T3-T8, derive C2-C4, project the 30 output columns.

    ``key`` (when present in the input) is kept as the first column: it is the
    row identity every later stage orders and pages by. Missing numeric
    values (NaN) become NULL in every column, so they fail every comparison
    here and later. Empty input still yields the full output schema. Columns
    named in ``also`` are kept behind the others.
    """
    compiled_methods(evidence.sparkSession)
    keep = ([key] if key and key in evidence.columns else []) + S.TRANSFORMED_COLUMNS + list(also)
    return derive_scores(evidence.where(transform_predicate()), tissues, terms).select(*keep)
