import math

import pytest
from pyspark.sql import functions as F

from locusforge import schemas as S
from locusforge.functions import scores


@pytest.mark.parametrize("terms,expected", [
    ("missense_variant", 0.7),
    ("intergenic_variant", 0.0),                  # 0.5 is below the minimum
    ("intron_variant", 0.65),                     # minimum is inclusive
    ("upstream_gene_variant,unknown_term", 0.0),  # unknown terms ignored
    ("unknown,stop_gained", 0.95),
    ("intron_variant, stop_gained", 0.65),        # no trimming after the comma
    ("", 0.0),
    (None, 0.0),
])
def test_ot_vep(spark, terms, expected):
    df = spark.createDataFrame([(terms,)], "vep_terms string")
    assert df.select(scores.ot_vep("vep_terms")).first()[0] == expected


def test_ot_vep_custom_terms(spark):
    df = spark.createDataFrame([("a,b",), ("c",)], "vep_terms string")
    got = [r[0] for r in df.select(scores.ot_vep("vep_terms", [("a", 0.7), ("b", 0.9)])).collect()]
    assert got == [0.9, 0.0]


def test_gtex_max_first_column_wins_and_missing(spark):
    cols = ["t0", "t1", "t2"]
    df = spark.createDataFrame(
        [(0.2, 0.9, 0.9), (None, None, None), (float("nan"), 0.1, None), (0.3, None, 0.3)],
        "t0 double, t1 double, t2 double")
    rows = df.select(scores.gtex_max_tissue(cols).alias("t"), scores.gtex_max_value(cols).alias("v")).collect()
    assert [(r.t, r.v) for r in rows] == [("t1", 0.9), (None, None), ("t1", 0.1), ("t0", 0.3)]


def test_g2v_score_phases(spark):
    df = spark.createDataFrame([
        ("stop_gained", 0.0, 0.0, 0.0, 0.0, 0.0),          # phase 1
        ("intergenic_variant", 0.99999, 0.0, 1.0, 0.0, 0.0),  # phase 2: GTEx + Fantom5
        (None, 0.5, 0.0, 0.0, 0.0, 1.0),                   # phase 3
        (None, 0.999975, 0.0, 0.0, 0.0, 0.0),              # GTEx at threshold: nothing
    ], "vep_terms string, GTEx double, PCHiC double, Fantom5 double, DHS double, Nearest double")
    rows = scores.with_g2v_score(df).select("ot_g2v_score", "ot_g2v_score_reason").collect()
    vep_score = (0.95 - S.MINIMUM_VEP_VALUE) * ((1.0 - 0.9) / (1 - S.MINIMUM_VEP_VALUE)) + 0.9
    fg = (0.99999 * 13.0 + 1.0 * 3.0) / 19.0
    assert math.isclose(rows[0][0], vep_score) and rows[0][1] == "1:VEP"
    assert math.isclose(rows[1][0], fg * 0.4 + 0.5) and rows[1][1] == "2:GTEx;Fantom5"
    assert rows[2][0] == 0.5 and rows[2][1] == "3:Nearest"
    assert rows[3][0] == 0.0 and rows[3][1] == ""


def test_g2v_drop_zero(spark):
    df = spark.createDataFrame([(None, 0.0, 0.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0, 0.0, 1.0)],
                               "vep_terms string, GTEx double, PCHiC double, Fantom5 double, DHS double, "
                               "Nearest double")
    assert scores.with_g2v_score(df, drop_zero=True).count() == 1


def test_composite_id_and_log(spark):
    df = spark.createDataFrame([("a", "b", 1e-8), ("a", None, 0.0), (None, "b", None)],
                               "x string, y string, p double")
    rows = df.select(scores.composite_id("x", "y").alias("id"), scores.neg_log10("p").alias("l")).collect()
    assert rows[0].id == "a-b" and math.isclose(rows[0].l, 8.0)
    assert rows[1].id is None and rows[1].l is None
    assert rows[2].id is None and rows[2].l is None


def test_strand_and_tss(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,)], "s int")
    fwd = scores.forward_strand("s")
    rows = df.select(fwd.alias("f"), scores.tss(F.lit(10), F.lit(20), fwd).alias("t")).collect()
    assert [(r.f, r.t) for r in rows] == [(True, 10), (False, 20), (None, 20)]
