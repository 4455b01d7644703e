"""What keeps the wide evidence rows cheap: methods that are compiled, one parse a value, joins by real size."""

import pytest
from pyspark.sql import functions as F

from locusforge import fixtures as FX
from locusforge.plans.transform import transform
from locusforge.sources import evidence as E

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.mark.parametrize("call", [
    lambda ds: transform(ds.spark.createDataFrame([], ds.evidence.schema), FX.FIXTURE_TISSUES),
    lambda ds: FX.evidence(ds.spark, ds.sf_dir),
    lambda ds: E.typed_evidence(ds.evidence.select(*[F.col(c).cast("string") for c in ds.evidence.columns]))])
def test_other_sessions_leave_no_method_interpreted(spark, ds, call):
    before = spark.conf.get(LIMIT)
    ds.evidence  # made before the session's setting is changed
    try:
        spark.conf.set(LIMIT, "65535")
        call(ds)
        assert spark.conf.get(LIMIT) == "8000"
        spark.conf.set(LIMIT, "500")
        call(ds)
        assert spark.conf.get(LIMIT) == "500"
    finally:
        spark.conf.set(LIMIT, before)


def test_a_value_is_parsed_once(spark):
    text = spark.createDataFrame([("463",), ("463.0",), ("1.2E7",), (None,), ("NA",)], "n string")
    c = E._clean("n", E.T.LongType(), ["NA", ""])
    plan = text.select(c.alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("decimal(38,6)") == 1
    assert [r.n for r in text.select(c.alias("n")).collect()] == [463, 463, 12_000_000, None, None]
    with pytest.raises(Exception, match="column n: not a bigint: 4.5"):
        spark.createDataFrame([("4.5",)], "n string").select(c).collect()


def test_lead_variants_are_not_taken_for_their_file(spark, tmp_path):
    """Four rows a part: a part table of 2 MB a plan may not broadcast the 3,000,000 rows made of it."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    rows = spark.range(800_000).select(*[(F.col("id") * 7919).cast(f.dataType).alias(f.name) if f.name == "p_partkey" else
                                         F.lit(1).cast(f.dataType).alias(f.name) for f in part.schema.fields])
    rows.write.parquet(str(tmp_path / "part.parquet"))
    leads = FX.lead_variant(spark, str(tmp_path))
    size = int(str(leads._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 10 << 20


def test_rows_in_order_are_the_evidence(ds):
    ordered = FX.evidence(ds.spark, ds.sf_dir, in_order=True)
    assert ordered.schema == ds.evidence.schema
    got = [tuple(r) for r in ordered.collect()]
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in ds.evidence.collect())
