import os

from locusforge import fixtures as FX
from locusforge.operators.filters import filter_funnel
from locusforge.session import scratch_path
from locusforge.streaming.transform_stream import start_funnel_stream, start_transform_stream


def test_streaming_transform_equals_batch(spark, ds):
    src = scratch_path(spark, "stream-src")
    # the evidence arrives as several files
    ds.evidence.repartition(3).write.parquet(src)
    sink = scratch_path(spark, "stream-sink")
    q = start_transform_stream(spark, src, sink, tissues=FX.FIXTURE_TISSUES, available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    assert got.count() == ds.raw.count()
    assert got.exceptAll(ds.raw).count() == 0 and ds.raw.exceptAll(got).count() == 0


def test_streaming_funnel(spark, ds):
    src = scratch_path(spark, "stream-src2")
    ds.evidence.repartition(4).write.parquet(src)
    sink = scratch_path(spark, "funnel-sink")
    q = start_funnel_stream(spark, src, sink, tissues=FX.FIXTURE_TISSUES)
    q.awaitTermination(300)
    last = spark.read.parquet(sink).orderBy("epoch", ascending=False).first().asDict()
    last.pop("epoch")
    assert last == filter_funnel(ds.evidence).first().asDict()
    assert os.path.isdir(sink)


def test_streaming_tsv_source(spark, ds):
    src = scratch_path(spark, "stream-tsv")
    # header order differs from the schema order: columns are matched by name
    cols = list(reversed(ds.evidence.columns))
    (ds.evidence.select(*cols).repartition(2).write.option("sep", "\t").option("header", True)
     .csv(src))
    sink = scratch_path(spark, "stream-tsv-sink")
    q = start_transform_stream(spark, src, sink, fmt="tsv", tissues=FX.FIXTURE_TISSUES,
                               available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    assert got.exceptAll(ds.raw).count() == 0 and ds.raw.exceptAll(got).count() == 0


def test_streaming_restart_from_checkpoint(spark, ds):
    """A restarted job resumes from its checkpoint: each input file is
    transformed exactly once, and the result equals the batch transform."""
    from pyspark.sql import functions as F
    src = scratch_path(spark, "stream-restart-src")
    sink = scratch_path(spark, "stream-restart-sink")
    ckpt = scratch_path(spark, "stream-restart-ckpt")
    ev = ds.evidence
    ev.where(F.col("idx") % 2 == 0).repartition(2).write.parquet(src)
    start_transform_stream(spark, src, sink, ckpt, tissues=FX.FIXTURE_TISSUES,
                           available_now=True).awaitTermination(300)
    first = spark.read.parquet(sink).count()
    # new files arrive; the job is started again on the same checkpoint
    ev.where(F.col("idx") % 2 == 1).repartition(2).write.mode("append").parquet(src)
    start_transform_stream(spark, src, sink, ckpt, tissues=FX.FIXTURE_TISSUES,
                           available_now=True).awaitTermination(300)
    got = spark.read.parquet(sink)
    assert 0 < first < got.count() == ds.raw.count()
    assert got.exceptAll(ds.raw).count() == 0 and ds.raw.exceptAll(got).count() == 0
