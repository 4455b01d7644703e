"""The evidence transform (Q7) as a Structured Streaming job.

New evidence files landing in a directory are filtered, scored and appended
to a Parquet table. The transform is row-local (no state), so each
micro-batch is independent; the checkpoint (in the cluster's shared folder
by default) makes the job restartable after executor or driver loss with
exactly-once file output.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from locusforge import schemas as S
from locusforge.operators.filters import STAGES
from locusforge.plans.transform import transform
from locusforge.session import scratch_path
from locusforge.sources.evidence import read_delimited, typed_evidence


def read_evidence_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                         tissues: Sequence[str] = S.GTEX_TISSUES, max_files_per_trigger: int = 64,
                         with_key: bool = True) -> DataFrame:
    """Streaming evidence source: Parquet with the typed schema, or TSV text."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "parquet":
        schema = S.evidence_schema(list(tissues))
        if with_key:
            schema = T.StructType([T.StructField(S.KEY, T.LongType()), *schema.fields])
        return reader.schema(schema).parquet(source_dir)
    if fmt == "tsv":
        # CSV schemas apply by position: take the column names (all strings)
        # from the header of the files already present, then pick by name.
        text_schema = read_delimited(spark, source_dir).schema
        raw = reader.schema(text_schema).option("sep", "\t").option("header", True).csv(source_dir)
        return typed_evidence(raw, tissues, key_column=S.KEY if with_key else None)
    raise ValueError(fmt)


def start_transform_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                           checkpoint_dir: str | None = None, fmt: str = "parquet",
                           tissues: Sequence[str] = S.GTEX_TISSUES, available_now: bool = False,
                           processing_time: str = "1 minute") -> StreamingQuery:
    """Start the streaming transform; returns the running query."""
    stream = read_evidence_stream(spark, source_dir, fmt, tissues)
    out = transform(stream, tissues=tissues)
    ckpt = checkpoint_dir or scratch_path(spark, "transform-stream-checkpoint")
    writer = (out.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time)
    return writer.start()


def funnel_stream(stream: DataFrame) -> DataFrame:
    """Running filter funnel (A14) over a stream: one row, updated per batch.

    A global streaming aggregation keeps a single small state row.
    """
    aggs = [F.count(F.lit(1)).alias("input_rows")]
    cond = None
    for name, stage in STAGES:
        cond = stage() if cond is None else cond & stage()
        aggs.append(F.count_if(cond).alias(name))
    return stream.agg(*aggs)


def start_funnel_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                        checkpoint_dir: str | None = None, fmt: str = "parquet",
                        tissues: Sequence[str] = S.GTEX_TISSUES) -> StreamingQuery:
    """Run the funnel once over all available files; each batch's running
    totals are written by ``foreachBatch`` (complete output mode)."""
    counts = funnel_stream(read_evidence_stream(spark, source_dir, fmt, tissues))
    ckpt = checkpoint_dir or scratch_path(spark, "funnel-stream-checkpoint")

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # One folder per epoch, overwritten when the epoch is run again.
        batch.write.mode("overwrite").parquet(os.path.join(sink_dir, f"epoch={epoch}"))

    return (counts.writeStream.outputMode("complete").option("checkpointLocation", ckpt)
            .foreachBatch(write_batch).trigger(availableNow=True).start())
