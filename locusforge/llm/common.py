"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.session import scratch_path

BATCH_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bytes_of(column: str = "text") -> Column:
    """The UTF-8 bytes of the text; null counts as empty."""
    return text_of(column).cast("binary")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` also changes letters beyond ASCII, so it serves only texts that
    have none (as many bytes as characters); others are translated.
    """
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def with_key(docs: DataFrame) -> DataFrame:
    """(id, text_hash, text): what a decision about a document is keyed by.

    Rows that share doc_id and text are one document; a repeated doc_id with
    another text is told apart by the hash of its text. All other columns go.
    """
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash"),
                       text_of().alias("text"))


def join_documents(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the key of ``with_key``, which is kept once; a null doc_id equals null."""
    right = right.withColumnsRenamed({"id": "_right_id", "text_hash": "_right_hash"})
    same = (F.col("text_hash") == F.col("_right_hash")) & F.col("id").eqNullSafe(F.col("_right_id"))
    return left.join(right, same, how).drop("_right_id", "_right_hash")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, after the session was asked for Arrow batches of at most BATCH_BYTES.

    Spark bounds batches by rows only, unless told otherwise; ten thousand
    long texts would take the memory of a worker and as much beside the heap.
    A smaller bound of the session is left as it is.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None) or ""
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows that stand for files over all shuffle partitions.

    Such rows are small and their work is not, so the number is given: Spark
    would otherwise put them together by size, down to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def per_process(key, build):
    """``build()``, made once in each Python process.

    Functions reach the workers by value, so what they keep in globals lasts
    one task; what is kept here lasts as long as the worker.
    """
    import sys
    import types
    kept = sys.modules.setdefault("_locusforge_kept", types.ModuleType("_locusforge_kept")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def slices(batch, column: str, most_bytes: int = 1 << 20):
    """Slices of an Arrow batch of at most so many bytes in a string or binary column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def open_shared(path: str, mode: str):
    """Open a file of the shared folder in a Python worker ("rb" or "wb"), wherever that folder is."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        store, inner = fs.LocalFileSystem(), path
    elif path.startswith("file:"):
        store, inner = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, inner = fs.FileSystem.from_uri(path)
    if mode == "rb":
        return store.open_input_file(inner)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner, compression=None)
