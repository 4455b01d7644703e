"""Session defaults and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults that matter for every job of the library. Shuffle partitions are
# left to the caller (cluster size decides them); AQE coalesces small ones.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Fall back from whole-stage codegen when a generated method exceeds the
    # JIT's own size limit (it would otherwise run interpreted).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "locusforge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.driver.host", "127.0.0.1")
                       .config("spark.driver.bindAddress", "127.0.0.1"))
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for materialised intermediate data.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint directory).
    Only a ``local[..]`` master may leave both unset: a temporary folder then
    becomes the checkpoint directory and goes when the process ends. On a
    cluster every executor would write to a disk of its own, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = ""
    if not path:
        try:
            master = spark.sparkContext.master
            path = spark.sparkContext.getCheckpointDir()
        except Exception:  # no SparkContext on this client (e.g. Spark Connect)
            path = None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="locusforge-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _scratch.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders handed out so far; how many were there.

    For the end of a job: results that still read from them must have been
    written or collected before.
    """
    removed = 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def compiled_methods(spark: SparkSession) -> None:
    """Ask the session to run no whole-stage method that the JIT leaves interpreted (over 8,000 bytes).

    Stages of the wide evidence rows have such methods; Spark then runs these
    operator by operator, each in compiled methods. Sessions of ``get_spark``
    have it anyway; a smaller limit of the session is left as it is.
    """
    key, most = "spark.sql.codegen.hugeMethodLimit", SESSION_DEFAULTS["spark.sql.codegen.hugeMethodLimit"]
    if int(spark.conf.get(key, "65535")) > int(most):
        spark.conf.set(key, most)


_scratch: list[str] = []
