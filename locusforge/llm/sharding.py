"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a
ring table, and going from n to n + 1 shards moves a row only into the new
shard. Rows are numbered from 0 without gaps inside their shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusforge.llm.common import text_of

# Fixed value: the multiplier of the published jump hash.
JUMP_MULTIPLIER = np.uint64(2862933555777941757)

N_SHARDS = 16
# Rows of a shard are numbered block by block, so no task sees a whole shard.
N_BLOCKS = 1024


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each 64-bit key; every round moves the keys still below n."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    active = np.arange(len(state))
    while len(active):
        shard[active] = jump[active]
        state[active] = state[active] * JUMP_MULTIPLIER + np.uint64(1)
        draw = (state[active] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[active] = np.floor((shard[active] + 1) * (2.0 ** 31 / draw)).astype(np.int64)
        active = active[jump[active] < n_shards]
    return shard


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard column for a key of any type (null is a key like any other)."""
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64), n_shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(rows: DataFrame, key: str, n_shards: int = N_SHARDS) -> DataFrame:
    """``rows`` with (shard, grown_shard, slot) appended.

    grown_shard is the shard with one shard more. Slots run from 0 without
    gaps in each shard: rows are numbered inside (shard, block) after the
    counts of the earlier blocks. The table of counts has n_shards x N_BLOCKS
    rows at most, whatever the input, and so may be broadcast. The block is a
    hash of the key and of all columns that can be ordered, so rows of one key
    (or none) that differ are spread over the blocks of their shard. An empty
    table gives an empty result. Columns of ``rows`` named shard, grown_shard
    or slot are replaced; others, of any name, stay.
    """
    rows = rows.drop("shard", "grown_shard", "slot")
    order = [c for c in rows.columns if c != key and not isinstance(rows.schema[c].dataType, _unorderable())]
    columns = [F.col(f"row.`{c}`") for c in [key, *order]]
    placed = rows.select(F.struct("*").alias("row")).select(
        "row", shard_of(columns[0], n_shards).alias("shard"), shard_of(columns[0], n_shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(N_BLOCKS)).cast("int").alias("block"))
    counts = placed.groupBy("shard", "block").count()
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "block").orderBy(*columns)
    return (placed.withColumn("place", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), ["shard", "block"])
            .select("row.*", "shard", "grown_shard", (F.col("start") + F.col("place")).cast("long").alias("slot")))


def _unorderable() -> tuple:
    """Types that neither sort nor hash; a column that holds one inside another type is not looked for."""
    from pyspark.sql.types import MapType, VariantType
    return MapType, VariantType


def op7_jump_hash_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by doc_id (law ``key``).

    A null text has size 1 and checksum 0; a null doc_id has its own fixed
    shard; equal rows get different slots.
    """
    from locusforge.llm.common import table
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return assign_shards(sized, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
