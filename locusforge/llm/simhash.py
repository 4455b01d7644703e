"""SimHash near-duplicates by covering locality-sensitive hashing.

Documents whose 64-bit fingerprints differ in at most RADIUS bits are linked.
The masks come from a linear code: bit position i gets a non-zero vector c(i)
of RADIUS + 1 bits, and the mask of vector v keeps the positions whose c(i)
has odd overlap with v. At most RADIUS differing positions span less than the
whole space, so some v is orthogonal to all of them: its mask hides every
difference, and the pair meets in that table. No pair within the radius is
missed.

A bucket with too many fingerprints is cut again by masks of the same kind over
the positions that its mask left free. Two cuts leave at most 8 free positions,
so no bucket can then hold more than MAX_BUCKET = 2**8 distinct fingerprints:
nothing is sampled or capped, whatever the size of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusforge.llm.common import bounded_batches, bytes_of, join_documents, stored, table, text_of
from locusforge.llm.components import connected_components

BITS = 64
RADIUS = 3
SHINGLE = 3
# Fixed value: the seed of the shingle hash.
SEED = 42
MAX_BUCKET = 256
# Hashes whose bits are counted at a time.
CHUNK = 1 << 16


# --- fingerprints ---------------------------------------------------------
def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """SimHash of the whole text: a bit is set when over half the shingle hashes have it.

    Words are runs without ASCII white space, A-Z in lower case. With fewer
    words than a shingle the whole sequence is one; without words it is 0.
    """
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    else:
        spans = iter([(0, len(text))])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, dtype=np.int64)
    for begin in range(0, n, CHUNK):
        count = min(CHUNK, n - begin)
        hashes = np.fromiter((digest(text[a:b], SEED) for (a, b), _ in zip(spans, range(count))),
                             dtype="<u8", count=count)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist()))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, text_hash, print): the fingerprint of each row as a signed 64-bit value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(raw, size) for raw in batch.column("raw").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(prints.view(np.int64), pa.int64())],
                ["id", "text_hash", "print"])

    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash"),
                       bytes_of().alias("raw"))
    id_type = rows.schema["id"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"id {id_type}, text_hash long, print long")


# --- masks ----------------------------------------------------------------
def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are all hidden by some mask."""
    vectors = range(1, 1 << (radius + 1))
    code = {p: 1 + i % len(vectors) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (code[p] & v).bit_count() % 2) for v in vectors]


def finer_masks(mask: int) -> list[int]:
    """``mask`` grown by each covering mask over the positions it leaves free."""
    return sorted({mask | m for m in covering_masks([p for p in range(BITS) if not mask >> p & 1])})


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


# --- links ----------------------------------------------------------------
def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that keep each bucket's components together: at most one per fingerprint."""
    for batch in batches:
        left, right = [], []
        for prints in batch.column("prints").to_pylist():
            values = np.unique(np.array(prints, dtype=np.int64)).view(np.uint64)
            near = np.bitwise_count(values[:, None] ^ values[None, :]) <= RADIUS
            label = np.arange(len(values))
            while True:
                lower = np.where(near, label[None, :], len(values)).min(axis=1)
                if (lower == label).all():
                    break
                label = lower
            moved = np.flatnonzero(label != np.arange(len(values)))
            left.append(values[moved].view(np.int64))
            right.append(values[label[moved]].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (left, right)],
            ["a", "b"])


def _links_in(rows: DataFrame, max_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Links of the buckets of bounded size, and the rows of the larger ones.

    A bucket of two is compared by its smallest and largest fingerprint; only
    larger buckets are gathered.
    """
    bucket = ["mask", "key"]
    sizes = stored(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"),
                                             F.max("print").alias("b")).where("n > 1"), "simhash-buckets")
    pairs = (sizes.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
             .select("a", "b"))
    members = rows.join(sizes.where((F.col("n") > 2) & (F.col("n") <= max_bucket)).select(*bucket), bucket)
    gathered = (members.groupBy(*bucket).agg(F.collect_list("print").alias("prints")).select("prints")
                .mapInArrow(_bucket_links, "a long, b long"))
    large = rows.join(sizes.where(F.col("n") > max_bucket).select(*bucket), bucket)
    return pairs.unionByName(gathered), large


def links(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough for all components.

    ``prints`` has one row (print) per distinct fingerprint.
    """
    spark = prints.sparkSession
    masks = covering_masks(list(range(BITS)))

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.select("print", "mask", F.col("print").bitwiseAND(F.col("mask")).alias("key"))

    tables = F.array(*[F.lit(signed(m)) for m in masks])
    out, large = _links_in(bucketed(prints.select("print", F.explode(tables).alias("mask"))), max_bucket)
    for _ in range(2):
        large = stored(large.select("print", "mask"), "simhash-large")
        if large.isEmpty():
            break
        # A constant table: 15 finer masks for each mask of the level.
        cuts = spark.createDataFrame([(signed(m), signed(f)) for m in masks for f in finer_masks(m)],
                                     "mask long, finer long")
        cut = large.join(F.broadcast(cuts), "mask").select("print", F.col("finer").alias("mask")).distinct()
        found, large = _links_in(bucketed(cut), max_bucket)
        out = out.unionByName(found)
        masks = sorted({f for m in masks for f in finer_masks(m)})
    return out


# --- groups ---------------------------------------------------------------
def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, text_hash, print, component_id, component): one row per row of ``docs``.

    component is the smallest fingerprint of the group and component_id its
    smallest doc_id that is not null. Null and empty texts and texts of white
    space have fingerprint 0 and are linked like any other; exact copies share
    a fingerprint, so copies cost one row each and no pair. An empty table
    gives an empty result.
    """
    prints = stored(fingerprints(docs, size), "simhash-prints")
    distinct = stored(prints.groupBy("print").agg(F.min("id").alias("rep")), "simhash-distinct")
    linked = connected_components(links(distinct.select("print"))).withColumnRenamed("node", "print")
    known = distinct.join(linked, "print", "left").withColumn("component", F.coalesce("root", "print"))
    least = known.where(F.col("root").isNotNull()).groupBy("component").agg(F.min("rep").alias("least"))
    groups = (known.join(least, "component", "left")
              .select("print", "component",
                      F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")))
    return prints.join(groups, "print").select("id", "text_hash", "print", "component_id", "component")


def keep_representatives(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id.

    A null doc_id counts as smaller than any other; of equal doc_ids the text
    with the smaller hash stays, and of equal rows one. All columns, of any name,
    as they are.
    """
    keepers = (near_duplicates(docs, size).groupBy("component")
               .agg(F.min(F.struct("id", "text_hash")).alias("best"))
               .select("best.id", "best.text_hash"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash"))
    once = W.partitionBy("id", "text_hash").orderBy("text_hash")
    return (join_documents(rows, keepers).withColumn("copy", F.row_number().over(once)).where("copy = 1")
            .select("row.*"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint in hex and the smallest doc_id of its group."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
