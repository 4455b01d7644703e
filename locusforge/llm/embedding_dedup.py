"""Embedding near-duplicates by p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine of 0.98 is a Euclidean distance of 0.2.
Every table quantises PROJECTIONS random projections of a vector (normal
deviates, which are 2-stable) to cells of WIDTH; vectors that agree in all
cells of a table share a bucket there, and the cosine of all that share one is
computed in double precision. Two vectors at distance 0.2 share a cell with
probability 0.90, a bucket with 0.23 and some bucket of the TABLES tables with
0.985; closer ones meet more surely. Vectors at right angles share a bucket
once in 280,000.

Equal vectors are one class from the start, whatever their number. No pair
leaves a task: a pair is counted in the first table in which it meets, and what
comes out of a bucket is a number of links per vector and at most one link per
vector that keeps the bucket's components together. A bucket of any size is cut
in blocks, and blocks meet two by two, so none of its pairs is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusforge.llm.common import bounded_batches, stored, table
from locusforge.llm.components import connected_components

COSINE = 0.98
TABLES = 16
PROJECTIONS = 14
WIDTH = 1.6
SEED = 11
# Vectors of a bucket that are compared at a time with as many others.
BLOCK = 512
# Rows of one bucket or class meet what is known of it in so many parts.
PARTS = 16


# --- hashing --------------------------------------------------------------
def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so no square over- or underflows."""
    out = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def bucket_keys(units: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS,
                width: float = WIDTH) -> np.ndarray:
    """(rows, tables): the key of each vector's bucket, the same in every task."""
    rng = np.random.RandomState(SEED)
    axes = rng.standard_normal((units.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    mixers = rng.randint(1, 1 << 62, (tables, projections)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor((units @ axes + shift) / width).astype(np.int64).view(np.uint64)
    return (cells.reshape(len(units), tables, projections) * mixers).sum(axis=2, dtype=np.uint64).view(np.int64)


def _hashed(tables: int, projections: int, width: float):
    """Adds dim and keys to classes; vectors of one length are hashed together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            keys = np.empty((len(sizes), tables), dtype=np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                keys[own] = bucket_keys(normalised(flat[starts[own][:, None] + np.arange(size)]),
                                        tables, projections, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()),
                                             pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), lists],
                                             [*batch.schema.names, "dim", "keys"])
    return run


# --- comparing ------------------------------------------------------------
def _labels(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def near_pairs(units: np.ndarray, keys: np.ndarray, table_number: int, side: np.ndarray | None,
               cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that are near and share no bucket of an earlier table.

    ``side`` tells the two blocks apart where only pairs across them are wanted.
    """
    if side is None:
        left, right = np.nonzero(np.triu(units @ units.T >= cosine, 1))
    else:
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = np.nonzero(units[a] @ units[b].T >= cosine)
        left, right = a[left], b[right]
    new = np.ones(len(left), dtype=bool)
    for t in range(table_number):
        new &= keys[left, t] != keys[right, t]
    return left[new], right[new]


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            node, block, n, vectors, keys = lists.flatten().flatten()
            node, block, n = (x.to_numpy(zero_copy_only=False) for x in (node, block, n))
            dims = batch.column("dim").to_pylist()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            keys = keys.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            at, out = 0, []
            for begin, end, dim, t, i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), dims,
                                                *(batch.column(c).to_pylist() for c in ("t", "i", "j"))):
                size = end - begin
                units = normalised(flat[at:at + size * dim].reshape(size, dim))
                at += size * dim
                side = None if i == j else block[begin:end] == j
                left, right = near_pairs(units, keys[begin:end], t, side, cosine)
                if len(left):
                    own = n[begin:end]
                    count = np.bincount(left, own[right], size) + np.bincount(right, own[left], size)
                    got = np.flatnonzero(count)
                    names = node[begin:end]
                    out.append((names[got], count[got].astype(np.int64), names[_labels(size, left, right)[got]]))
            merged = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else [()] * 3)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged], ["node", "links", "root"])
    return run


def _buckets(classes: DataFrame, block: int) -> DataFrame:
    """(label, dim, t, key, i, j, node, block): members of every pair of blocks that has to be compared."""
    bucket = ["label", "dim", "t", "key"]
    members = classes.select("node", "label", "dim", F.posexplode("keys").alias("t", "key"))
    sizes = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # A bucket with a third of all vectors meets its size in PARTS parts.
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part")
    sizes = sizes.select(*bucket, F.ceil(F.col("size") / block).cast("int").alias("blocks"),
                         F.explode(F.array(*[F.lit(p).cast("long") for p in range(PARTS)])).alias("part"))
    found = members.select("*", part).join(sizes, [*bucket, "part"])
    own = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (found.withColumn("block", own).withColumn("other", other)
            .select(*bucket, "node", "block", F.least("block", "other").alias("i"),
                    F.greatest("block", "other").alias("j")))


def found_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, links, root): per bucket, how many vectors each one is newly linked to and the least class it hangs with.

    ``classes``: node, label, dim, embedding, n (vectors in the class), keys.
    """
    group = ["label", "dim", "t", "key", "i", "j"]
    members = (_buckets(classes, block).join(classes.select("node", "n", "embedding", "keys"), "node")
               .groupBy(*group).agg(F.collect_list(F.struct("node", "block", "n", "embedding", "keys")).alias("members"))
               .where(F.size("members") > 1).select("dim", "t", "i", "j", "members"))
    return bounded_batches(members).mapInArrow(_compare(cosine), "node long, links long, root long")


# --- vectors --------------------------------------------------------------
def _vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, h1, h2, part); h1 and h2 are null where a vector links with nothing."""
    kind = rows.schema["embedding"].dataType
    if not isinstance(kind, T.ArrayType) or kind.elementType not in (T.FloatType(), T.DoubleType()):
        kind = T.ArrayType(T.DoubleType())
    rows = rows.select("vec_id", "label", F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return rows.select("*", F.when(good, F.xxhash64("label", "embedding")).alias("h1"),
                       F.when(good, F.xxhash64(F.lit(1), "label", "embedding")).alias("h2"),
                       F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)).alias("part"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES,
                    projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors`` (vec_id, label, embedding).

    Vectors are linked when their labels are equal and their cosine is at least
    ``cosine``; equal vectors always are. n_links counts the other rows linked
    directly, component_id is the smallest vec_id that links lead to, and kept
    says that it is the row's own.

    Rows without a label, and vectors that are null, empty, zero or hold null
    or non-finite components, link with nothing; vectors of different length do
    not either. A null vec_id is never the smallest, unless its component has
    no other: component_id is then null, and kept true. Rows that repeat a
    vec_id are vectors like any others. Further columns are not looked at; an
    empty table gives an empty result.
    """
    rows = _vectors(vectors)
    hashes = ["h1", "h2"]
    distinct = (rows.where(F.col("h1").isNotNull()).groupBy(*hashes, "label", "embedding")
                .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep")))
    schema = T.StructType([*distinct.schema.fields, T.StructField("dim", T.IntegerType()),
                           T.StructField("keys", T.ArrayType(T.LongType()))])
    hashed = bounded_batches(distinct).mapInArrow(_hashed(tables, projections, width), schema)
    # Numbers given while writing: unique in what was committed, whichever attempt that is.
    classes = stored(hashed.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = stored(found_links(classes, cosine, block), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select(*hashes, "node", "n", "rep").join(counts, "node", "left").join(roots, "node", "left")
    least = known.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("rep").alias("least"))
    results = known.join(least, "root", "left").select(
        *hashes, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    # A vector that a third of all rows hold takes its result in PARTS parts.
    parts = rows.where(F.col("h1").isNotNull()).select(*hashes, "part").distinct().join(results, hashes)
    out = rows.select("vec_id", *hashes, "part").join(parts, [*hashes, "part"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: its links, its component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
