"""Writers (K1-K4) and the matching readers of what they write.

Layouts are chosen for the read side at scale:

* processed (K2): range-partitioned and sorted by (disease, idx), so a
  disease table read skips files and row groups by min/max statistics;
* chromosome tables (K3): one directory per chromosome (partition pruning).
  Each row stores the least and greatest of its four positions; files are
  range-partitioned and sorted by how far these lie apart, then by the least.
  Rows of one span class that meet a window lie next to each other, so a few
  rows with a far lead variant do not spoil the statistics of all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusforge import schemas as S
from locusforge.operators.predicates import POSITIONS
from locusforge.operators.processed import build_processed, chromosome_membership, heavy_keys

PROCESSED_KEYS = ["disease_efo_id", S.KEY]
# Limits of the span classes of the chromosome layout, in bases: about a gene,
# a cis window, a chromosome arm, and all beyond.
SPAN_LIMITS = (250_000, 2_000_000, 32_000_000)
# Upper bound on rows per output file: a large range partition is written as
# several sorted files instead of one oversized file.
MAX_RECORDS_PER_FILE = 5_000_000


def write_transformed(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """K1: transformed evidence as Parquet (default) or gzipped TSV with header."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "tsv":
        (df.write.mode(mode).option("sep", "\t").option("header", True)
         .option("compression", "gzip").csv(path))
    else:
        raise ValueError(fmt)
    return path


def write_processed(df: DataFrame, path: str, num_partitions: int | None = None,
                    mode: str = "overwrite") -> str:
    """K2: processed table, clustered by (disease_efo_id, idx).

    ``num_partitions`` should be about table size / 512 MB on a cluster; the
    default is ``spark.sql.shuffle.partitions``.
    """
    (range_partitioned(df, PROCESSED_KEYS, num_partitions).sortWithinPartitions(*PROCESSED_KEYS)
     .write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(path))
    return path


def write_joined(raw: DataFrame, genes: DataFrame, leads: DataFrame, path: str,
                 num_partitions: int | None = None, mode: str = "overwrite") -> str:
    """K2 from its parts: the rows are range-partitioned before the joins.

    Range bounds come from a sample of the narrow raw rows, so no join runs
    for them, and the joins are evaluated once. Broadcast joins keep the
    ranges; where a dimension is too large for that, the rows are hashed again
    and only sorted inside each file. Lead variants that hold many rows are
    looked for first and split in that case.
    """
    ranged = range_partitioned(raw, PROCESSED_KEYS, num_partitions)
    heavy = heavy_keys(raw, "gwas_snp", num_partitions)
    (build_processed(ranged, genes, leads, heavy).sortWithinPartitions(*PROCESSED_KEYS)
     .write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(path))
    return path


def range_partitioned(df: DataFrame, keys: list[str | Column], num_partitions: int | None) -> DataFrame:
    return df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)


def write_id_table(ids: DataFrame, path: str, num_partitions: int | None = None, mode: str = "overwrite") -> str:
    """The id-keyed table, sorted by id and with a bloom filter on it: one lookup reads few row groups."""
    (range_partitioned(ids, ["id"], num_partitions).sortWithinPartitions("id").write.mode(mode)
     .option("parquet.bloom.filter.enabled#id", "true").parquet(path))
    return path


def write_by_chromosome(processed: DataFrame, path: str, num_partitions: int | None = None,
                        mode: str = "overwrite") -> str:
    """K3: one partition directory per chromosome table, rows sorted by span class and position.

    A row is written once per table it belongs to (gene, variant or lead
    chromosome), exactly the overlapping per-chromosome tables. Unknown
    positions are left out of a row's envelope; with none known it is null.
    """
    positions = [F.col(p) for p in POSITIONS]
    rows = chromosome_membership(processed).select(
        "*", F.least(*positions).alias(S.FIRST_POS), F.greatest(*positions).alias(S.LAST_POS))
    span = F.col(S.LAST_POS) - F.col(S.FIRST_POS)
    span_class = sum((F.when(span > F.lit(limit), 1).otherwise(0) for limit in SPAN_LIMITS), F.lit(0))
    # idx breaks ties, so even one position holding a third of all rows is
    # spread over several range partitions.
    keys = ["chrom", span_class, S.FIRST_POS, S.KEY]
    (range_partitioned(rows, keys, num_partitions).sortWithinPartitions(*keys)
     .write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("chrom").parquet(path))
    return path


def read_by_chromosome(spark: SparkSession, path: str) -> DataFrame:
    """Read the K3 layout with ``chrom`` as a string partition column."""
    df = spark.read.option("basePath", path).parquet(path)
    return df.withColumn("chrom", F.col("chrom").cast(T.StringType()))


def write_gene_lookup(genes: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K4: gene lookup as JSON lines keyed by gene_id, exons as [[start, end], ...]."""
    exons = F.transform("exons", lambda e: F.array(e["start"], e["end"]))
    (genes.select("gene_id", "description", "tss", "chr", F.col("gene_start").alias("start"),
                  F.col("gene_end").alias("end"), "fwdstrand", exons.alias("exons"))
     .write.mode(mode).json(path))
    return path


GENE_LOOKUP_SCHEMA = T.StructType([
    T.StructField("gene_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tss", T.LongType()),
    T.StructField("chr", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("fwdstrand", T.BooleanType()),
    T.StructField("exons", T.ArrayType(T.ArrayType(T.LongType()))),
])


def read_gene_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Read K4 back into the gene lookup shape used by the locus queries."""
    df = spark.read.schema(GENE_LOOKUP_SCHEMA).json(path)
    pairs = F.transform("exons", lambda e: F.struct(e[0].alias("start"), e[1].alias("end")))
    return df.select("gene_id", "description", "tss", "chr", F.col("start").alias("gene_start"),
                     F.col("end").alias("gene_end"), "fwdstrand", pairs.alias("exons"))
