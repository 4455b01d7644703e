"""Annotation tables from Parquet or over JDBC.

The build functions take DataFrames, so the source only decides how the
tables are read. For JDBC the reads are split on a numeric column so that
one large table is not pulled through a single connection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GENE_TABLES = ["exon_transcript", "exon", "gene", "transcript", "seq_region"]
VARIATION_TABLES = ["variation", "variation_feature", "seq_region"]


def read_parquet_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(p) for name, p in paths.items()}


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                    partition_column: str | None = None, lower: int | None = None,
                    upper: int | None = None, num_partitions: int = 64) -> DataFrame:
    """One table over JDBC; with ``partition_column`` the read is split in ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions))
    return reader.load()
