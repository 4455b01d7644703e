"""Q8-Q10 wiring over the test tables: evidence -> transformed -> processed.

``Dataset`` is a lazily built bundle of DataFrames over one ``sf_dir``; no
stage runs until an action is called on what a query returns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from locusforge import fixtures as FX
from locusforge import schemas as S
from locusforge.functions import scores
from locusforge.operators import annotation as A
from locusforge.operators.locus import REST
from locusforge.operators.lookup import id_table
from locusforge.operators.processed import build_processed, chromosome_membership
from locusforge.plans.transform import transform


@dataclass
class Dataset:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def evidence(self) -> DataFrame:
        return FX.evidence(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        """Transformed evidence (Q7), keyed by ``idx``."""
        return transform(self.evidence, tissues=FX.FIXTURE_TISSUES)

    @cached_property
    def gene_dim(self) -> DataFrame:
        return FX.gene_dim(self.spark, self.sf_dir)

    @cached_property
    def exon(self) -> DataFrame:
        return FX.exon(self.spark, self.sf_dir)

    @cached_property
    def genes(self) -> DataFrame:
        """Gene lookup: dimension + sorted exon pairs."""
        return A.genes_from_dim(self.gene_dim, self.exon)

    @cached_property
    def lead_variant(self) -> DataFrame:
        return FX.lead_variant(self.spark, self.sf_dir)

    @cached_property
    def processed(self) -> DataFrame:
        return build_processed(self.raw, self.gene_dim, self.lead_variant)

    @cached_property
    def ids(self) -> DataFrame:
        """Id-keyed table of variants and lead variants."""
        return id_table(self.processed)

    @cached_property
    def membership(self) -> DataFrame:
        return chromosome_membership(self.processed)

    @cached_property
    def ranked_membership(self) -> DataFrame:
        """``membership`` with the ``row_hash`` that the single batch outputs order rows by, made before the lead join."""
        return chromosome_membership(build_processed(self.raw, self.gene_dim, self.lead_variant, rest=REST))

    # Ensembl-shaped annotation tables -> built dimensions (Q8, Q9)
    def built_genes(self) -> DataFrame:
        s, d = self.spark, self.sf_dir
        return A.build_genes(FX.ens_exon_transcript(s, d), FX.ens_exon(s, d), FX.ens_gene(s, d),
                             FX.ens_transcript(s, d), FX.ens_seq_region(s, d))

    def built_lead_variants(self) -> DataFrame:
        s, d = self.spark, self.sf_dir
        return A.build_lead_variants(self.raw, FX.variation(s, d), FX.variation_feature(s, d),
                                     FX.ens_seq_region(s, d))


def write_tables(raw: DataFrame, genes: DataFrame, leads: DataFrame, out_dir: str,
                 num_partitions: int | None = None) -> dict[str, str]:
    """Build and store the served tables (K2, K3, K4) and the id-keyed table.

    ``raw`` needs the row index ``idx`` (``build_from_file`` makes it). The
    processed table is written once; the chromosome layout and the id table
    are derived from the written one, so the joins are not recomputed and a
    lost executor only re-runs the stage that read the stored files.

    All tables go to a new folder under ``out_dir`` and are published together
    at the end: ``snapshot.served`` gives the former ones until then.
    """
    from locusforge.sources import snapshot

    paths = _write_tables(raw, genes, leads, snapshot.new_folder(out_dir), num_partitions)
    snapshot.publish(raw.sparkSession, out_dir, paths)
    return paths


def _write_tables(raw: DataFrame, genes: DataFrame, leads: DataFrame, folder: str,
                  num_partitions: int | None) -> dict[str, str]:
    import os

    from locusforge.operators import ranks
    from locusforge.sources import sinks

    if S.KEY not in raw.columns:
        raise ValueError(f"the evidence has no row index {S.KEY!r}; see build_from_file")
    spark = raw.sparkSession
    paths = {name: os.path.join(folder, name)
             for name in ("processed", "by_chrom", "genes", "lead_variants", "ids", "ranks")}
    # Both dimensions are stored first: the joins then read small stored
    # tables instead of recomputing the exon roll-up or the lead-variant build.
    genes.write.mode("overwrite").parquet(paths["genes"])
    leads.write.mode("overwrite").parquet(paths["lead_variants"])
    sinks.write_joined(raw, spark.read.parquet(paths["genes"]), spark.read.parquet(paths["lead_variants"]),
                       paths["processed"], num_partitions)
    stored = spark.read.parquet(paths["processed"])
    sinks.write_by_chromosome(stored, paths["by_chrom"], num_partitions)
    sinks.write_id_table(id_table(stored), paths["ids"], num_partitions)
    ranks.write_rank_index(ranks.rank_index(stored), paths["ranks"])
    return paths


def build_from_file(spark: SparkSession, evidence_path: str, genes: DataFrame, leads: DataFrame, out_dir: str,
                    tissues: Sequence[str] = S.GTEX_TISSUES, terms: scores.TermPairs | None = None,
                    num_partitions: int | None = None) -> dict[str, str]:
    """From the evidence file to the served tables: read, transform, index, join, write.

    The file needs no index column and is parsed once: the transformed rows are
    stored as the scan gives them and numbered from the stored blocks, from 0
    without gaps, as they stand in the files (``evidence.write_numbered``). They
    are published (``transformed``) with the tables built from them.
    """
    import os

    from locusforge.session import scratch_path
    from locusforge.sources import evidence as E
    from locusforge.sources import snapshot

    folder = snapshot.new_folder(out_dir)

    rows = E.read_evidence(spark, evidence_path, tissues, add_places=True)
    kept = transform(rows, tissues, terms, also=(E.FILE, E.BLOCK))
    path = E.write_numbered(kept, os.path.join(folder, "transformed"), scratch_path(spark, "scanned"))
    raw = E.read_transformed(spark, path)
    paths = {"transformed": path, **_write_tables(raw, genes, leads, folder, num_partitions)}
    snapshot.publish(spark, out_dir, paths)
    return paths
