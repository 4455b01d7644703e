"""Q10: evidence joined to gene and lead-variant coordinates (J1, J2), and
chromosome-table membership (K3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import schemas as S
from locusforge.session import compiled_methods

PROCESSED_EXTRA = [S.GENE_START, S.GENE_END, S.LEAD_CHROM, S.LEAD_POS]


# Keys that the sketch keeps track of; its counts are off by a few rows in so many.
TRACKED = 65_536
# A key is split when it holds more rows than so many tasks do on average.
HEAVY_TASKS = 4
# Parts made of a heavy key for each task it would fill: hashed parts meet in
# one task by chance, and small ones even out.
PARTS_A_TASK = 4


def heavy_keys(rows: DataFrame, key: str, num_partitions: int | None = None) -> dict[str, int]:
    """Keys that would make a task of a shuffle far too large, and into how many parts to split each.

    A frequent-items sketch (partial aggregates of bounded size, one row in the
    end) gives the candidates. With p partitions a key is heavy from HEAVY_TASKS
    / p of the rows on, so fewer than p / HEAVY_TASKS keys come to the driver.
    Runs one job over one column. A null key joins nothing and is left out.
    """
    parts = num_partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(parts // HEAVY_TASKS, 1000))
    found = rows.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return {item["item"]: -(-item["count"] * parts // found["n"]) for item in found["top"] or []
            if item["count"] * parts > HEAVY_TASKS * found["n"]}


def _split_join(rows: DataFrame, side: DataFrame, key: str, heavy: dict[str, int]) -> DataFrame:
    """``rows`` LEFT JOIN ``side`` ON ``key``; rows of a heavy key are dealt over its parts by their index.

    The rows of ``side`` with a heavy key are repeated once a part, all others stand once.
    """
    pairs = [F.lit(v) for k, n in sorted(heavy.items()) for v in (k, n * PARTS_A_TASK)]
    parts = F.coalesce(F.create_map(*pairs)[F.col(key)], F.lit(1)) if pairs else F.lit(1)
    dealt = rows.withColumn(PART, F.pmod(F.xxhash64(S.KEY), parts).cast("int"))
    copies = side.withColumn(PART, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [key, PART], "left").drop(PART)


PART = "_heavy_part"


def row_hash(columns: Sequence[str]) -> Column:
    """A hash of what a row holds beside its place in the row order: it decides between rows of equal place."""
    return F.xxhash64(*[c for c in columns if c not in (*S.ROW_ORDER, "chrom", S.FIRST_POS, S.LAST_POS)])


def build_processed(raw: DataFrame, genes: DataFrame, leads: DataFrame,
                    heavy: dict[str, int] | None = None, rest: str | None = None) -> DataFrame:
    """raw LEFT JOIN gene ON gene_id LEFT JOIN lead_variant ON gwas_snp.

    Spark decides from the sizes it knows or measures whether a dimension is
    broadcast or both sides are shuffled, and splits skewed keys. The lead
    join fans out: a lead variant with two mappings duplicates its rows. The
    lead variants of ``heavy`` (``heavy_keys``) are split on purpose: AQE splits
    only partitions that it finds large before the fan-out. ``rest`` names a
    column for the ``row_hash`` of the result; it is made before the lead join,
    whose shuffle then takes only the columns that are read after it.
    """
    compiled_methods(raw.sparkSession)
    g = genes.select("gene_id", F.col("gene_start").alias(S.GENE_START),
                     F.col("gene_end").alias(S.GENE_END))
    lv = leads.select("gwas_snp", F.col("seq_region_name").alias(S.LEAD_CHROM),
                      F.col("position").alias(S.LEAD_POS))
    out = raw.join(g, "gene_id", "left")
    if rest:
        out = out.withColumn(rest, row_hash([*raw.columns, S.GENE_START, S.GENE_END]))
    out = _split_join(out, lv, "gwas_snp", heavy) if heavy else out.join(lv, "gwas_snp", "left")
    return out.select(*raw.columns, *PROCESSED_EXTRA, *([rest] if rest else []))


def chromosome_membership(processed: DataFrame,
                          chromosomes: Sequence[str] = S.BUILD_CHROMOSOMES) -> DataFrame:
    """K3: one copy of each row per chromosome table it belongs to, as ``chrom``.

    A row belongs to chromosome c when its gene, variant or lead-variant
    chromosome is c; only the 24 table chromosomes are kept ('0', 'MT' and
    patches have no table).
    """
    member = F.explode(F.array_distinct(F.array(
        F.col("GRCh38_gene_chrom"), F.col("GRCh38_chrom"), F.col(S.LEAD_CHROM))))
    return (processed.select("*", member.alias("chrom"))
            .where(F.col("chrom").isin(list(chromosomes))))


def one_copy(source: DataFrame, chromosomes: Sequence[str] = S.BUILD_CHROMOSOMES) -> DataFrame:
    """The rows behind ``source`` once each: of the chromosome layout's copies the first table's."""
    if "chrom" not in source.columns:
        return source
    tables = F.filter(F.array(F.col("GRCh38_gene_chrom"), F.col("GRCh38_chrom"), F.col(S.LEAD_CHROM)),
                      lambda c: c.isin(list(chromosomes)))
    return source.where(F.col("chrom") == F.get(tables, F.lit(0))).drop("chrom", S.FIRST_POS, S.LAST_POS)


def chromosome_table(source: DataFrame, chrom: str) -> DataFrame:
    """Rows of one chromosome table.

    ``source`` is either the partitioned layout (has ``chrom``; the filter
    prunes partitions) or the processed table (membership predicate).
    """
    from locusforge.operators.predicates import check_chromosome, chromosome_member
    if "chrom" in source.columns:
        return source.where(F.col("chrom") == F.lit(check_chromosome(chrom))).drop("chrom", S.FIRST_POS, S.LAST_POS)
    return source.where(chromosome_member(chrom))
