"""Evidence-shaped tables derived from the TPC-H-style test tables.

Each column is one SQL expression in the subset shared by Spark SQL and
DuckDB, so the Spark side (``selectExpr``) and the oracle SQL build exactly
the same input. Doubles are written as ``1e0``-style literals on purpose:
``0.9`` is a DECIMAL in both engines.

Tables (FIXTURES.md section B):
  evidence      lineitem x orders x part, one row per line item
  gene_dim      part (gene coordinates and strand)
  exon          distinct (part, line number) of lineitem
  lead_variant  part x {b} x {alt} (lead-variant mappings, with fan-out)
plus Ensembl-shaped annotation tables (gene, transcript, exon,
exon_transcript, seq_region, variation, variation_feature) from which the
gene and lead-variant dimensions are *built* by the annotation operators.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.session import compiled_methods

N_TISSUES = 44
FIXTURE_TISSUES = [f"GTEx_t{i:02d}" for i in range(N_TISSUES)]

# Default locus window (non-empty at every scale).
DEFAULT_LOCUS = ("7", 3000000, 12000000)


def chr_sql(e: str) -> str:
    """Chromosome name of an integer expression (0..22, X, Y, MT)."""
    return (f"CASE WHEN ({e})%26=23 THEN 'X' WHEN ({e})%26=24 THEN 'Y' "
            f"WHEN ({e})%26=25 THEN 'MT' ELSE CAST(({e})%26 AS STRING) END")


_K = "(l_partkey*4+l_linenumber%4)"
_G = "(l_partkey*2+l_orderkey%2)"
_GP_L = "(2000000+(l_partkey*48271)%100000000)"
_GP_P = "(2000000+(p_partkey*48271)%100000000)"

EVIDENCE_COLUMNS: list[tuple[str, str]] = [
    ("idx", "(((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey)*100"
            "+CAST(l_quantity AS BIGINT)"),
    ("ld_snp_rsID", f"CONCAT('rs',CAST({_K} AS STRING))"),
    ("GRCh38_chrom", f"CASE WHEN {_K}%11=0 THEN {chr_sql('l_partkey+1')} "
                     f"ELSE {chr_sql('l_partkey')} END"),
    ("GRCh38_pos", f"{_GP_L}+(({_K}*7919)%2400001)-1200000"),
    ("gene_symbol", "p_name"),
    ("gene_id", "CONCAT('ENSG',CAST(l_partkey AS STRING))"),
    ("GRCh38_gene_chrom", chr_sql("l_partkey")),
    ("GRCh38_gene_pos", _GP_L),
    ("disease_name", "CONCAT('disease ',CAST(o_custkey%50 AS STRING))"),
    ("disease_efo_id", "CONCAT('EFO_',CAST(o_custkey%50 AS STRING))"),
    ("score", "1e1*l_discount"),
    ("r2", "6e-1+4e0*l_tax"),
    ("gwas_source", "CASE WHEN o_orderpriority='5-LOW' THEN 'GRASP' ELSE 'GWAS Catalog' END"),
    ("gwas_snp", f"CONCAT('rs',CAST({_G} AS STRING))"),
    ("gwas_pvalue", "l_quantity*1e-9"),
    ("gwas_odds_ratio", "CASE WHEN l_linenumber%2=0 THEN 1e0+l_tax END"),
    ("gwas_beta", "CASE WHEN l_linenumber%2=1 THEN l_tax END"),
    ("gwas_size", "CAST(l_quantity*1e3 AS BIGINT)"),
    ("gwas_pmid", "CONCAT('PMID',CAST(l_orderkey%100 AS STRING))"),
    ("gwas_study", "CONCAT('GCST',CAST(l_orderkey%200 AS STRING))"),
    ("vep_terms", "CASE l_suppkey%5 WHEN 1 THEN 'intergenic_variant' "
                  "WHEN 2 THEN 'intron_variant,missense_variant' "
                  "WHEN 3 THEN 'upstream_gene_variant,unknown_term' "
                  "WHEN 4 THEN 'stop_gained,intron_variant' END"),
    ("GTEx", "CASE l_returnflag WHEN 'R' THEN 9.9998e-1+l_discount*1e-4 WHEN 'A' THEN 5e-1 END"),
    ("VEP", "CASE WHEN l_suppkey%5 IN (2,4) THEN 1e0 ELSE 0e0 END"),
    ("Fantom5", "CASE WHEN l_suppkey%7=0 THEN 1e0 ELSE 0e0 END"),
    ("DHS", "CASE WHEN l_suppkey%4=0 AND l_tax>4e-2 THEN 1e0 ELSE 0e0 END"),
    ("PCHiC", "CASE WHEN l_suppkey%3=0 AND l_linestatus='O' THEN 1e1*l_discount ELSE 0e0 END"),
    ("Nearest", "CASE WHEN l_linenumber%3=0 THEN 1e0 ELSE 0e0 END"),
    ("Regulome", "0e0"),
] + [
    (name, f"CASE WHEN l_suppkey%13=0 THEN NULL ELSE "
           f"((l_partkey*31+l_linenumber*17+l_suppkey+{i}*101)%20)/2e1 END")
    for i, name in enumerate(FIXTURE_TISSUES)
]

GENE_DIM_COLUMNS: list[tuple[str, str]] = [
    ("gene_id", "CONCAT('ENSG',CAST(p_partkey AS STRING))"),
    ("description", "p_type"),
    ("chr", chr_sql("p_partkey")),
    ("gene_start", f"{_GP_P}-500*p_size"),
    ("gene_end", f"{_GP_P}+1000*p_size"),
    ("strand", "CASE WHEN p_partkey%2=0 THEN 1 ELSE -1 END"),
]
GENE_DIM_WHERE = "p_partkey%23<>0"

EXON_COLUMNS: list[tuple[str, str]] = [
    ("gene_id", "CONCAT('ENSG',CAST(p_partkey AS STRING))"),
    ("exon_start", f"{_GP_P}-500*p_size+100*l_linenumber"),
    ("exon_end", f"{_GP_P}-500*p_size+100*l_linenumber+50"),
]

_GL = "(p_partkey*2+b)"
LEAD_VARIANT_COLUMNS: list[tuple[str, str]] = [
    ("gwas_snp", f"CONCAT('rs',CAST({_GL} AS STRING))"),
    ("position", f"{_GP_P}+(({_GL}*104729)%1000001)-500000+500*alt"),
    ("seq_region_name", f"CASE WHEN alt=1 THEN 'HSCHR_ALT' WHEN {_GL}%13=0 "
                        f"THEN {chr_sql('p_partkey+1')} ELSE {chr_sql('p_partkey')} END"),
]
LEAD_VARIANT_WHERE = f"{_GL}%17<>0 AND (alt=0 OR {_GL}%19=0)"


def _select(cols: list[tuple[str, str]]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in cols]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
# The row index is a long. Where keys are so large that its sum leaves 64 bits
# (orders from some 9 million on), ANSI arithmetic fails; the index is then the
# sum modulo 2^64, what 64-bit arithmetic makes of it, and INDEX_TURNS says how
# many times 2^64 were taken off, so (turns, index) is the order of the sums.
_INDEX = dict(EVIDENCE_COLUMNS)["idx"]
_INDEX_EXACT = _INDEX.replace("l_orderkey", "CAST(l_orderkey AS DECIMAL(38,0))")
_INDEX_SIZE = re.sub(r"CAST\((l_quantity) AS BIGINT\)|(l_\w+)", r"ABS(CAST(\1\2 AS DOUBLE))", _INDEX)
_INDEX_FITS = f"{_INDEX_SIZE}<9.2e18"
_INDEX_REST = f"(PMOD({_INDEX_EXACT}+9223372036854775808BD,18446744073709551616BD)-9223372036854775808BD)"
INDEX_SQL = f"CASE WHEN {_INDEX_FITS} THEN {_INDEX} ELSE CAST({_INDEX_REST} AS BIGINT) END"
INDEX_TURNS_SQL = f"CASE WHEN {_INDEX_FITS} THEN 0L ELSE ({_INDEX_EXACT}-{_INDEX_REST}) DIV 18446744073709551616BD END"
# What the 44 tissue columns share is a column of its own (same values as the
# per-column SQL): one sum a row, and no lambda that runs uncompiled.
TISSUE_SUM_SQL = "l_partkey*31+l_linenumber*17+l_suppkey"


def evidence(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """One row per line item; ``in_order``: range-partitioned and sorted by ``idx`` while rows are narrow."""
    compiled_methods(spark)
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    pt = table(spark, sf_dir, "part")
    joined = (li.join(od, li.l_orderkey == od.o_orderkey)
                .join(pt, li.l_partkey == pt.p_partkey))
    if in_order:
        joined = joined.withColumns({"_turns": F.expr(INDEX_TURNS_SQL), "_idx": F.expr(INDEX_SQL)})
        joined = joined.repartitionByRange("_turns", "_idx").sortWithinPartitions("_turns", "_idx")
    base = [("idx", INDEX_SQL) if c[0] == "idx" else c for c in EVIDENCE_COLUMNS if c[0] not in FIXTURE_TISSUES]
    tissues = [(name, f"CASE WHEN l_suppkey%13=0 THEN NULL ELSE ((_sum+{i}*101)%20)/2e1 END")
               for i, name in enumerate(FIXTURE_TISSUES)]
    return joined.withColumn("_sum", F.expr(TISSUE_SUM_SQL)).selectExpr(*_select(base), *_select(tissues))


def gene_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(GENE_DIM_WHERE).selectExpr(*_select(GENE_DIM_COLUMNS))


def exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").distinct()
    pt = table(spark, sf_dir, "part")
    return (li.join(pt, li.l_partkey == pt.p_partkey)
              .selectExpr(*_select(EXON_COLUMNS)))


def lead_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Joined, not exploded: Spark takes an exploded table for as small as its
    # file and would broadcast its rows, four a part, at any size.
    # A part meets the four choices of its half of the keys.
    choices = spark.range(8).selectExpr("id%2 AS b", "shiftright(id,1)%2 AS alt", "shiftright(id,2) AS half")
    pt = table(spark, sf_dir, "part")
    pt = pt.join(choices, F.pmod(pt["p_partkey"], F.lit(2)) == choices["half"])
    return pt.where(LEAD_VARIANT_WHERE).selectExpr(*_select(LEAD_VARIANT_COLUMNS))


# ---------------------------------------------------------------------------
# Ensembl-shaped annotation tables (inputs of the gene / lead-variant builds).
# Chromosome j (0..25, named chr_sql(j)) is seq_region 100+j; its patch
# region "CHR_HSCHR<name>_1" is 200+j. Genes with p_partkey%37=0 sit on a
# patch, p_partkey%31=0 have no description, p_partkey%41=0 have two
# canonical-flagged transcripts in the nested records.
# ---------------------------------------------------------------------------
SEQ_REGION_SQL = (
    "SELECT 100+j AS seq_region_id, {c} AS name, 4 AS coord_system_id FROM chroms "
    "UNION ALL SELECT 200+j, CONCAT('CHR_HSCHR',{c},'_1'), 4 FROM chroms "
    "UNION ALL SELECT 300+j, CONCAT('contig_',{c}), 2 FROM chroms"
).format(c=chr_sql("j"))

ENS_GENE_COLUMNS: list[tuple[str, str]] = [
    ("gene_id", "p_partkey"),
    ("stable_id", "CONCAT('ENSG',CAST(p_partkey AS STRING))"),
    ("description", "CASE WHEN p_partkey%31=0 THEN NULL ELSE p_type END"),
    ("seq_region_start", f"{_GP_P}-500*p_size"),
    ("seq_region_end", f"{_GP_P}+1000*p_size"),
    ("seq_region_id", "CASE WHEN p_partkey%37=0 THEN 200 ELSE 100 END+p_partkey%26"),
    ("canonical_transcript_id", "p_partkey*10"),
]

ENS_TRANSCRIPT_COLUMNS: list[tuple[str, str]] = [
    ("transcript_id", "p_partkey*10+t"),
    ("seq_region_strand", "CASE WHEN p_partkey%2=0 THEN 1 ELSE -1 END"),
    ("seq_region_start", f"{_GP_P}-500*p_size"),
    ("seq_region_end", f"{_GP_P}+1000*p_size"),
]

ENS_EXON_COLUMNS: list[tuple[str, str]] = [
    ("exon_id", "l_partkey*10+l_linenumber"),
    ("seq_region_start", f"{_GP_P}-500*p_size+100*l_linenumber"),
    ("seq_region_end", f"{_GP_P}-500*p_size+100*l_linenumber+50"),
]

# Every exon belongs to the canonical transcript; line number 1 also to the
# second (non-canonical) transcript.
ENS_EXON_TRANSCRIPT_COLUMNS: list[tuple[str, str]] = [
    ("exon_id", "l_partkey*10+l_linenumber"),
    ("transcript_id", "l_partkey*10+t"),
]
ENS_EXON_TRANSCRIPT_WHERE = "t=0 OR l_linenumber=1"

VARIATION_COLUMNS: list[tuple[str, str]] = [
    ("variation_id", _GL),
    ("name", f"CONCAT('rs',CAST({_GL} AS STRING))"),
]

VARIATION_FEATURE_COLUMNS: list[tuple[str, str]] = [
    ("variation_id", _GL),
    ("seq_region_id", f"CASE WHEN alt=1 THEN 200+p_partkey%26 WHEN {_GL}%13=0 "
                      f"THEN 100+(p_partkey+1)%26 ELSE 100+p_partkey%26 END"),
    ("seq_region_start", f"{_GP_P}+(({_GL}*104729)%1000001)-500000+500*alt"),
]


def _two(name: str) -> "F.Column":
    return F.explode(F.array(F.lit(0), F.lit(1))).alias(name)


def ens_seq_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    chroms = table(spark, sf_dir, "part").select((F.col("p_partkey") % 26).alias("j")).distinct()
    c = F.expr(chr_sql("j"))
    return (chroms.select((F.lit(100) + F.col("j")).alias("seq_region_id"), c.alias("name"),
                          F.lit(4).alias("coord_system_id"))
            .unionByName(chroms.select((F.lit(200) + F.col("j")).alias("seq_region_id"),
                                       F.concat(F.lit("CHR_HSCHR"), c, F.lit("_1")).alias("name"),
                                       F.lit(4).alias("coord_system_id")))
            .unionByName(chroms.select((F.lit(300) + F.col("j")).alias("seq_region_id"),
                                       F.concat(F.lit("contig_"), c).alias("name"),
                                       F.lit(2).alias("coord_system_id"))))


def ens_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(GENE_DIM_WHERE).selectExpr(*_select(ENS_GENE_COLUMNS))


def ens_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "part").where(GENE_DIM_WHERE).select("*", _two("t"))
            .selectExpr(*_select(ENS_TRANSCRIPT_COLUMNS)))


def _line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").distinct()
    pt = table(spark, sf_dir, "part")
    return li.join(pt, li.l_partkey == pt.p_partkey)


def ens_exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_parts(spark, sf_dir).selectExpr(*_select(ENS_EXON_COLUMNS))


def ens_exon_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").distinct()
    return (li.select("*", _two("t")).where(ENS_EXON_TRANSCRIPT_WHERE)
              .selectExpr(*_select(ENS_EXON_TRANSCRIPT_COLUMNS)))


def variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "part").select("*", _two("b"))
            .selectExpr(*_select(VARIATION_COLUMNS)))


def variation_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "part").select("*", _two("b")).select("*", _two("alt"))
            .where(LEAD_VARIANT_WHERE).selectExpr(*_select(VARIATION_FEATURE_COLUMNS)))


# ---------------------------------------------------------------------------
# Oracle side: the same tables as DuckDB common table expressions.
# ---------------------------------------------------------------------------
def _sel(cols: list[tuple[str, str]]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in cols)


BASE_CTES = {
    "evidence": (f"SELECT {_sel(EVIDENCE_COLUMNS)} FROM lineitem "
                 "JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey"),
    "gene_dim": f"SELECT {_sel(GENE_DIM_COLUMNS)} FROM part WHERE {GENE_DIM_WHERE}",
    "exon": (f"SELECT {_sel(EXON_COLUMNS)} FROM (SELECT DISTINCT l_partkey, l_linenumber "
             "FROM lineitem) li JOIN part ON l_partkey=p_partkey"),
    "lead_variant": (f"SELECT {_sel(LEAD_VARIANT_COLUMNS)} FROM part, (VALUES (0),(1)) bb(b), "
                     f"(VALUES (0),(1)) aa(alt) WHERE {LEAD_VARIANT_WHERE}"),
    "chroms": "SELECT DISTINCT p_partkey%26 AS j FROM part",
    "ens_seq_region": SEQ_REGION_SQL,
    "ens_gene": f"SELECT {_sel(ENS_GENE_COLUMNS)} FROM part WHERE {GENE_DIM_WHERE}",
    "ens_transcript": (f"SELECT {_sel(ENS_TRANSCRIPT_COLUMNS)} FROM part, (VALUES (0),(1)) tt(t) "
                       f"WHERE {GENE_DIM_WHERE}"),
    "ens_exon": (f"SELECT {_sel(ENS_EXON_COLUMNS)} FROM (SELECT DISTINCT l_partkey, l_linenumber "
                 "FROM lineitem) li JOIN part ON l_partkey=p_partkey"),
    "ens_exon_transcript": (f"SELECT {_sel(ENS_EXON_TRANSCRIPT_COLUMNS)} FROM (SELECT DISTINCT "
                            "l_partkey, l_linenumber FROM lineitem) li, (VALUES (0),(1)) tt(t) "
                            f"WHERE {ENS_EXON_TRANSCRIPT_WHERE}"),
    "variation": f"SELECT {_sel(VARIATION_COLUMNS)} FROM part, (VALUES (0),(1)) bb(b)",
    "variation_feature": (f"SELECT {_sel(VARIATION_FEATURE_COLUMNS)} FROM part, (VALUES (0),(1)) "
                          f"bb(b), (VALUES (0),(1)) aa(alt) WHERE {LEAD_VARIANT_WHERE}"),
}


# ---------------------------------------------------------------------------
# Nested annotation records (inputs of the record flatteners): one gene
# record per Ensembl-shaped gene with its transcripts, exons and translation;
# one variant record per variation with its mappings.
# ---------------------------------------------------------------------------
def gene_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusforge.functions.nested import GENE_RECORD_DDL
    s, d = spark, sf_dir
    exons = (ens_exon_transcript(s, d).join(ens_exon(s, d), "exon_id")
             .groupBy("transcript_id")
             .agg(F.sort_array(F.collect_list(F.struct(
                 F.col("seq_region_start").alias("start"), F.col("seq_region_end").alias("end"),
                 F.concat(F.lit("ENSE"), F.col("exon_id").cast("string")).alias("id")))).alias("_ex")))
    gid = (F.col("transcript_id") / 10).cast("bigint")
    tx = (ens_transcript(s, d).join(exons, "transcript_id", "left")
          .select(gid.alias("gene_id"), F.struct(
              F.concat(F.lit("ENST"), F.col("transcript_id").cast("string")).alias("id"),
              F.col("seq_region_start").alias("start"), F.col("seq_region_end").alias("end"),
              F.col("seq_region_strand").alias("strand"),
              F.when((F.col("transcript_id") % 10 == 0) | (gid % 41 == 0), 1).otherwise(0).alias("is_canonical"),
              F.transform(F.coalesce("_ex", F.array()), lambda e: F.struct(e["id"], e["start"], e["end"]))
              .alias("Exon"),
              F.when(gid % 43 != 0, F.struct((F.col("seq_region_start") + 10).alias("start"),
                                               (F.col("seq_region_end") - 10).alias("end"))).alias("Translation"),
          ).alias("t"))
          .groupBy("gene_id").agg(F.sort_array(F.collect_list("t")).alias("Transcript")))
    regions = ens_seq_region(s, d).select("seq_region_id", F.col("name").alias("seq_region_name"))
    g = ens_gene(s, d).join(regions, "seq_region_id").join(tx, "gene_id", "left")
    rec = F.struct(
        F.col("stable_id").alias("id"),
        F.concat(F.lit("SYM"), F.col("gene_id").cast("string")).alias("display_name"),
        "description", F.col("seq_region_start").alias("start"), F.col("seq_region_end").alias("end"),
        F.when(F.col("gene_id") % 2 == 0, 1).otherwise(-1).alias("strand"), "seq_region_name",
        F.lit("protein_coding").alias("biotype"), "Transcript")
    return g.select(rec.cast(GENE_RECORD_DDL).alias("gene"))


def variant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusforge.functions.nested import VARIANT_RECORD_DDL
    s, d = spark, sf_dir
    regions = ens_seq_region(s, d).select("seq_region_id", F.col("name").alias("seq_region_name"))
    maps = (variation_feature(s, d).join(regions, "seq_region_id")
            .groupBy("variation_id")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("seq_region_start").alias("start"),
                                                      "seq_region_name"))).alias("mappings")))
    v = variation(s, d).join(maps, "variation_id", "left")
    vid = F.col("variation_id")
    rec = F.struct(
        "name", ((vid % 50) / 1e2).alias("MAF"),
        F.lit("ACGT").substr((vid % 4 + 1).cast("int"), F.lit(1)).alias("ancestral_allele"),
        F.lit("ACGT").substr(((vid + 1) % 4 + 1).cast("int"), F.lit(1)).alias("minor_allele"),
        F.coalesce("mappings", F.array()).alias("mappings"))
    return v.select(rec.cast(VARIANT_RECORD_DDL).alias("variant"))
