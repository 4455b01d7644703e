"""Write PLANS.md: the physical plans of the headline operators.

usage: python tools/explain_plans.py [sf_dir]

Plans are taken after execution (AQE final plans), so they show the join
strategies and partition counts Spark actually used.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from locusforge import fixtures as FX  # noqa: E402
from locusforge.operators import batch_locus as B  # noqa: E402
from locusforge.operators import locus as L  # noqa: E402
from locusforge.operators import lookup as K  # noqa: E402
from locusforge.operators import predicates as P  # noqa: E402
from locusforge.operators import tables as TB  # noqa: E402
from locusforge.plans.build import Dataset, write_tables  # noqa: E402
from locusforge.plans.transform import transform  # noqa: E402
from locusforge.session import get_spark, scratch_path  # noqa: E402
from locusforge.sources import sinks  # noqa: E402


def final_plan(df) -> str:
    # run the DataFrame's own query execution so AQE records its final plan
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return condensed(plan.toString())


OPERATORS = re.compile(r"Exchange|Join|Scan|Aggregate|Window|TakeOrdered|Generate|Union|Limit|AQEShuffleRead")


def condensed(plan: str) -> str:
    """The operators that move, join, group or read data, each cut to one short line."""
    final = plan.split("+- == Initial Plan ==")[0]
    lines = []
    for line in final.splitlines():
        if OPERATORS.search(line):
            line = re.sub(r"#\d+L?|\[plan_id=\d+\]|Location: [^]]*\],? ?", "", line)
            pushed = re.findall(r"(?:PartitionFilters|PushedFilters): \[[^\]]+\]", line[110:])
            lines.append(" .. ".join([line[:110], *(p[:160] for p in pushed)]))
    return "\n".join(lines)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    ds = Dataset(spark, sf_dir)
    ev_path = scratch_path(spark, "plans-evidence")
    ds.evidence.repartition(8).write.parquet(ev_path)
    evidence = spark.read.parquet(ev_path)
    raw = transform(evidence, tissues=FX.FIXTURE_TISSUES)
    paths = write_tables(raw, ds.genes, ds.lead_variant, scratch_path(spark, "plans-tables"))
    layout = sinks.read_by_chromosome(spark, paths["by_chrom"])
    proc = spark.read.parquet(paths["processed"])
    genes = spark.read.parquet(paths["genes"])
    ids = spark.read.parquet(paths["ids"])
    chrom, start, end = FX.DEFAULT_LOCUS
    req = L.Locus(chrom, start, end, P.LocusFilters(score=(0.2, 0.6)), "ENSG137", "gene")
    outs = L.locus(layout, genes, req)
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    items = [
        ("Q7 transform over stored evidence (pushed filters, pruned columns)", raw),
        ("Q10 processed: dimension joins", ds.processed),
        ("Q1 gene vertices from the chromosome layout (partition pruning, partial min)", outs["genes"]),
        ("Q1 gene-variant edges (filtered window)", outs["geneVariants"]),
        ("Q2 locus table page (top-k with offset)", TB.locus_table(layout, chrom, start, end,
                                                                   offset=10, limit=25)[0]),
        ("Q3 disease table page on the clustered processed table", TB.disease_table(proc, "EFO_7", 0, 25)[0]),
        ("Q5 variant locations, all ids", K.variant_locations(proc)),
        ("Q5 one variant from the id table", K.variant_location(ids, "rs342")),
        ("Q6 search, batch of query ids", K.search_batch(proc, raw.selectExpr("gwas_snp AS query"))),
        ("J8 batch locus, binned equi-join", B.batch_locus_rows(layout, loci)),
    ]
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `tools/explain_plans.py` on `{sf_dir}` (local[8], AQE final plans).", ""]
    for title, df in items:
        out += [f"## {title}", "", "```", final_plan(df).rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
