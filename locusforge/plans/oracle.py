"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark operators: plain joins, WHERE clauses,
``row_number()`` for representative rows and CASE expressions for scores.
Only the fixture expressions (the input derivation), the term scores and column
names are shared; thresholds, weights and lookup maps are written out here.
"""

from __future__ import annotations

from locusforge import fixtures as FX
from locusforge import schemas as S

# Fixed values, written out so that a wrong entry in the engine shows.
MIN_GTEX, MIN_VEP, MAX_DISTANCE = 0.999975, 0.65, 1000000
WEIGHTS = {"GTEx": 13.0, "PCHiC": 1.5, "Fantom5": 3.0, "DHS": 1.5}
PHASES = {"p1_min": 0.9, "p1_max": 1.0, "p2_min": 0.5, "p2_max": 0.9, "p3": 0.5}
SOURCES = ["GWAS Catalog"]
EVIDENCE_CHROMOSOMES = [str(c) for c in range(23)] + ["X", "Y"]
TABLE_CHROMOSOMES = [str(c) for c in range(1, 23)] + ["X", "Y"]
MUST_HAVE_COLUMNS = {"gtex": "GTEx", "vep": "VEP", "pchic": "PCHiC", "fantom5": "Fantom5", "dhs": "DHS",
                     "nearest": "Nearest", "regulome": "Regulome"}
SIMPLE_SELECTIONS = {"gene": "gene_id", "variant": "ld_snp_rsID", "leadVariant": "gwas_snp",
                     "disease": "disease_efo_id"}
PAIR_SELECTIONS = {"geneVariant": ("gene_id", "ld_snp_rsID"), "variantLeadVariant": ("ld_snp_rsID", "gwas_snp"),
                   "leadVariantDisease": ("gwas_snp", "disease_efo_id")}


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


TIS = FX.FIXTURE_TISSUES
ECO_CASE = "CASE t " + " ".join(f"WHEN {lit(term)} THEN {dbl(v)}" for term, v in S.ECO_SCORES) + " END"
BEST_TERM = f"coalesce(list_max(list_transform(string_split(vep_terms, ','), lambda t: {ECO_CASE})), {dbl(0)})"
OT_VEP = f"CASE WHEN {BEST_TERM} >= {dbl(MIN_VEP)} THEN {BEST_TERM} ELSE {dbl(0)} END"
GMAX = f"greatest({', '.join(TIS)})"
GTISSUE = (f"CASE WHEN {GMAX} IS NULL THEN NULL ELSE list_extract([{', '.join(lit(t) for t in TIS)}], "
           f"list_position([{', '.join(TIS)}], {GMAX})) END")

T3 = f"gwas_source IN {in_list(SOURCES)}"
T45 = (f"GRCh38_chrom IN {in_list(EVIDENCE_CHROMOSOMES)} AND "
       f"GRCh38_gene_chrom IN {in_list(EVIDENCE_CHROMOSOMES)}")
T6 = "GRCh38_chrom = GRCh38_gene_chrom"
T7 = f"abs(GRCh38_pos - GRCh38_gene_pos) <= {MAX_DISTANCE}"
T8 = (f"(GTEx > {dbl(MIN_GTEX)} OR VEP > 0 OR PCHiC > 0 OR Fantom5 > 0 "
      "OR DHS > 0 OR Nearest > 0)")
T_ALL = f"{T3} AND {T45} AND {T6} AND {T7} AND {T8}"

RAW_COLS = ", ".join(["idx", *S.EVIDENCE_TYPES])
ORDER = f"idx, {S.LEAD_CHROM} NULLS FIRST, {S.LEAD_POS} NULLS FIRST"

CTES = dict(FX.BASE_CTES)
CTES["raw"] = (f"SELECT {RAW_COLS}, {OT_VEP} AS ot_vep, {GTISSUE} AS gtex_max_tissue, "
               f"{GMAX} AS gtex_max_value FROM evidence WHERE {T_ALL}")
CTES["processed"] = (
    f"SELECT raw.*, g.gene_start AS {S.GENE_START}, g.gene_end AS {S.GENE_END}, "
    f"lv.seq_region_name AS {S.LEAD_CHROM}, lv.position AS {S.LEAD_POS} FROM raw "
    "LEFT JOIN gene_dim g ON raw.gene_id = g.gene_id "
    "LEFT JOIN lead_variant lv ON lv.gwas_snp = raw.gwas_snp")
CTES["exon_text"] = ("SELECT gene_id, string_agg(CAST(exon_start AS VARCHAR) || '-' || "
                     "CAST(exon_end AS VARCHAR), ';' ORDER BY exon_start, exon_end) AS exons "
                     "FROM exon GROUP BY gene_id")
CTES["genes"] = (
    "SELECT g.gene_id, g.description, CASE WHEN g.strand = 1 THEN g.gene_start ELSE g.gene_end END AS tss, "
    "g.chr, g.gene_start, g.gene_end, CASE WHEN g.strand = 1 THEN true WHEN g.strand = -1 THEN false END "
    "AS fwdstrand, coalesce(x.exons, '') AS exons FROM gene_dim g LEFT JOIN exon_text x ON g.gene_id = x.gene_id")
CTES["chroms24"] = "SELECT * FROM (VALUES " + ", ".join(f"({lit(c)})" for c in TABLE_CHROMOSOMES) + ") v(c)"
CTES["member"] = (f"SELECT p.*, c AS chrom FROM processed p, chroms24 WHERE "
                  f"c = GRCh38_gene_chrom OR c = GRCh38_chrom OR c = {S.LEAD_CHROM}")

# Dependencies between CTEs, so each query carries only what it needs.
DEPS = {
    "raw": ["evidence"], "processed": ["raw", "gene_dim", "lead_variant"],
    "exon_text": ["exon"], "genes": ["gene_dim", "exon_text"], "member": ["processed", "chroms24"],
    "ens_seq_region": ["chroms"],
}


def with_ctes(needed: list[str], extra: list[tuple[str, str]], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in needed:
        visit(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------------------
# Locus predicates
# ---------------------------------------------------------------------------
POSITIONS = [S.GENE_START, S.GENE_END, "GRCh38_pos", S.LEAD_POS]
RESOLVED = f"{S.GENE_START} IS NOT NULL AND {S.GENE_END} IS NOT NULL AND {S.LEAD_POS} IS NOT NULL"


def in_window(start: int, end: int, s: str | None = None, e: str | None = None) -> str:
    s = s or str(int(start))
    e = e or str(int(end))
    return "(" + " OR ".join(f"({p} >= {s} AND {p} <= {e})" for p in POSITIONS) + ")"


def chrom_member(c: str) -> str:
    return f"(GRCh38_gene_chrom = {lit(c)} OR GRCh38_chrom = {lit(c)} OR {S.LEAD_CHROM} = {lit(c)})"


def window_sql(chrom: str, start: int, end: int) -> str:
    return f"SELECT * FROM processed WHERE {chrom_member(chrom)} AND {RESOLVED} AND {in_window(start, end)}"


def must_have_sql(names) -> str | None:
    parts = []
    for n in names or []:
        k = n.lower()
        thr = dbl(MIN_GTEX) if k == "gtex" else "0"
        parts.append(f"({MUST_HAVE_COLUMNS[k]} > {thr})")
    return " AND ".join(parts) or None


def range_sql(col: str, b) -> str | None:
    if b is None or len(b) != 2:
        return None
    return f"({col} >= {dbl(b[0])} AND {col} <= {dbl(b[1])})"


def pvalue_sql(b) -> str | None:
    if b is None or len(b) != 2:
        return None
    lo, hi = 10.0 ** -float(b[1]), 10.0 ** -float(b[0])
    return f"(gwas_pvalue >= {dbl(lo)} AND gwas_pvalue <= {dbl(hi)})"


def selection_sql(sel_id: str | None, sel_type: str | None) -> str | None:
    if sel_id is None or sel_type is None:
        return None
    if sel_type in SIMPLE_SELECTIONS:
        return f"({SIMPLE_SELECTIONS[sel_type]} = {lit(sel_id)})"
    if sel_type in PAIR_SELECTIONS:
        a, b = PAIR_SELECTIONS[sel_type]
        parts = sel_id.split("-")
        second = parts[1] if len(parts) > 1 else None
        return f"({a} = {lit(parts[0])} AND {b} = {lit(second)})"
    return None


def filters_sql(must_haves=(), score=None, r2=None, pvalue=None) -> str | None:
    parts = [p for p in (must_have_sql(must_haves), range_sql("score", score), range_sql("r2", r2),
                         pvalue_sql(pvalue)) if p]
    return " AND ".join(parts) or None


def rep_sql(src: str, keys: list[str], payload: list[tuple[str, str]], flag: str | None) -> str:
    """Representative row per group (smallest row order) plus the selected flag."""
    part = ", ".join(keys)
    sel = (f"count(CASE WHEN {flag} THEN 1 END) OVER (PARTITION BY {part}) > 0" if flag
           else "CAST(NULL AS BOOLEAN)")
    inner = (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {ORDER}) AS _rn, "
             f"{sel} AS _selected FROM {src}")
    cols = ", ".join([*keys, *[f"{e} AS \"{a}\"" for a, e in payload], "_selected AS selected"])
    return f"SELECT {cols} FROM ({inner}) z WHERE _rn = 1"


def composite(a: str, b: str) -> str:
    return f"({a} || '-' || {b})"


def locus_child_sql(child: str, chrom: str, start: int, end: int, must_haves=(), score=None, r2=None,
                    pvalue=None, sel_id=None, sel_type=None) -> str:
    flag = selection_sql(sel_id, sel_type)
    filt = filters_sql(must_haves, score, r2, pvalue)
    extra = [("u", window_sql(chrom, start, end)),
             ("f", "SELECT * FROM u" + (f" WHERE {filt}" if filt else ""))]
    if child == "genes":
        extra.append(("r", rep_sql("u", ["gene_id"], [("symbol", "gene_symbol"),
                                                      ("chromosome", "GRCh38_gene_chrom")], flag)))
        body = ('SELECT r.gene_id AS id, r.symbol, g.description, r.chromosome, g.tss, '
                'g.gene_start AS "start", g.gene_end AS "end", g.fwdstrand AS "forwardStrand", '
                'g.exons, r.selected FROM r LEFT JOIN genes g ON r.gene_id = g.gene_id')
        return with_ctes(["processed", "genes"], extra, body)
    if child == "variants":
        extra.append(("r", rep_sql("u", ["ld_snp_rsID"], [("position", "GRCh38_pos")], flag)))
        return with_ctes(["processed"], extra, "SELECT ld_snp_rsID AS id, position, selected FROM r")
    if child == "leadVariants":
        extra.append(("r", rep_sql("u", ["gwas_snp"], [("position", S.LEAD_POS)], flag)))
        return with_ctes(["processed"], extra, "SELECT gwas_snp AS id, position, selected FROM r")
    if child == "diseases":
        extra.append(("r", rep_sql("u", ["disease_efo_id"], [("name", "disease_name")], flag)))
        return with_ctes(["processed"], extra, "SELECT disease_efo_id AS id, name, selected FROM r")
    if child == "geneVariants":
        payload = [("geneSymbol", "gene_symbol"), ("geneChromosome", "GRCh38_gene_chrom"),
                   ("vPos", "GRCh38_pos"), ("otG2VScore", "score"),
                   ("gtexMaxTissue", "gtex_max_tissue"), ("gtexMaxValue", "gtex_max_value"),
                   ("vep", "ot_vep"), ("vepTerms", "vep_terms"), ("gtex", "GTEx"), ("pchic", "PCHiC"),
                   ("fantom5", "Fantom5"), ("dhs", "DHS"), ("nearest", "Nearest > 0")]
        extra.append(("r", rep_sql("f", ["gene_id", "ld_snp_rsID"], payload, flag)))
        cols = ", ".join(f'r."{a}"' for a, _ in payload)
        body = (f"SELECT {composite('r.gene_id', 'r.ld_snp_rsID')} AS id, r.gene_id AS \"geneId\", "
                f"g.tss AS \"geneTss\", r.ld_snp_rsID AS \"vId\", {cols}, r.selected "
                "FROM r LEFT JOIN genes g ON r.gene_id = g.gene_id")
        return with_ctes(["processed", "genes"], extra, body)
    if child == "variantLeadVariants":
        extra.append(("r", rep_sql("f", ["ld_snp_rsID", "gwas_snp"],
                                   [("vPos", "GRCh38_pos"), ("lvPos", S.LEAD_POS), ("r2", "r2")], flag)))
        body = (f"SELECT {composite('ld_snp_rsID', 'gwas_snp')} AS id, ld_snp_rsID AS \"vId\", "
                "\"vPos\", gwas_snp AS \"lvId\", \"lvPos\", r2, selected FROM r")
        return with_ctes(["processed"], extra, body)
    if child == "leadVariantDiseases":
        payload = [("lvPos", S.LEAD_POS), ("efoName", "disease_name"), ("gwasPValue", "gwas_pvalue"),
                   ("gwasOddsRatio", "gwas_odds_ratio"), ("gwasBeta", "gwas_beta"),
                   ("gwasStudy", "gwas_study"), ("gwasPMId", "gwas_pmid"), ("gwasSize", "gwas_size")]
        extra.append(("r", rep_sql("f", ["gwas_snp", "disease_efo_id"], payload, flag)))
        cols = ", ".join(f'"{a}"' for a, _ in payload)
        body = (f"SELECT {composite('gwas_snp', 'disease_efo_id')} AS id, gwas_snp AS \"lvId\", "
                f"disease_efo_id AS \"efoId\", {cols}, selected FROM r")
        return with_ctes(["processed"], extra, body)
    if child == "maxGwasPValue":
        body = ('SELECT CASE WHEN min(gwas_pvalue) > 0 THEN -log10(min(gwas_pvalue)) END '
                'AS "maxGwasPValue" FROM u')
        return with_ctes(["processed"], extra, body)
    raise KeyError(child)


# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------
FULL_ROW_SQL = ", ".join(
    ('idx AS "index"' if src == S.KEY else
     f'{src} > 0 AS "{api}"' if api == "nearest" else f'{src} AS "{api}"')
    for src, api in [
        (S.KEY, "index"), ("gene_id", "geneId"), ("gene_symbol", "geneSymbol"),
        ("GRCh38_gene_chrom", "geneChromosome"), ("GRCh38_gene_pos", "geneTss"),
        ("ld_snp_rsID", "vId"), ("GRCh38_chrom", "variantChromosome"), ("GRCh38_pos", "vPos"),
        ("gwas_snp", "lvId"), ("disease_efo_id", "efoId"), ("disease_name", "efoName"),
        ("score", "otG2VScore"), ("gtex_max_tissue", "gtexMaxTissue"),
        ("gtex_max_value", "gtexMaxValue"), ("ot_vep", "vep"), ("vep_terms", "vepTerms"),
        ("GTEx", "gtex"), ("PCHiC", "pchic"), ("Fantom5", "fantom5"), ("DHS", "dhs"),
        ("Nearest", "nearest"), ("r2", "r2"), ("gwas_pvalue", "gwasPValue"),
        ("gwas_odds_ratio", "gwasOddsRatio"), ("gwas_beta", "gwasBeta"), ("gwas_size", "gwasSize"),
        ("gwas_pmid", "gwasPMId"), ("gwas_study", "gwasStudy")])


def locus_table_sql(kind: str, chrom, start, end, must_haves=(), score=None, r2=None, pvalue=None,
                    sel_id=None, sel_type=None, offset=0, limit=None, order_prefix: str = "") -> str:
    conds = [p for p in (filters_sql(must_haves, score, r2, pvalue), selection_sql(sel_id, sel_type)) if p]
    rows = window_sql(chrom, start, end) + "".join(f" AND {c}" for c in conds)
    if kind == "total":
        return with_ctes(["processed"], [("t", rows)], "SELECT count(*) AS total FROM t")
    lim = f" LIMIT {int(limit)}" if limit is not None else ""
    off = f" OFFSET {int(offset)}" if offset else ""
    return with_ctes(["processed"], [("t", rows)],
                     f"SELECT {FULL_ROW_SQL} FROM t ORDER BY {order_prefix}{ORDER}{lim}{off}")


def disease_table_sql(kind: str, efo_id: str, offset=0, limit=None, order_prefix: str = "") -> str:
    rows = f"SELECT * FROM processed WHERE disease_efo_id = {lit(efo_id)}"
    if kind == "total":
        return with_ctes(["processed"], [("t", rows)], "SELECT count(*) AS total FROM t")
    lim = f" LIMIT {int(limit)}" if limit is not None else ""
    off = f" OFFSET {int(offset)}" if offset else ""
    return with_ctes(["processed"], [("t", rows)], f"SELECT {FULL_ROW_SQL} FROM t ORDER BY {order_prefix}{ORDER}{lim}{off}")


def pair_batch_sql(chrom: str, start: int, end: int, selected_type: str) -> str:
    """Window rows under every pair id that the evidence has."""
    a, b = PAIR_SELECTIONS[selected_type]
    ids = f"SELECT DISTINCT {a} AS a, {b} AS b FROM evidence WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return with_ctes(["evidence", "processed"], [("u", window_sql(chrom, start, end)), ("s", ids)],
                     f"SELECT u.idx, {composite('s.a', 's.b')} AS selected_id FROM u JOIN s "
                     f"ON u.{a} = s.a AND u.{b} = s.b")


# ---------------------------------------------------------------------------
# Missing values: every 7th row lacks some numbers
# ---------------------------------------------------------------------------
def _holes(columns: list[str], source: str) -> str:
    parts = ", ".join(f"CASE WHEN idx % 7 = 0 THEN NULL ELSE {c} END AS {c}" for c in columns)
    return f"SELECT * REPLACE ({parts}) FROM {source}"


def missing_transform_sql(columns: list[str]) -> str:
    raw = CTES["raw"].replace("FROM evidence", "FROM holes")
    return with_ctes(["evidence"], [("holes", _holes(columns, "evidence")), ("r", raw)], "SELECT * FROM r")


def missing_window_sql(chrom: str, start: int, end: int, columns: list[str], body: str) -> str:
    window = window_sql(chrom, start, end).replace("FROM processed", "FROM holes")
    return with_ctes(["processed"], [("holes", _holes(columns, "processed")), ("u", window)], body)


# ---------------------------------------------------------------------------
# Lookups
# ---------------------------------------------------------------------------
def _locations_sql(vsrc: str, lsrc: str) -> list[tuple[str, str]]:
    return [
        ("v", rep_sql(vsrc, ["ld_snp_rsID"], [("vc", "GRCh38_chrom"), ("vp", "GRCh38_pos")], None)),
        ("l", rep_sql(lsrc, ["gwas_snp"], [("lc", S.LEAD_CHROM), ("lp", S.LEAD_POS)], None)),
        ("loc", "SELECT coalesce(v.ld_snp_rsID, l.gwas_snp) AS id, "
                "CASE WHEN v.ld_snp_rsID IS NOT NULL THEN v.vc ELSE l.lc END AS chromosome, "
                "CASE WHEN v.ld_snp_rsID IS NOT NULL THEN v.vp ELSE l.lp END AS position, "
                "l.gwas_snp IS NOT NULL AS \"isLeadVariant\", v.ld_snp_rsID IS NOT NULL AS \"isVariant\" "
                "FROM v FULL OUTER JOIN l ON v.ld_snp_rsID = l.gwas_snp"),
    ]


def variant_locations_sql() -> str:
    return with_ctes(["processed"], _locations_sql("processed", "processed"), "SELECT * FROM loc")


def variant_location_sql(vid: str) -> str:
    extra = [("pv", f"SELECT * FROM processed WHERE ld_snp_rsID = {lit(vid)}"),
             ("pl", f"SELECT * FROM processed WHERE gwas_snp = {lit(vid)}")]
    return with_ctes(["processed"], extra + _locations_sql("pv", "pl"), "SELECT * FROM loc")


def search_sql(query: str | None = None) -> str:
    if query is not None:
        qs = f"SELECT {lit(query)} AS id"
    else:
        qs = "SELECT ld_snp_rsID AS id FROM evidence UNION SELECT gwas_snp FROM evidence"
    body = ("SELECT DISTINCT q.id, q.id AS name, 'variant' AS type FROM q WHERE q.id IS NOT NULL AND ("
            "q.id IN (SELECT ld_snp_rsID FROM processed) OR q.id IN (SELECT gwas_snp FROM processed))")
    return with_ctes(["processed"], [("q", qs)], body)


def gene_location_sql(gene_id: str | None = None) -> str:
    if gene_id is not None:
        return with_ctes(["gene_dim"], [], 'SELECT gene_id AS id, CAST(NULL AS VARCHAR) AS symbol, '
                         'chr AS chromosome, gene_start AS "start", gene_end AS "end" FROM gene_dim '
                         f"WHERE gene_id = {lit(gene_id)}")
    body = ('SELECT q.gene_id AS id, CAST(NULL AS VARCHAR) AS symbol, g.chr AS chromosome, '
            'g.gene_start AS "start", g.gene_end AS "end", g.gene_id IS NOT NULL AS found '
            "FROM (SELECT DISTINCT gene_id FROM evidence) q LEFT JOIN gene_dim g ON q.gene_id = g.gene_id")
    return with_ctes(["evidence", "gene_dim"], [], body)


# ---------------------------------------------------------------------------
# Batch locus
# ---------------------------------------------------------------------------
def batch_locus_sql(loci_sql: str, needed: list[str]) -> str:
    pairs = ("SELECT l.locus_id, m.* FROM member m JOIN loci l ON m.chrom = l.chrom "
             f"WHERE {RESOLVED} AND " + in_window(0, 0, 'l."start"', 'l."end"'))
    body = ("SELECT locus_id, count(*) AS n_rows, count(DISTINCT gene_id) AS n_genes, "
            "count(DISTINCT ld_snp_rsID) AS n_variants, count(DISTINCT gwas_snp) AS n_lead_variants, "
            "count(DISTINCT disease_efo_id) AS n_diseases, CASE WHEN min(gwas_pvalue) > 0 THEN "
            '-log10(min(gwas_pvalue)) END AS "maxGwasPValue" FROM pairs GROUP BY locus_id')
    return with_ctes(["member", *needed], [("loci", loci_sql), ("pairs", pairs)], body)


def loci_per_chromosome_sql(start: int, end: int) -> str:
    return (f"SELECT DISTINCT 'chr' || chr AS locus_id, chr AS chrom, CAST({int(start)} AS BIGINT) AS \"start\", "
            f"CAST({int(end)} AS BIGINT) AS \"end\" FROM gene_dim WHERE chr IN {in_list(TABLE_CHROMOSOMES)}")


def loci_around_genes_sql(flank: int) -> str:
    return (f"SELECT gene_id AS locus_id, chr AS chrom, gene_start - {int(flank)} AS \"start\", "
            f"gene_end + {int(flank)} AS \"end\" FROM gene_dim WHERE chr IN {in_list(TABLE_CHROMOSOMES)}")


def batch_locus_genes_sql(loci_sql: str) -> str:
    pairs = ("SELECT l.locus_id, m.* FROM member m JOIN loci l ON m.chrom = l.chrom "
             f"WHERE {RESOLVED} AND " + in_window(0, 0, 'l."start"', 'l."end"'))
    rep = rep_sql("pairs", ["locus_id", "gene_id"], [("symbol", "gene_symbol"),
                                                     ("chromosome", "GRCh38_gene_chrom")], None)
    body = ('SELECT r.locus_id, r.gene_id AS id, r.symbol, g.description, r.chromosome, g.tss, '
            'g.gene_start AS "start", g.gene_end AS "end", g.fwdstrand AS "forwardStrand", '
            'g.exons, r.selected FROM r LEFT JOIN genes g ON r.gene_id = g.gene_id')
    return with_ctes(["member", "genes"], [("loci", loci_sql), ("pairs", pairs), ("r", rep)], body)


def _pairs_sql() -> str:
    return ("SELECT l.locus_id, m.* FROM member m JOIN loci l ON m.chrom = l.chrom "
            f"WHERE {RESOLVED} AND " + in_window(0, 0, 'l."start"', 'l."end"'))


def batch_locus_gene_variants_sql(loci_sql: str, filt: str | None) -> str:
    payload = [("geneSymbol", "gene_symbol"), ("geneChromosome", "GRCh38_gene_chrom"),
               ("vPos", "GRCh38_pos"), ("otG2VScore", "score"),
               ("gtexMaxTissue", "gtex_max_tissue"), ("gtexMaxValue", "gtex_max_value"),
               ("vep", "ot_vep"), ("vepTerms", "vep_terms"), ("gtex", "GTEx"), ("pchic", "PCHiC"),
               ("fantom5", "Fantom5"), ("dhs", "DHS"), ("nearest", "Nearest > 0")]
    rep = rep_sql("f", ["locus_id", "gene_id", "ld_snp_rsID"], payload, None)
    cols = ", ".join(f'r."{a}"' for a, _ in payload)
    body = (f"SELECT r.locus_id, {composite('r.gene_id', 'r.ld_snp_rsID')} AS id, r.gene_id AS \"geneId\", "
            f"g.tss AS \"geneTss\", r.ld_snp_rsID AS \"vId\", {cols}, r.selected "
            "FROM r LEFT JOIN genes g ON r.gene_id = g.gene_id")
    f = "SELECT * FROM pairs" + (f" WHERE {filt}" if filt else "")
    return with_ctes(["member", "genes"], [("loci", loci_sql), ("pairs", _pairs_sql()), ("f", f),
                                           ("r", rep)], body)


def batch_child_sql(child: str, loci_sql: str, filt: str | None) -> str:
    """One of the batch outputs that need no gene table, for every window."""
    src, keys, payload, names = {
        "variants": ("pairs", ["ld_snp_rsID"], [("position", "GRCh38_pos")], 'ld_snp_rsID AS id, position'),
        "leadVariants": ("pairs", ["gwas_snp"], [("position", S.LEAD_POS)], 'gwas_snp AS id, position'),
        "diseases": ("pairs", ["disease_efo_id"], [("name", "disease_name")], 'disease_efo_id AS id, name'),
        "variantLeadVariants": ("f", ["ld_snp_rsID", "gwas_snp"], [
            ("vPos", "GRCh38_pos"), ("lvPos", S.LEAD_POS), ("r2", "r2")],
            f'{composite("ld_snp_rsID", "gwas_snp")} AS id, ld_snp_rsID AS "vId", "vPos", gwas_snp AS "lvId", '
            '"lvPos", r2'),
        "leadVariantDiseases": ("f", ["gwas_snp", "disease_efo_id"], [
            ("lvPos", S.LEAD_POS), ("efoName", "disease_name"), ("gwasPValue", "gwas_pvalue"),
            ("gwasOddsRatio", "gwas_odds_ratio"), ("gwasBeta", "gwas_beta"), ("gwasStudy", "gwas_study"),
            ("gwasPMId", "gwas_pmid"), ("gwasSize", "gwas_size")],
            f'{composite("gwas_snp", "disease_efo_id")} AS id, gwas_snp AS "lvId", disease_efo_id AS "efoId", '
            '"lvPos", "efoName", "gwasPValue", "gwasOddsRatio", "gwasBeta", "gwasStudy", "gwasPMId", "gwasSize"'),
    }[child]
    f = "SELECT * FROM pairs" + (f" WHERE {filt}" if filt else "")
    return with_ctes(["member"], [("loci", loci_sql), ("pairs", _pairs_sql()), ("f", f),
                                  ("r", rep_sql(src, ["locus_id", *keys], payload, None))],
                     f"SELECT locus_id, {names}, selected FROM r")


def batch_locus_max_pvalue_sql(loci_sql: str) -> str:
    body = ('SELECT locus_id, CASE WHEN min(gwas_pvalue) > 0 THEN -log10(min(gwas_pvalue)) END '
            'AS "maxGwasPValue" FROM pairs GROUP BY locus_id')
    return with_ctes(["member"], [("loci", loci_sql), ("pairs", _pairs_sql())], body)


def keyset_page_sql(chrom: str, start: int, end: int, first_page: int, limit: int) -> str:
    """Rows after the last row of a first page of ``first_page`` rows, in row order."""
    extra = [("t", window_sql(chrom, start, end)),
             ("k", f"SELECT idx AS ki, {S.LEAD_CHROM} AS kc, {S.LEAD_POS} AS kp FROM t "
                   f"ORDER BY {ORDER} LIMIT 1 OFFSET {int(first_page) - 1}")]
    after = (f"(t.idx > k.ki OR (t.idx = k.ki AND (t.{S.LEAD_CHROM} > k.kc OR "
             f"(t.{S.LEAD_CHROM} = k.kc AND t.{S.LEAD_POS} > k.kp))))")
    return with_ctes(["processed"], extra,
                     f"SELECT {FULL_ROW_SQL} FROM t, k WHERE {after} ORDER BY {ORDER} LIMIT {int(limit)}")


# ---------------------------------------------------------------------------
# Scores, gene dimension and nested records
# ---------------------------------------------------------------------------
def g2v_sql() -> str:
    """S2/S3 over the whole evidence table."""
    best = BEST_TERM
    m1 = (PHASES["p1_max"] - PHASES["p1_min"]) / (1.0 - MIN_VEP)
    m2 = (PHASES["p2_max"] - PHASES["p2_min"]) / (1.0 - 0.0)
    g = (f"(CASE WHEN GTEx > {dbl(MIN_GTEX)} THEN GTEx * {dbl(WEIGHTS["GTEx"])} ELSE 0e0 END"
         f" + CASE WHEN PCHiC > 0 THEN PCHiC * {dbl(WEIGHTS["PCHiC"])} ELSE 0e0 END"
         f" + CASE WHEN Fantom5 > 0 THEN Fantom5 * {dbl(WEIGHTS["Fantom5"])} ELSE 0e0 END"
         f" + CASE WHEN DHS > 0 THEN DHS * {dbl(WEIGHTS["DHS"])} ELSE 0e0 END)"
         f" / {dbl(sum(WEIGHTS.values()))}")
    score = (f"CASE WHEN {best} >= {dbl(MIN_VEP)} THEN ({best} - {dbl(MIN_VEP)})"
             f" * {dbl(m1)} + {dbl(PHASES["p1_min"])}"
             f" WHEN {g} > 0 THEN ({g} - 0e0) * {dbl(m2)} + {dbl(PHASES["p2_min"])}"
             f" WHEN Nearest > 0 THEN {dbl(PHASES["p3"])} ELSE 0e0 END")
    srcs = ("concat_ws(';', CASE WHEN GTEx > " + dbl(MIN_GTEX) + " THEN 'GTEx' END, "
            "CASE WHEN PCHiC > 0 THEN 'PCHiC' END, CASE WHEN Fantom5 > 0 THEN 'Fantom5' END, "
            "CASE WHEN DHS > 0 THEN 'DHS' END)")
    reason = (f"CASE WHEN {best} >= {dbl(MIN_VEP)} THEN '1:VEP' WHEN {srcs} <> '' "
              f"THEN '2:' || {srcs} WHEN Nearest > 0 THEN '3:Nearest' ELSE '' END")
    return with_ctes(["evidence"], [], f"SELECT idx, {score} AS ot_g2v_score, "
                       f"{reason} AS ot_g2v_score_reason FROM evidence")


CANONICAL_EXONS_SQL = (
    "SELECT g.stable_id AS gene_id, g.description, r.name AS chr, g.seq_region_start AS gene_start, "
    "g.seq_region_end AS gene_end, CASE WHEN t.seq_region_strand = 1 THEN true "
    "WHEN t.seq_region_strand = -1 THEN false END AS fwdstrand, "
    "CASE WHEN t.seq_region_strand = 1 THEN g.seq_region_start ELSE g.seq_region_end END AS tss, "
    "et.exon_id, et.transcript_id, e.seq_region_start AS exon_start, e.seq_region_end AS exon_end "
    "FROM ens_exon_transcript et, ens_exon e, ens_gene g, ens_transcript t, ens_seq_region r "
    "WHERE g.canonical_transcript_id = et.transcript_id AND g.seq_region_id = r.seq_region_id "
    "AND r.coord_system_id = 4 AND NOT regexp_matches(r.name, 'CHR', 'i') "
    "AND et.transcript_id = t.transcript_id AND e.exon_id = et.exon_id")


ENS_TABLES = ["ens_seq_region", "ens_gene", "ens_transcript", "ens_exon", "ens_exon_transcript"]
GENE_KEYS_SQL = "gene_id, description, tss, chr, gene_start, gene_end, fwdstrand"
GENE_ROWS_SQL = "SELECT * FROM ce WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in GENE_KEYS_SQL.split(", "))
GENE_DIM_SQL = with_ctes(
    ENS_TABLES, [("ce", CANONICAL_EXONS_SQL), ("gr", GENE_ROWS_SQL)],
    f"SELECT {GENE_KEYS_SQL}, string_agg(CAST(exon_start AS VARCHAR) || '-' || CAST(exon_end AS VARCHAR), "
    f"';' ORDER BY exon_start, exon_end) AS exons FROM gr GROUP BY {GENE_KEYS_SQL}")
GENES_PER_CHROM_SQL = with_ctes(
    ENS_TABLES, [("ce", CANONICAL_EXONS_SQL), ("gr", GENE_ROWS_SQL)],
    f"SELECT chr, count(*) AS n_genes FROM (SELECT DISTINCT {GENE_KEYS_SQL} FROM gr) z GROUP BY chr")


NESTED_GENE_SQL = with_ctes(
    ["ens_seq_region", "ens_gene", "ens_transcript", "ens_exon", "ens_exon_transcript"], [
        ("ex", "SELECT et.transcript_id, 'ENSE' || CAST(e.exon_id AS VARCHAR) AS id, "
               "e.seq_region_start AS s, e.seq_region_end AS en FROM ens_exon_transcript et "
               "JOIN ens_exon e ON et.exon_id = e.exon_id"),
        ("tx", "SELECT t.*, t.transcript_id // 10 AS gid, CASE WHEN t.transcript_id % 10 = 0 OR "
               "(t.transcript_id // 10) % 41 = 0 THEN 1 ELSE 0 END AS is_canonical FROM ens_transcript t"),
        ("canon", "SELECT gid, count(*) AS n, min(transcript_id) AS tid FROM tx WHERE is_canonical = 1 "
                  "GROUP BY gid"),
        ("ct", "SELECT tx.* FROM tx JOIN canon ON tx.transcript_id = canon.tid WHERE canon.n = 1"),
        ("ext", "SELECT transcript_id, string_agg(id || ':' || CAST(s AS VARCHAR) || '-' || "
                "CAST(en AS VARCHAR), ';' ORDER BY s, en, id) AS exons FROM ex GROUP BY transcript_id"),
    ],
    "SELECT g.stable_id AS id, 'SYM' || CAST(g.gene_id AS VARCHAR) AS name, g.description, "
    'g.seq_region_start AS "start", g.seq_region_end AS "end", g.gene_id % 2 = 0 AS "forwardStrand", '
    "'protein_coding' AS biotype, r.name AS chromosome, 'ENST' || CAST(ct.transcript_id AS VARCHAR) AS ct_id, "
    "ct.seq_region_start AS ct_start, ct.seq_region_end AS ct_end, "
    'ct.seq_region_strand = 1 AS "ct_forwardStrand", CASE WHEN ct.seq_region_strand = 1 THEN '
    "ct.seq_region_start ELSE ct.seq_region_end END AS ct_tss, CASE WHEN ct.transcript_id IS NULL THEN NULL "
    "ELSE coalesce(ext.exons, '') END AS ct_exons, "
    'CASE WHEN ct.gid % 43 <> 0 THEN ct.seq_region_start + 10 END AS "ct_translationStart", '
    'CASE WHEN ct.gid % 43 <> 0 THEN ct.seq_region_end - 10 END AS "ct_translationEnd" '
    "FROM ens_gene g JOIN ens_seq_region r ON g.seq_region_id = r.seq_region_id "
    "LEFT JOIN ct ON ct.gid = g.gene_id LEFT JOIN ext ON ext.transcript_id = ct.transcript_id")

NESTED_VARIANT_SQL = with_ctes(
    ["ens_seq_region", "variation", "variation_feature"], [
        ("m", "SELECT vf.variation_id, vf.seq_region_start AS s, r.name AS nm, row_number() OVER ("
              "PARTITION BY vf.variation_id ORDER BY vf.seq_region_start, r.name) AS rn "
              "FROM variation_feature vf JOIN ens_seq_region r ON vf.seq_region_id = r.seq_region_id"),
    ],
    "SELECT v.name AS id, (v.variation_id % 50) / 1e2 AS maf, "
    "substring('ACGT', CAST(v.variation_id % 4 + 1 AS INTEGER), 1) AS \"ancestralAllele\", "
    "substring('ACGT', CAST((v.variation_id + 1) % 4 + 1 AS INTEGER), 1) AS \"minorAllele\", "
    "m.s AS position, m.nm AS chromosome FROM variation v LEFT JOIN m ON m.variation_id = v.variation_id "
    "AND m.rn = 1")
