import hashlib
import time

from pyspark.sql import functions as F

from locusforge.llm import line_dedup as D
from locusforge.llm.common import join_documents, with_key

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_length, min_documents):
    """{(doc_id, text): (n_lines, n_dropped, kept text)}"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    last = lambda ids: max((x for x in ids if x is not None), default=None)
    keep = {k: last(v) for k, v in holders.items() if len(k) >= min_length and len(v) >= min_documents}
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out[i, text or ""] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


def test_matches_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for length, least in ((40, 5), (5, 2)):
        want = brute(rows, length, least)
        keyed = with_key(docs)
        got = join_documents(keyed, D.drop_bitmaps(keyed, length, least), "left").select(
            "id", "text", D.n_dropped(F.col("dropped")).alias("n"),
            D.apply_bitmap(F.col("text"), F.col("dropped")).alias("kept")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n"], r["kept"]) == want[r["id"], r["text"]][1:], r["id"]
        assert any(r["n"] for r in got)


def test_bitmaps_are_runs(spark):
    got = spark.createDataFrame([([0, 1, 2, 5, 7, 8],), ([],), ([3],)], "p array<int>").select(
        D.runs_of(F.col("p")).alias("r"), D.positions_of(D.runs_of(F.col("p"))).alias("back"), "p").collect()
    assert [(x["start"], x["length"]) for x in got[0]["r"]] == [(0, 3), (5, 1), (7, 2)]
    assert all(r["back"] == r["p"] for r in got)


def test_texts_are_rewritten(docs, no_docs):
    out = D.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 40, 5)
    texts = {v[2] for v in want.values()}
    assert {r["text"] or "" for r in out.collect()} == texts
    assert out.where("text IS NULL").count() == 1
    assert D.dedup_lines(no_docs).count() == 0


def test_a_line_in_every_document(make_docs):
    line = "the same line in every one of the documents here"
    rows = make_docs([f"{line}\n{i}\n{line}" for i in range(400)])
    kept = {r["doc_id"]: r["text"] for r in D.dedup_lines(rows).collect()}
    assert kept[399] == f"{line}\n399\n{line}" and all(kept[i] == str(i) for i in range(399))


def test_query_digest(spark):
    rows = D.op10_line_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {k[0]: v for k, v in brute(texts, 40, 5).items()}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows} == {
        i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in want.items()}


def test_many_lines_take_linear_time(spark, make_docs):
    """200,000 lines in one text, of which every tenth goes: seconds, not hours."""
    shared = [f"a line of some length that documents share, number {k:06d}" for k in range(20_000)]
    long = [line for k, s in enumerate(shared) for line in (s, *[f"{k} own {i}" for i in range(9)])]
    docs = make_docs([(1, "\n".join(long)), *[(i, "\n".join(shared)) for i in range(2, 6)]])
    begun = time.time()
    out = {r["doc_id"]: r["text"] for r in D.dedup_lines(docs).select("doc_id", "text").collect()}
    assert out[1].split("\n") == [x for x in long if " own " in x]
    assert out[5] == "\n".join(shared) and out[2] == ""
    assert time.time() - begun < 60


def test_columns_of_any_name_pass_through(docs):
    names = ["id", "row", "dropped", "h1", "_dedup_id", "_right_id", "positions"]
    clash = docs.drop("ID").select("*", *[F.lit(n).alias(n) for n in names])
    plain = {str(tuple(r)) for r in D.dedup_lines(docs.drop("ID")).collect()}
    out = D.dedup_lines(clash)
    assert out.schema == clash.schema
    assert {str(tuple(r)[:-len(names)]) for r in out.collect()} == plain
