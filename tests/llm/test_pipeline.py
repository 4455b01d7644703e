import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_decontamination import brute as brute_hits, words
from test_line_dedup import brute as brute_lines
from test_simhash import brute_groups, brute_print

import corpus_pipeline as P
from locusforge.llm import byte_bpe, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output rows on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = P.stored(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stage_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup",
                                        "benchmark_decontamination", "byte_bpe"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema["doc_id"].dataType == before.schema["doc_id"].dataType


def test_quality_stage(spark, stages):
    before, after = stages[0]
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r for r in rows(before) if model.score(quality.feature_matrix([(r[1] or "").encode()]))[0] >= 0.7]
    assert sorted(rows(after)) == sorted(want) and 0 < len(want) < before.count()


def test_line_stage(stages):
    before, after = stages[1]
    want = brute_lines([(r[0], r[1]) for r in rows(before)], 40, 5)
    assert sorted((r[0], r[1]) for r in rows(after)) == sorted((k[0], v[2]) for k, v in want.items())
    assert all(r[4] == len(r[1]) for r in rows(after))


def test_simhash_stage(stages):
    before, after = stages[2]
    old = sorted(rows(before))
    groups = brute_groups([brute_print(r[1]) for r in old])
    assert sorted(rows(after)) == [r for i, r in enumerate(old) if groups[i] == i]


def test_benchmark_stage(spark, stages):
    before, after = stages[3]
    old = rows(before)
    hits = brute_hits([(r[0], r[1]) for r in old], rows(spark.read.parquet(f"{SF}/benchmark.parquet")))
    want = [r for r in old if not hits[r[0], r[1]][0] or 20 * hits[r[0], r[1]][0] < len(words(r[1]))]
    assert sorted(rows(after)) == sorted(want) and len(want) < len(old)


def test_token_stage_and_run(spark, stages):
    before, after = stages[4]
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows(before):
        ids = t.encode_ordinary(r[1])
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(r[1].encode()).hexdigest()))
    assert sorted(rows(after)) == sorted(want)
    assert sorted(rows(P.run(spark, SF))) == sorted(want)


def test_odd_rows_pass_every_stage(spark, make_docs, texts, no_docs):
    """Nulls, empty and repeated rows: no stage fails, none but the last changes the columns."""
    docs = make_docs([*enumerate(texts), (None, texts[7]), (3, texts[3]), (None, None)])
    for _, stage in P.STAGES[1:-1]:
        docs = P.stored(stage(spark, docs, SF), "odd")
        assert stage(spark, no_docs, SF).count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0
    assert P.STAGES[0][1](spark, make_docs(texts), SF).columns == docs.columns


def test_line_stage_keeps_a_clashing_column(spark, docs):
    clash = docs.select("*", F.lit(0).alias("text_before"), F.lit("kept").alias("_text_before"))
    out = P.line_deduplication(spark, clash, SF)
    assert out.schema == clash.schema and {r["_text_before"] for r in out.collect()} == {"kept"}
