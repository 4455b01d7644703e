import zlib

import numpy as np
from pyspark.sql import functions as F

from locusforge.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = Q.op2_quality_pu(spark, SF)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.97
    assert scored.count() == docs.count()


def test_labels_of_held_out_and_bad_rows_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality"))).where("quality = 1 OR doc_id % 4 < 9")
    other = Q.fit(docs, flipped)
    assert np.array_equal(model.weights, other.weights) and model.prior == other.prior


def test_prior_of_mixed_scores():
    rng = np.random.RandomState(0)
    positive = rng.normal(3, 1, 4000)
    unlabelled = np.concatenate((rng.normal(3, 1, 3000), rng.normal(-3, 1, 1000)))
    assert abs(Q.estimate_prior(positive, unlabelled) - 0.75) < 0.04


def test_risk_is_low_on_separable_data():
    rng = np.random.RandomState(1)
    p = rng.normal(1, 0.3, (500, 2))
    u = np.vstack((rng.normal(1, 0.3, (700, 2)), rng.normal(-1, 0.3, (300, 2))))
    w, b = Q.minimise_pu_risk(p, u, 0.7)
    assert ((u[:700] @ w + b) > 0).mean() > 0.95 and ((u[700:] @ w + b) < 0).mean() > 0.95


def test_odd_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(30)] + [(None, 1, 0), (8, None, None)],
                                   "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    scores = docs.select("text", Q.score(model).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scores)
    assert len({r["s"] for r in scores if not r["text"]}) == 1  # null and empty alike
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.keep_good(docs, none).count() == 0
    assert Q.keep_good(no_docs, labels).count() == 0


def test_rows_of_one_id_do_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "train", lambda positive, unlabelled: seen.append((len(positive), len(unlabelled))))
    rows = [(None, f"text number {i}") for i in range(1500)] + [(1, f"other text {i}") for i in range(1500)]
    rows += [(3, "the same")] * 1500
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    Q.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, most=200)
    assert all(140 < n < 260 for n in seen[0])


def test_a_very_small_share_has_rows(spark):
    assert 0 < spark.range(20_000_000).where(Q._sampled(10**10, 5000, "id")).count() < 40
