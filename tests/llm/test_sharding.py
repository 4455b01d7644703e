import zlib
from collections import Counter

import numpy as np

from locusforge.llm import sharding as S


def jump(key, n):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_matches_the_plain_loop():
    keys = np.random.RandomState(0).randint(-2 ** 63, 2 ** 63 - 1, 3000)
    for n in (1, 2, 16, 17, 1000):
        assert S.jump_hash(keys, n).tolist() == [jump(int(k) % 2 ** 64, n) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.random.RandomState(1).randint(0, 2 ** 63 - 1, 20000)
    a, b = S.jump_hash(keys, 16), S.jump_hash(keys, 17)
    moved = a != b
    assert (b[moved] == 16).all() and 0.04 < moved.mean() < 0.08
    assert min(Counter(a.tolist()).values()) > 1000


def test_slots_are_gapless(spark, docs):
    rows = S.assign_shards(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shards = {}
    for r in rows:
        shards.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(len(s) == 1 for s in shards.values())


def test_query(spark):
    rows = S.op7_jump_hash_shards(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode()
             for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")


def test_clashing_columns_and_empty_table(spark, docs, no_docs):
    clash = docs.selectExpr("*", "1 AS shard", "2 AS slot", "3 AS _block")
    out = S.assign_shards(clash, "doc_id")
    assert out.columns == [*docs.columns, "_block", "shard", "grown_shard", "slot"] and out.count() == docs.count()
    assert S.assign_shards(no_docs, "doc_id").count() == 0
    mapped = docs.selectExpr("doc_id", "map('a', doc_id) AS m")
    assert S.assign_shards(mapped, "doc_id").count() == docs.count()


def test_rows_without_a_key_are_spread_over_blocks(spark):
    """A null key has one shard, whose slots are numbered in many blocks; inner names may clash."""
    rows = spark.range(5000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "id AS start", "id AS place", "id AS row",
                                        "id AS block", "id AS _start", "id AS _row", "id AS _block")
    out = S.assign_shards(rows, "doc_id")
    assert out.columns == [*rows.columns, "shard", "grown_shard", "slot"]
    got = out.collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(5000))
    assert sorted(r["row"] for r in got) == list(range(5000))
    assert sum(a["slot"] + 1 != b["slot"] for a, b in zip(*(sorted(got, key=lambda r: r["start"])[k:] for k in (0, 1)))) > 4000


def test_query_matches_the_plain_loop(spark):
    """shard and grown_shard by the published loop, on the key's hash as Spark gives it."""
    folder = "/root/testdata/sf0.001"
    hashes = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{folder}/documents.parquet")
              .selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    slots = {}
    for r in S.op7_jump_hash_shards(spark, folder).collect():
        key = hashes[r["doc_id"]] % 2 ** 64
        assert (r["shard"], r["grown_shard"]) == (jump(key, 16), jump(key, 17))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
