import itertools
import random

import xxhash
from pyspark.sql import functions as F

from locusforge.llm import simhash as S
from locusforge.llm.components import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest index reachable for each index over links of at most 3 bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(x) for x in range(len(prints))]


def test_masks_hide_every_triple():
    masks = S.covering_masks(list(range(64)))
    assert len(masks) == 15
    for a, b, c in itertools.combinations(range(64), 3):
        bits = 1 << a | 1 << b | 1 << c
        assert any(not m & bits for m in masks)


def test_two_cuts_leave_bounded_buckets():
    masks = S.covering_masks(list(range(64)))
    for _ in range(2):
        masks = sorted({f for m in masks for f in S.finer_masks(m)})
    assert max(64 - m.bit_count() for m in masks) <= 8


def test_fingerprints_and_groups_match_brute_force(spark, docs):
    rows = docs.collect()
    expected = [brute_print(r["text"]) for r in rows]
    found = S.near_duplicates(docs).collect()
    got = sorted((r["id"] is None, r["id"] or 0, r["print"] % 2 ** 64, r["component_id"]) for r in found)
    groups = brute_groups(expected)
    least = {}
    for r, g in zip(rows, groups):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, e, least.get(g)) for r, e, g in zip(rows, expected, groups))
    assert got == want


def test_links_keep_components_in_crowded_buckets(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(300):
        p = centre
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            p ^= 1 << b
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    for limit in (4, 256):  # 4: nearly every bucket is cut again
        roots = {r["node"]: r["root"] for r in connected_components(S.links(table, limit)).collect()}
        want = brute_groups(prints)
        parts = lambda key: sorted(sorted(v) for v in _classes(key, range(len(prints))))
        assert parts(lambda i: want[i]) == parts(lambda i: roots.get(signed[i], signed[i]))


def _classes(key, items):
    out = {}
    for x in items:
        out.setdefault(key(x), []).append(x)
    return out.values()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_one_document_of_each_group_stays(docs):
    kept = S.keep_representatives(docs)
    assert kept.columns == docs.columns
    groups = {(r["id"], r["text_hash"]): r["component"] for r in S.near_duplicates(docs).collect()}
    assert kept.count() == len(set(groups.values()))
    assert kept.where("doc_id = 7").count() <= 1


def test_empty_table(no_docs):
    assert S.near_duplicates(no_docs).count() == 0
    assert S.keep_representatives(no_docs).count() == 0


def test_columns_of_any_name_pass_through(docs):
    names = ["id", "row", "copy", "print", "_keep_id", "_keep_hash", "_copy", "_right_id"]
    clash = docs.drop("ID").select("*", *[F.lit(n).alias(n) for n in names])
    out = S.keep_representatives(clash)
    assert out.schema == clash.schema
    assert ({(r["doc_id"], r["text"]) for r in out.collect()}
            == {(r["doc_id"], r["text"]) for r in S.keep_representatives(docs).collect()})
