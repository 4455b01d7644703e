import random

import numpy as np
import pytest
import xxhash
from sample_words import sentence

from locusforge.llm import substring_dedup as D
from locusforge.llm.suffix_array import common_prefixes, merged_firsts, suffix_array


def brute(rows):
    """{(id, tag): [(start, end)]} for rows (id, tag, raw); equal rows are one document."""
    seen, out = set(), {}
    for i, tag, raw in sorted(set(rows)):
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 99):
            piece = raw[k:k + 100]
            if piece in seen:
                gone[k:k + 100] = True
            seen.add(piece)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        out[i, tag] = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    return out


def check(docs, **how):
    rows = [(r["id"], r["tag"], bytes(r["raw"])) for r in D.keyed_documents(docs).collect()]
    want = {}
    spans = brute(rows)
    for i, tag, raw in rows:
        cut = spans[i, tag]
        edges = [0, *[x for s in cut for x in s], len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        want.setdefault(i, []).append((len(raw), kept, cut))
    got = {}
    for r in D.dedup_strings(docs, **how).collect():
        i = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
        got.setdefault(i, []).append((r["n_bytes"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return sum(len(s) for s in spans.values())


@pytest.mark.parametrize("seed", range(60))
def test_suffix_arrays(seed):
    rng = np.random.RandomState(seed)
    text = rng.randint(97, 97 + rng.randint(1, 4), rng.randint(0, 400)).astype(np.uint8)
    if seed % 3 == 0 and len(text) > 50:
        text = np.tile(text[:rng.randint(1, 60)], 20)[:len(text)]
    raw, order = text.tobytes(), suffix_array(text, 100)
    assert sorted(order.tolist()) == list(range(len(text)))
    shared = common_prefixes(text, order, 100)
    for k in range(1, len(text)):
        a, b = raw[order[k - 1]:][:100], raw[order[k]:][:100]
        assert a <= b
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == same


def test_merge_by_binary_search():
    left = np.array([b"b", b"d", b"f"], dtype="S2")
    assert merged_firsts(left, np.array([b"a", b"b", b"e", b"f", b"z"], dtype="S2")).tolist() == [-1, 0, -1, 2, -1]
    assert merged_firsts(left[:0], left).tolist() == [-1, -1, -1]


def test_equal_strings_have_equal_anchors():
    rng = np.random.RandomState(0)
    shared = rng.randint(0, 256, 300).astype(np.uint8)
    docs = [np.concatenate((rng.randint(0, 256, a).astype(np.uint8), shared, rng.randint(0, 256, 9).astype(np.uint8)))
            for a in (0, 5, 177)]
    data, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    anchor, start, n = D.segments(data, ends)
    per = {}
    for h, s, k in zip(anchor.tolist(), start.tolist(), n.tolist()):
        for p in range(s, s + k):
            per.setdefault(data[p:p + 100].tobytes(), set()).add(h)
    assert all(len(v) == 1 for v in per.values())
    assert sum(n) == sum(len(d) - 99 for d in docs)


def test_pieces_have_the_segments_of_the_whole(monkeypatch):
    rng = np.random.RandomState(4)
    data = np.concatenate((rng.randint(0, 256, 3000), np.full(900, 7), rng.randint(0, 2, 1500))).astype(np.uint8)
    ends = np.array([50, 50, 1300, 1399, 2500, 4100, len(data)])
    whole = D.segments(data, ends)
    for size in (257, 400, 1399, 5300):
        monkeypatch.setattr(D, "SLICE_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, D.segments(data, ends)))


def test_anchors_beyond_64_mib():
    """A passage at the end of a very long text has the anchors that it has in a short one."""
    rng = np.random.RandomState(5)
    shared = rng.randint(0, 256, 400).astype(np.uint8)
    long = np.concatenate((rng.randint(0, 256, 1 << 26).astype(np.uint8), shared))
    anchor, start, n = D.segments(shared, np.array([len(shared)]))
    far, at, m = D.segments(long, np.array([len(long)]))
    assert set(anchor[1:].tolist()) <= set(far[at >= 1 << 26].tolist())
    assert int(m.sum()) == len(long) - 99


def test_matches_brute_force(docs):
    assert check(docs) > 10


def test_hot_passages_and_parts(monkeypatch, make_docs):
    """A passage in every document, with other words around it: anchors of many segments."""
    rng = random.Random(8)
    passage = sentence(rng, 40)
    rows = []
    for i in range(90):
        text = sentence(rng, 8) + passage[rng.randrange(3):len(passage) - rng.randrange(3)] + sentence(rng, 8)
        rows.append(text * (1 + (i % 9 == 0)))
    rows += [rows[4], rows[5][7:], "é" * 333, "é" * 200]
    monkeypatch.setattr(D, "SHARD_BYTES", 600)
    monkeypatch.setattr(D, "TASK_BYTES", 3000)
    monkeypatch.setattr(D, "SLICE_BYTES", 1000)
    monkeypatch.setattr(D, "ROWS_AT_ONCE", 7)
    assert check(make_docs(rows), part_segments=3) >= 90


def test_texts_of_one_id_stay_apart(make_docs):
    """Other texts under one doc_id, or under none, are documents of their own, whatever bits their hashes share."""
    rng = random.Random(3)
    c, a = sentence(rng, 60), sentence(rng, 60)
    a = a[:200] + c[50:250] + a[200:]
    low = xxhash.xxh64_intdigest(a.encode(), 42) % (1 << 16)
    stem = sentence(rng, 60)
    b = next(t for t in (f"{stem} {k}" for k in range(10 ** 7)) if xxhash.xxh64_intdigest(t.encode(), 42) % (1 << 16) == low)
    assert check(make_docs([(1, c), (5, a), (5, b)])) == 1
    rows = [(None, sentence(rng, 12) + (c[60:180] if k % 5 == 0 else "")) for k in range(1000)]
    assert check(make_docs([*rows, (2, c), rows[0]])) == 200


def test_settling_streams_over_batches():
    """The same rows in batches of any size give the same repeats and open segments."""
    rng = np.random.RandomState(2)
    rows = sorted({(int(a), int(c), int(i), int(p) * 10) for a, c, i, p in
                   np.column_stack((rng.randint(0, 6, 300), rng.randint(0, 9, 300), rng.randint(0, 5, 300),
                                    rng.randint(0, 40, 300)))})
    rows = sorted(rows + rows[::17])
    whole = None
    for size in (1000, 1, 2, 7):
        got = set()
        batches = (D._rows(D.OPEN, *(np.array(x, dtype=np.int64) for x in (
            [r[2] for r in part], [r[2] % 2 for r in part], [r[3] for r in part], [1] * len(part),
            [r[0] for r in part], [r[1] for r in part])))
            for part in (rows[i:i + size] for i in range(0, len(rows), size)))
        for batch in D._settle(batches):
            got |= {tuple(r.values()) for r in batch.to_pylist()}
        whole = whole or got
        assert got == whole
    segments = {}
    for a, c, i, p in rows:
        segments.setdefault((a, c), set()).add((i, p))
    assert {(i, p) for k, _, _, i, _, p, _ in whole if k == D.REPEATED} == {
        x for s in segments.values() for x in sorted(s)[1:]}


def test_empty_table_and_short_texts(make_docs, no_docs):
    assert D.dedup_strings(no_docs).count() == 0
    assert check(make_docs([None, "", "short", "short", "x" * 99, "x" * 99])) == 0
