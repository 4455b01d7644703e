import hashlib
import random
import zlib

import numpy as np
import pytest

from locusforge.llm import periodic_runs as P

FOLDER = "/root/testdata/sf0.001"


def brute(words, min_length=P.MIN_LENGTH):
    """Every period by itself: all maximal stretches, without those that a smaller period fills."""
    out, names = set(), np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else []
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate(([0], names[:-q] == names[q:], [0])).astype(int)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if j - i >= max(min_length - q, q):
                x = words[i:j + q]
                if not any(x[r:] == x[:-r] for r in range(1, q)):
                    out.add((i, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def letters(text):
    return [c.encode() for c in text]


def found(texts, min_length):
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    start, length, period = P.runs_of(P.numbered(texts), int(sizes.max()), min_length)
    owner = np.searchsorted(begin, start, side="right") - 1
    return [[(int(s - begin[k]), int(n), int(q)) for s, n, q, o in zip(start, length, period, owner) if o == k]
            for k in range(len(texts))]


@pytest.mark.parametrize("min_length", [2, 12])
@pytest.mark.parametrize("step", [1 << 22, 7])
def test_against_every_period(monkeypatch, min_length, step):
    monkeypatch.setattr(P, "STEP", step)
    rng = random.Random(min_length)
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(260))
    a, b = "a", "ab"
    while len(b) < 260:
        a, b = b, b + a
    groups = [[letters(t) for t in (thue, b, "x" * 97, "", "a", thue * 2, "abc" * 40 + "d" + "abc" * 30)]]
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            part = "".join(rng.choice("abcd"[:rng.randrange(1, 5)]) for _ in range(rng.randrange(40)))
            texts.append(letters(part[:rng.randrange(1, 30)] * rng.randrange(1, 6) + part))
        groups.append(texts)
    for texts in groups:
        assert found(texts, min_length) == [brute(t, min_length) for t in texts]


def test_a_long_text_takes_no_square_time(spark, make_docs):
    """160,000 words of period 1, 7 and 1,001: each is one run."""
    words = [f"w{i}" for i in range(1001)]
    docs = make_docs([(1, "x " * 160_000), (2, "a b c d e f g " * 23_000), (3, " ".join(words * 160))])
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in P.collapse_runs(docs).collect()}
    assert got == {1: [(0, 160_000, 1)], 2: [(0, 161_000, 7)], 3: [(0, 160_160, 1001)]}


def test_operator_on_odd_rows(spark, docs, no_docs):
    rows = P.collapse_runs(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode().split())
    assert len(rows) == docs.count()
    for r in rows:
        runs = [tuple(x) for x in r["runs"]]
        assert any(len(t) == r["n_words"] and r["collapsed"].encode() == collapsed(t, runs) and runs == brute(t)
                   for t in texts[r["doc_id"]])
    assert P.collapse_runs(no_docs).count() == 0


def damaged(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode().split()
             for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = P.op12_periodic_runs(spark, FOLDER).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    for r in rows:
        words = damaged(r["doc_id"], texts[r["doc_id"]])
        if len(words) > 1200:
            continue
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"],
                r["collapsed_sha256"]) == want
