import random
import re

from sample_words import sentence

from locusforge.llm import decontamination as D
from locusforge.llm.common import with_key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS_DDL = "item_id long, text string, id string, words string"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    out = {}
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out[i, text or ""] = (len(hit), sorted(str(x) for x in found if x is not None))
    return out


def cases():
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(14, 60))) for i in range(12)]
    items += [(20, "One Short item"), (21, "short"), (22, ""), (23, None), (24, "... !!"), (None, sentence(rng, 20)),
              (3, items[3][1]), (25, items[5][1][10:90])]
    docs = [sentence(rng, 80) for _ in range(10)] + [None, "", "?!", "One short, ITEM", "a one short item b short"]
    for i, text in items:
        w = (text or "").split()
        a = rng.randrange(0, max(1, len(w) - 14))
        docs += [sentence(rng, 30) + " " + (text or "").upper().replace(" ", "--") + "\n" + sentence(rng, 5),
                 " ".join(w[a:a + 13]) + " tail", " ".join(w[a:a + 12]) + " cut", (text or "") * 3]
    return docs, items


def test_matches_brute_force(spark, make_docs):
    docs, items = cases()
    rows = [*enumerate(docs), (None, docs[-1]), (2, docs[2]), (20, docs[20])]
    bench = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], ITEMS_DDL)
    table = make_docs(rows)
    want = brute(rows, items)
    hits = {(r["id"], r["text_hash"]): (r["n_hit"], r["items"]) for r in D.contamination(with_key(table), bench).collect()}
    seen = 0
    for r in with_key(table).collect():
        n, found = hits.get((r["id"], r["text_hash"]), (0, []))
        assert (n, found) == want[r["id"], r["text"]], r["text"]
        seen += n > 0
    assert seen > 40
    kept = D.decontaminate(table, bench)
    bad = [k for k, v in want.items() if v[0] and 20 * v[0] >= len(words(k[1]))]
    assert kept.columns == table.columns
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in kept.collect()) == sorted(
        str((i, t or "")) for i, t in rows if (i, t or "") not in bad)


def test_every_shared_span_shares_a_fingerprint(spark):
    """Winnowing's promise: equal spans of 13 words have equal winnowed hashes at the same place."""
    rng = random.Random(9)
    span = sentence(rng, 13).split()
    rows = [(i, sentence(rng, a).split() + span + sentence(rng, 7).split(), a) for i, a in enumerate((1, 5, 30))]
    table = spark.createDataFrame(rows, "i int, words array<string>, a int")
    minima = [(r["minima"], r["a"]) for r in D.with_fingerprints(table, 13).collect()]
    assert len({m[a] for m, a in minima}) == 1


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], ITEMS_DDL)
    some = spark.createDataFrame([(1, "alpha beta", "x", "y")], ITEMS_DDL)
    assert D.decontaminate(docs, none).count() == docs.count()
    assert D.decontaminate(no_docs, some).count() == 0
    assert D.contamination(with_key(docs), none).count() == 0


def test_a_window_of_many_items_is_one_row_per_occurrence(spark, make_docs):
    """A passage that 300 items and 200 documents hold: occurrences do not multiply with the items."""
    rng = random.Random(3)
    shared = sentence(rng, 15)
    items = [(i, shared + " " + sentence(rng, 5)) for i in range(300)]
    rows = [(i, shared) for i in range(200)] + [(900, sentence(rng, 40))]
    docs = with_key(make_docs(rows))
    windows = D.item_windows(spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS_DDL))
    tests = D.gathered_windows(windows)
    found = D.occurrences(docs, tests)
    assert found.count() == 200 * 3
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS_DDL)
    got = D.contamination(docs, bench).collect()
    want = brute(rows, items)
    assert len(got) == 200 and all((r["n_hit"], r["items"]) == want[r["id"], shared] for r in got)
