import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from locusforge.llm import conversation_repair as C

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
DDL = "conv_id long, turn long, role string, text string, audit string, h1 int, n string, part string, kind string"
PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) by plain search over (role, text, fault): states are initials so far, cut short."""
    # state: the last two initials decide, "" / s / u / a; no matrices, no grammar.
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, kept) in list(out.items()):
                for c in follows[state].replace("s", ""):
                    way = (cost + 5, audit + "I", (*kept, f"{names[c]}:"))
                    if c not in out or way[:2] < out[c][:2]:
                        out[c] = way
        return out

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, kept) in inserted(ways).items():
            options = [(state, 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] and role[0] in follows[state]:
                    options.append((role[0], extra, "K", (f"{role}:{text}",)))
                options += [(c, 1 + extra, "R", (f"{names[c]}:{text}",)) for c in follows[state].replace("s", "")]
            for to, more, letter, row in options:
                way = (cost + more, audit + letter, kept + row)
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        ways = new
    return min((w for s, w in inserted(ways).items() if s in ("", "a")), key=lambda w: w[:2])


def expected(rows):
    """The summary of one conversation's rows (turn, role, text), in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, kept = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    assert PATTERN.fullmatch("".join(k[0] for k in kept))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, list(kept))


def test_search_itself_against_all_audits():
    """The test's own search, against every string of edits of a few rows."""
    def replay(audit, rows):
        state, cost, at, names = "", 0, 0, {"": "u", "s": "u", "u": "a", "a": "u"}
        for c in audit:
            if c == "I":
                state, cost = names[state], cost + 5
                continue
            role, _, fault = rows[at]
            at += 1
            if c == "D":
                cost += 2
                continue
            if fault in ("blank", "duplicate"):
                return None
            to = names[state] if c == "R" else role[:1]
            if c == "K" and not (to == names[state] or (to == "s" and state == "")):
                return None
            state, cost = to, cost + (c == "R") + 5 * (fault == "truncated")
        return cost if at == len(rows) and state in ("", "a") else None

    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice([None, None, "truncated", "blank"]))
                for _ in range(rng.randrange(4))]
        found = []
        for n in range(len(rows) + 4):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(c != "I" for c in audit) == len(rows) and (cost := replay(audit, rows)) is not None:
                    found.append((cost, "".join(audit)))
        assert min(found) == cheapest(rows)[:2]


@pytest.mark.parametrize("min_count", [2, 16])
def test_grammar_gives_the_cheapest_edits(min_count):
    rng = random.Random(min_count)
    roles, faults = ["system", "user", "assistant", "tool"], [None, "truncated"]
    sequences = [[rng.choice([0, 1, 2, 1, 2, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(14))] for _ in range(300)]
    sequences += [[1, 2] * 300 + [8] * 50 + [2, 1] * 100, [8] * 200, [3] * 99, [5] * 64, [0] * 40]
    solved = C.solve([np.array(s, dtype=np.uint8) for s in sequences], [k % 2 == 0 for k in range(len(sequences))], min_count)
    for symbols, matrix in zip(sequences, solved):
        rows = [("user", "", "blank") if s == C.DROP else (roles[s % 4], "x", faults[s // 4]) for s in symbols]
        cost, audit = C.best(matrix[0])
        assert (cost, str(audit)) == cheapest(rows)[:2]


def test_ropes_compare_like_strings():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ("".join(rng.choice("DIKR") for _ in range(rng.randrange(12))) for _ in range(2))
        head = "".join(rng.choice("DK") for _ in range(rng.randrange(130)))

        def rope(text):
            out = C.Rope("")
            while text:
                k = rng.randrange(1, len(text) + 1)
                out, text = out + C.Rope(text[:k]), text[k:]
            return out
        x, y = rope(head + a), rope(head + b)
        assert (x < y, y < x, str(x)) == (head + a < head + b, head + b < head + a, head + a)


@pytest.fixture(scope="module")
def rows():
    """Conversations with all faults, null fields, equal rows, one of a third of all rows."""
    rng = random.Random(2)
    texts = ["Fine.", "Good!", "Why?  \n", "cut", "", " \t", "cut off,", None, "日本。", "é?"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"]
    out = []
    for conv in range(60):
        start = rng.randrange(5)
        for turn in range(rng.randrange(1, 9)):
            if rng.random() < 0.85:
                out.append((conv, start + turn, rng.choice(roles[:5]) if conv % 2 else roles[turn % 2], rng.choice(texts[:5])))
    out += [(None, 1, "user", "Hi."), (None, 2, None, "x."), (None, None, "assistant", None), (100, None, "user", "A."),
            (100, None, "user", "A."), (101, 5, "user", "Same."), (101, 5, "user", "Same."), (101, 9, "user", "Same.")]
    out += [(200, t, roles[t % 10], rng.choice(texts)) for t in range(0, 500, 2)] + [(200, 3, "user", "again")] * 40
    rng.shuffle(out)
    return out


def grouped(rows, order):
    """Rows by conversation, null roles and texts as one space, in the operator's order of equal turns."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, order(r))):
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "n", "p", "k") for r in rows], DDL).repartition(3)
    places = {(r["conv_id"], r["turn"], r["role"], r["text"]): (r["role"], r["h1"], r["h2"])
              for r in C._rows(frame).collect()}
    want = {k: expected(v) for k, v in grouped(rows, lambda r: places[
        (r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3])]).items()}
    summary, repaired = C.repair_conversations(frame)
    got = {r[0]: tuple(r)[1:] for r in summary.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    kept = {}
    for r in sorted(repaired.collect(), key=lambda r: r["position"]):
        kept.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert kept == {k: v[-1] for k, v in want.items() if v[-1]}


def test_against_plain_search(spark, rows):
    check(spark, rows)


def test_long_conversations_are_cut(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 8)
    monkeypatch.setattr(C, "GRAMMAR", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    summary, repaired = C.repair_conversations(spark.createDataFrame([], DDL))
    assert summary.count() == repaired.count() == 0


def test_query(spark):
    given = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    rows = []
    for r in given:
        hit = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = "user" if hit == 4 else r["role"], "" if hit == 1 else r["text"]
        text = re.sub(r"[.!?]", "", text) if hit == 2 else text
        rows += [(r["conv_id"], r["turn"], role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    want = {k: expected(v) for k, v in grouped(rows, lambda r: ()).items()}
    out = C.op13_conversation_repair(spark, FOLDER).collect()
    assert {r["conv_id"] for r in out} == {r["conv_id"] for r in given} and len(out) == len({r["conv_id"] for r in given})
    for r in out:
        *summary, kept = want.get(r["conv_id"], (0, 0, 0, 0, 0, 0, "", []))
        assert tuple(r)[1:8] == tuple(summary)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
