import re

from pyspark.sql import functions as F

from locusforge.llm import quality_rules as Q

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_counts(texts):
    for text in texts:
        if len(text or "") < 20_000:
            assert Q.base_counts((text or "").encode()) == counts(text), text
    odd = "a|b ##\x85 é\xa0x\n a|b ##\n\n\x1c\n a|b ##\r\n" * 3
    assert Q.base_counts(odd.encode()) == counts(odd)


def normal(line):
    line = re.sub("[0-9]", "0", line.translate({c: c + 32 for c in range(65, 91)}))
    return " ".join(WORD.findall(line))


def test_verdicts_match_brute_force(docs):
    rows = docs.collect()
    for limit, percent, share in ((100, 0, 0.3), (1, 0, 0.6), (0, 0, 0.3), (0, 20, 0.6), (2, 15, 0.75)):
        holders, want, hosts = {}, [], {}
        for r in rows:
            hosts.setdefault(r["source"], set()).add(r["doc_id"])
            for line in (r["text"] or "").split("\n"):
                holders.setdefault((r["source"], normal(line)), set()).add(r["doc_id"])
        for r in rows:
            n, c, s, d, rep = counts(r["text"])
            lost = sum(len(WORD.findall(x)) for x in (r["text"] or "").split("\n")
                       if (k := len(holders[r["source"], normal(x)])) > limit
                       and 100 * k > percent * len(hosts[r["source"]]))
            failed = n < 50 or 100 * rep > 50 * n
            want.append(str((r["doc_id"], n, c, s, d, rep, lost, failed, not failed and n - lost >= share * n)))
        got = [str(tuple(r)) for r in Q.judged(
            docs, max_documents=limit, max_percent=percent, min_share=share).collect()]
        assert sorted(got) == sorted(want)


def test_null_host_and_empty_table(spark, no_docs):
    table = spark.createDataFrame([(i, "word " * 60 + str(i), None) for i in range(5)], "doc_id long, text string, source string")
    assert Q.judged(table, max_documents=3).count() == 5
    assert Q.judged(no_docs).count() == 0


def test_frequent_lines_are_taken_out(docs, no_docs):
    """The texts themselves, with every other column and row; no line is in more documents than the limit."""
    rows = docs.collect()
    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            holders.setdefault((r["source"], normal(line)), set()).add(r["doc_id"])
    want = []
    for r in rows:
        text = r["text"] and "\n".join(x for x in r["text"].split("\n") if not normal(x)
                                       or len(holders[r["source"], normal(x)]) <= 1)
        want.append(str(tuple({**r.asDict(), "text": text}.values())))
    clashing = ["drop", "drop_id", "drop_hash", "drop_host", "id", "host", "row", "part"]
    docs = docs.select("*", *[F.lit(c).alias(c) for c in clashing if c not in ("id",)])
    want = [w[:-1] + "".join(f", {c!r}" for c in clashing[:4] + clashing[5:]) + ")" for w in want]
    rows = docs.collect()
    out = Q.drop_frequent_lines(docs, max_documents=1, max_percent=0)
    assert out.schema == docs.schema
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(want) != sorted(str(tuple(r)) for r in rows)
    assert Q.drop_frequent_lines(no_docs).count() == 0


def test_planted_boilerplate_with_the_default_limits(spark):
    """Beyond 5 documents and 1 % of one host the shared line goes, and a document of little else is rejected."""
    shared = "Accept all cookies " * 4 + " ".join(f"menu{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))
    own = " ".join(f"word{chr(97 + i)}" for i in range(10))
    filler = " ".join(f"other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(f"{own} {host}{chr(97 + i)}\n{shared}" if i < holders else
             f"{filler} {host} x{chr(97 + i % 26)}{chr(97 + i // 26)}", host)
            for host, n, holders in (("hot", 40, 6), ("cool", 40, 5), ("large", 600, 7), ("larger", 700, 7))
            for i in range(n)]
    got = Q.judged(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)],
                                         "doc_id long, text string, source string"))
    verdicts = {(rows[r["id"]][1], r["n_lost_words"] > 0, r["kept"]) for r in got.collect()}
    assert verdicts == {("hot", True, False), ("hot", False, True), ("cool", False, True), ("large", True, False),
                        ("large", False, True), ("larger", False, True)}


def test_the_sql_row_holds_documents_rejected_by_the_method(spark):
    got = Q.op8_quality_rules(spark, "/root/testdata/sf0.01")
    assert got.where("NOT base_failed AND NOT kept").count() > 0
