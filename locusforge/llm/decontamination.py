"""Benchmark decontamination by winnowing, with DataFrame functions only.

Training and test texts are cut to words, hashed as k-grams and winnowed: of
every run of consecutive k-grams the smallest hash is kept. A span of
``length`` words shared by a document and an item then shares at least one
kept hash, so the join on kept hashes loses no span. Hits are extended to the
words of the document: the windows around a shared hash are compared as text
with the windows of the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusforge.llm.common import join_documents, lower_ascii, stored, table, text_of, with_key

# Fixed value: what separates words once A-Z is in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WINDOW = 13
GRAM = 8
# Parts in which documents meet their items.
PARTS = 8
MIN_SHARE = 20  # contaminated when at least one word in so many is hit


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _grams(words: Column, size: int) -> Column:
    """Hash of every run of ``size`` words."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(
        starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))


def winnowed(hashes: Column, span: int) -> Column:
    """The smallest of every ``span`` consecutive hashes, in order."""
    if span == 1:
        return hashes
    starts = F.sequence(F.lit(0), F.size(hashes) - span)
    return F.when(F.size(hashes) >= span, F.transform(
        starts, lambda i: F.least(*[F.get(hashes, i + k) for k in range(span)])))


def with_fingerprints(df: DataFrame, length: int) -> DataFrame:
    """Add ``minima``: one winnowed hash for every window of ``length`` words."""
    size = min(GRAM, length)
    return (df.withColumn("grams", _grams(F.col("words"), size))
            .withColumn("minima", winnowed(F.col("grams"), length - size + 1)).drop("grams"))


def _span(length: int):
    """Lambda from a start to the text of the window there."""
    return lambda start: F.array_join(F.slice(F.col("words"), start + 1, length), " ")


def item_windows(items: DataFrame) -> DataFrame:
    """(item, length, print, window): the windows of all items and their fingerprints.

    An item of fewer than WINDOW words is one window of its own length; an
    item without words has none.
    """
    worded = (items.select(F.col("item_id").cast("string").alias("item"), words_of(text_of()).alias("words"))
              .withColumn("length", F.least(F.lit(WINDOW), F.size("words"))))
    parts = []
    for length in range(1, WINDOW + 1):
        cut = with_fingerprints(worded.where(F.col("length") == length), length)
        spans = F.transform(F.sequence(F.lit(0), F.size("words") - length), _span(length))
        parts.append(cut.select("item", "length", F.explode(F.arrays_zip(
            F.col("minima").alias("print"), spans.alias("window"))).alias("w")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("item", "length", F.col("w.print").alias("print"), F.col("w.window").alias("window"))


def gathered_windows(windows: DataFrame) -> DataFrame:
    """(length, window, print, items, found): every distinct window with its items, sorted; ``found`` names the list.

    The items of a window are gathered before documents meet it: an occurrence
    carries the name of a list, not a row per item.
    """
    return (windows.groupBy("length", "window", "print").agg(F.array_sort(F.collect_set("item")).alias("items"))
            .withColumn("found", F.sha2(F.to_json("items"), 256)))


def occurrences(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, text_hash, start, length, found): every occurrence of a window in a document.

    ``docs`` comes from ``with_key``, ``tests`` from ``gathered_windows``.
    """
    # At most WINDOW rows: the window lengths that the items really have.
    lengths = sorted(r["length"] for r in tests.select("length").distinct().collect())
    worded = docs.select("id", "text_hash", words_of(F.col("text")).alias("words"))
    found = None
    for length in lengths:
        prints = tests.where(F.col("length") == length).select("print").distinct()
        hits = (with_fingerprints(worded, length)
                .select("id", "text_hash", F.explode(F.array_distinct("minima")).alias("print"))
                .join(prints, "print").select("id", "text_hash", F.lit(length).alias("length"), "print"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select("id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("length"),
                           F.lit("").alias("found")).where("false")
    suspects = stored(found.groupBy("id", "text_hash", "length").agg(F.collect_set("print").alias("prints")),
                      "suspects")
    spans = None
    for length in lengths:
        own = suspects.where(F.col("length") == length).select("id", "text_hash", "prints")
        cut = with_fingerprints(
            join_documents(docs, own).select(
                "id", "text_hash", words_of(F.col("text")).alias("words"), "prints"), length)
        near = F.filter(F.sequence(F.lit(0), F.size("minima") - 1),
                        lambda i: F.array_contains(F.col("prints"), F.get(F.col("minima"), i)))
        part = (cut.withColumn("near", near)
                .select("id", "text_hash", F.explode(F.arrays_zip(
                    F.col("near").alias("start"), F.transform("near", _span(length)).alias("window"))).alias("w"))
                .select("id", "text_hash", F.col("w.start").alias("start"), F.lit(length).alias("length"),
                        F.col("w.window").alias("window")))
        spans = part if spans is None else spans.unionByName(part)
    return (spans.join(tests.select("length", "window", "found"), ["length", "window"])
            .select("id", "text_hash", "start", "length", "found"))


def hit_documents(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, text_hash, n_hit, found): hit words of each hit document and the names of its lists of items.

    Words under several windows count once: windows are taken in order of
    their start and each adds what lies beyond the furthest end so far.
    """
    spans = occurrences(docs, tests).distinct()
    order = W.partitionBy("id", "text_hash").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    reached = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    return (spans.withColumn("fresh", fresh).groupBy("id", "text_hash")
            .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("found")).alias("found")))


def _named_items(hits: DataFrame, tests: DataFrame, shown: dict[str, Column]) -> DataFrame:
    """``hits`` with columns made from the sorted ``items`` of a document, computed once for equal ``found``.

    Documents that hit the same lists, as copies do, share one row of items; it
    is repeated PARTS times, so that a set that a third of all documents hit is
    joined in as many tasks.
    """
    named = hits.withColumn("union", F.sha2(F.array_join("found", ","), 256))
    lists = tests.groupBy("found").agg(F.first("items").alias("items"))
    unions = (named.select("union", "found").dropDuplicates(["union"])
              .select("union", F.explode("found").alias("found")).join(lists, "found")
              .groupBy("union").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
              .select("union", *[c.alias(n) for n, c in shown.items()],
                      F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")))
    dealt = named.withColumn("part", F.pmod(F.xxhash64("id", "text_hash"), F.lit(PARTS)).cast("int"))
    return dealt.join(unions, ["union", "part"]).select("id", "text_hash", "n_hit", *shown)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, text_hash, n_hit, items): hit words and sorted item ids of each hit document."""
    tests = stored(gathered_windows(item_windows(items)), "item-windows")
    hits = stored(hit_documents(docs, tests), "hit-documents")
    return _named_items(hits, tests, {"items": F.col("items")})


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * MIN_SHARE >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; all columns as they are.

    Null and empty texts have no words and stay. Rows with equal doc_id and
    text share one verdict; a null doc_id is an id like any other. Items that
    are null or without words match nothing; an item whose id is null hits
    words but is not listed. Without items all documents stay.
    """
    keyed = with_key(docs)
    hits = hit_documents(keyed, stored(gathered_windows(item_windows(items)), "item-windows"))
    n_words = F.size(words_of(F.col("text")))
    bad = (join_documents(keyed, hits).where(is_contaminated(F.col("n_hit"), n_words))
           .select(F.col("id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"])
                     & (F.xxhash64(text_of()) == bad["_bad_hash"]), "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items found and the verdict."""
    docs = with_key(table(spark, sf_dir, "documents"))
    tests = stored(gathered_windows(item_windows(table(spark, sf_dir, "benchmark"))), "item-windows")
    hits = _named_items(stored(hit_documents(docs, tests), "hit-documents"), tests, {
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)})
    counted = docs.select("id", "text_hash", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    no_items = F.sha2(F.lit("").cast("binary"), 256)
    return (join_documents(counted, hits, "left")
            .select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.coalesce("items_sha256", no_items).alias("items_sha256"),
                    is_contaminated(n_hit, F.col("n_words")).alias("contaminated")))


OP9_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM spans JOIN windows USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
