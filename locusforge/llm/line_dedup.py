"""Line dedup over all documents, with DataFrame functions only.

Line hashes are range-partitioned with a secondary sort by document and
position; a window streams over each hash and marks where a document first
holds it. What comes back for a document is not its text but a run-length
compressed bitmap of the lines to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusforge.llm.common import join_documents, lower_ascii, stored, table, text_of, with_key

# Fixed value: the white space that is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"

MIN_KEY_LENGTH = 40
MIN_DOCUMENTS = 5
# A frequent line is streamed in so many parts, by document.
PARTS = 32


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, min_length: int = MIN_KEY_LENGTH) -> DataFrame:
    """(id, text_hash, part, position, h1, h2): one row per line whose key is long enough.

    The key is the line without white space at its ends and with A-Z in lower
    case; 128 bits of hash stand for it. ``part`` is a number of the document.
    """
    lines = docs.select("id", "text_hash", F.posexplode(lines_of(F.col("text"))).alias("position", "line"))
    lines = (lines.where(F.char_length("line") >= min_length)
             .withColumn("key", F.btrim("line", F.lit(BLANKS)))
             .where(F.char_length("key") >= min_length)
             .withColumn("key", lower_ascii(F.col("key"))))
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")
    return lines.select("id", "text_hash", part, "position", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_keys(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(h1, h2, part, keep_id): keys found in enough documents and the largest doc_id holding each.

    Hash ranges are cut by the documents' part too, so that a line that a third
    of all documents hold is spread over PARTS ranges. Inside a range the
    window sees each key sorted by document and position and marks the first
    line of every document; the marks are summed before the parts of a key
    meet. A key is returned once for each part that holds it, so that lines
    and keys can meet part by part.
    """
    ranged = lines.repartitionByRange("h1", "h2", "part")
    stream = W.partitionBy("h1", "h2", "part").orderBy(F.col("id").desc(), "position")
    first = ((F.row_number().over(stream) == 1)
             | ~F.col("id").eqNullSafe(F.lag("id").over(stream)))
    parts = (ranged.withColumn("first", first).where("first").groupBy("h1", "h2", "part")
             .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id")))
    keys = (parts.groupBy("h1", "h2").agg(F.sum("n").alias("n_documents"), F.max("last_id").alias("keep_id"))
            .where(F.col("n_documents") >= min_documents).select("h1", "h2", "keep_id"))
    return parts.select("h1", "h2", "part").join(keys, ["h1", "h2"])


def runs_of(positions: Column) -> Column:
    """Run-length form of a sorted array of positions: array<struct<start, length>>."""
    starts = F.filter(positions, lambda x, i: (i == 0) | (F.get(positions, i - 1) != x - 1))
    ends = F.filter(positions, lambda x, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def positions_of(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))


def drop_bitmaps(docs: DataFrame, min_length: int = MIN_KEY_LENGTH,
                 min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id, text_hash, dropped): the run-length bitmap of each document that loses lines.

    ``docs`` comes from ``with_key``. Documents that lose nothing have no row.
    """
    lines = stored(line_hashes(docs, min_length), "line-hashes")
    keys = repeated_keys(lines, min_documents)
    return (lines.join(keys, ["h1", "h2", "part"]).where(~F.col("id").eqNullSafe(F.col("keep_id")))
            .groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("position")).alias("positions"))
            .select("id", "text_hash", runs_of(F.col("positions")).alias("dropped")))


def apply_bitmap(text: Column, dropped: Column) -> Column:
    """The lines that a bitmap keeps, joined by newlines; a null bitmap keeps all.

    The split text is bound to a lambda's variable: it is made once, however
    many lines are read from it.
    """
    def joined(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions_of(dropped))
        return F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")

    return F.when(dropped.isNull(), text).otherwise(F.get(F.transform(F.array(lines_of(text)), joined), F.lit(0)))


def n_dropped(dropped: Column) -> Column:
    return F.coalesce(F.aggregate(dropped, F.lit(0).cast("long"), lambda n, r: n + r["length"]), F.lit(0))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; other columns as they are.

    A null or empty text has one empty line and stays as it is. Rows with a
    null doc_id are one document, smaller than any other. Equal rows lose the
    same lines. Extra columns of any name pass through; an empty table gives
    an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash"))
    joined = join_documents(rows, drop_bitmaps(with_key(docs)), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(
        apply_bitmap(F.col("row.text"), F.col("dropped")))
    return joined.select(F.col("row").withField("text", kept).alias("row")).select("row.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before dropping, lines dropped, SHA-256 of what stays."""
    docs = with_key(table(spark, sf_dir, "documents"))
    bitmaps = drop_bitmaps(docs)
    return (join_documents(docs, bitmaps, "left")
            .select(F.col("id").alias("doc_id"),
                    F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
                    n_dropped(F.col("dropped")).alias("n_dropped"),
                    F.sha2(apply_bitmap(F.col("text"), F.col("dropped")).cast("binary"), 256).alias("kept_sha256")))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents)),
keys AS (
  SELECT key, max(doc_id) AS keep_id FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keep_id AS gone
  FROM lines l LEFT JOIN keys k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
