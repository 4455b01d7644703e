"""Quality rules with cross-document line frequency.

Each document gets counts of words, symbols, repeated lines and repeated word
windows. Its lines are normalised and hashed; for every host (the ``source``)
the documents that hold a line are counted, lines above the limit are taken
out of the texts, and a document that has lost most of its words is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm.common import bounded_batches, bytes_of, slices, stored, table, text_of

# A line in more documents of one host than both of these is boilerplate: a
# number, and a percentage of the host's documents.
MAX_DOCUMENTS = 5
MAX_PERCENT = 1
# A document that keeps a smaller share of its words is depleted.
MIN_SHARE = 0.75
# The lines of one host meet its number of documents in so many parts.
PARTS = 16
# Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

BLANKS = b" \t\n\x0b\x0c\r"
_DIGITS = bytes.maketrans(b"0123456789", b"0" * 10)


def normalised(line: bytes) -> bytes:
    """The line with A-Z in lower case, every digit 0 and single blanks between words."""
    return b" ".join(line.lower().translate(_DIGITS).split())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = raw.split()
    data = np.frombuffer(raw, dtype=np.uint8)
    histogram = np.bincount(data, minlength=256)
    blank = int(histogram[list(BLANKS)].sum())
    characters = len(raw) - int(histogram[0x80:0xC0].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        often = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
        covered = np.zeros(len(words), dtype=bool)
        for k in range(3):
            covered[k:k + len(windows)] |= often
        repeated = int(covered.sum())
    return (len(words), characters - blank, int(histogram[list(SYMBOLS)].sum()),
            len(lines) - len(set(lines)), repeated)


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of the normalised line."""
    key = xxhash.xxh64_intdigest(normalised(line))
    return key - ((key >> 63) << 64)


def line_hashes(raw: bytes) -> set[int]:
    """Hashes of the lines of a text that have words."""
    return {line_hash(line) for line in raw.split(b"\n") if line.strip()}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(id, text_hash, host, the five counts, lines): ``lines`` has the hash of each distinct line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                raws = part.column("raw").to_pylist()
                counts = list(zip(*(base_counts(raw) for raw in raws)))
                lines = [list(line_hashes(raw)) for raw in raws]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_hash"), part.column("host"),
                     *(pa.array(c, pa.int64()) for c in counts),
                     pa.array(lines, pa.list_(pa.int64()))],
                    ["id", "text_hash", "host", *COUNTS, "lines"])

    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash"),
                       F.xxhash64(F.col(host)).alias("host"), bytes_of().alias("raw"))
    id_type = rows.schema["id"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"id {id_type}, text_hash long, host long, "
                           + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<bigint>")


def lines_to_drop(rows: DataFrame, max_documents: int = MAX_DOCUMENTS, max_percent: int = MAX_PERCENT) -> DataFrame:
    """(drop_id, drop_hash, drop_host, drop): hashes of the lines that each document loses.

    ``rows`` comes from ``measured``. Documents that lose nothing have no row.
    """
    lines = rows.select("id", "text_hash", "host", F.explode("lines").alias("line"))
    hosts = rows.select("host", "id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    hosts = hosts.select("*", F.explode(F.array(*[F.lit(p).cast("long") for p in range(PARTS)])).alias("part"))
    often = (lines.select("host", "line", "id").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > max_documents).withColumn("part", F.pmod(F.xxhash64("line"), F.lit(PARTS)))
             .join(hosts, ["host", "part"]).where(100 * F.col("n") > max_percent * F.col("documents"))
             .select("host", "line"))
    return (lines.join(often, ["host", "line"])
            .groupBy(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"),
                     F.col("host").alias("drop_host"))
            .agg(F.collect_set("line").alias("drop")))


def without_lines(raw: bytes, drop: set[int]) -> bytes:
    """The text without the lines of these hashes; blank lines stay."""
    return b"\n".join(line for line in raw.split(b"\n") if not line.strip() or line_hash(line) not in drop)


def _shortened(docs: DataFrame, drops: DataFrame, host: str, how: str) -> DataFrame:
    """Rows of ``docs`` as structs, the dropped lines taken out of their text, beside their row of ``drops``."""
    @F.pandas_udf("string")
    def shortened(raws: pd.Series, drops: pd.Series) -> pd.Series:
        return pd.Series([None if drop is None else without_lines(raw, set(drop.tolist())).decode()
                          for raw, drop in zip(raws, drops)], dtype=object)

    rows = bounded_batches(docs).select(F.struct("*").alias("row"), F.col("doc_id").alias("id"),
                                        F.xxhash64(text_of()).alias("text_hash"), F.xxhash64(host).alias("host"))
    same = (F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash"))
            & (F.col("host") == F.col("drop_host")))
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(shortened(bytes_of("row.text"), F.col("drop")))
    return rows.join(drops, same, how).withColumn("row", F.col("row").withField("text", text))


def drop_frequent_lines(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS,
                        max_percent: int = MAX_PERCENT) -> DataFrame:
    """``docs`` with the lines above both limits taken out of ``text``; other columns, of any name, as they are.

    Texts that lose nothing stay as they are, null ones too. Rows with a null
    host are one host. An empty table gives an empty one.
    """
    drops = lines_to_drop(stored(measured(docs, host), "quality-measures"), max_documents, max_percent)
    return _shortened(docs, drops, host, "left").select("row.*")


def judged(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS,
           max_percent: int = MAX_PERCENT, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, the five counts, n_lost_words, base_failed, kept): one row per row of ``docs``.

    The words lost are counted on the texts without their frequent lines. Null
    and empty texts have no words and fail the base rules. Rows with a null
    host are one host. Rows with equal doc_id, text and host count as one
    document of the host and share a verdict. An empty table gives an empty
    result.
    """
    @F.pandas_udf("long")
    def count_words(raws: pd.Series) -> pd.Series:
        return pd.Series([len(raw.split()) for raw in raws], dtype="int64")

    rows = stored(measured(docs, host), "quality-measures")
    texts = docs.select("doc_id", "text", host)
    left = (_shortened(texts, lines_to_drop(rows, max_documents, max_percent), host, "inner")
            .select("drop_id", "drop_hash", "drop_host", count_words(bytes_of("row.text")).alias("words_left"))
            .distinct())
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    words_left = F.coalesce("words_left", "n_words")
    same = ((F.col("text_hash") == F.col("drop_hash")) & (F.col("host") == F.col("drop_host"))
            & F.col("id").eqNullSafe(F.col("drop_id")))
    return (rows.drop("lines").join(left, same, "left")
            .select("id", *COUNTS, (F.col("n_words") - words_left).alias("n_lost_words"), failed.alias("base_failed"),
                    (~failed & (words_left >= min_share * F.col("n_words"))).alias("kept")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base counts, the words in boilerplate lines and the verdict."""
    return judged(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         regexp_replace(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
           'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '^$', '') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM base)),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE words > 0 GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS documents FROM base GROUP BY source),
held AS (
  SELECT source, norm, count(DISTINCT doc_id) AS n FROM lines WHERE words > 0 GROUP BY source, norm),
often AS (
  SELECT held.source, norm FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source
  WHERE n > 5 AND 100 * n > documents),
lost AS (
  SELECT doc_id, sum(words) AS n_lost_words FROM lines JOIN often
  ON lines.norm = often.norm AND lines.source IS NOT DISTINCT FROM often.source GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM base LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id)),
failing AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - n_lost_words >= 0.75 * n_words AS kept FROM failing
"""
