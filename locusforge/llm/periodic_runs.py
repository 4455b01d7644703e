"""Periodic runs of words by online dyadic square catching.

A square is a stretch of words followed by itself; a run is a maximal stretch
whose smallest period fits in it at least twice. The words of a text are cut
in blocks of every power of two. Once block [s, s + m) is complete, it arms
catchers for the periods 2m to 4m - 1: as words are appended, a catcher sees the
block again, at distance q, or it does not. A square of period q holds a whole
aligned block of m words in its first half, so some catcher of its level sees
it. A catcher that has seen its block compares the suffixes before both copies
backwards and then, word by word as these are appended, the words behind them.
When q words agree, a square is complete; as long as words go on agreeing, the
squares merge into one run.

Appending goes on for all documents of a slice at once: the catchers of one
level are the rows of a strided view, the words appended behind their blocks
its columns, and catchers of neighbouring blocks that see their blocks at the
same distance go on as one. Stretches are compared by 64-bit hashes of every
window of a power-of-two length, each made from two of half its length, so a
level costs a few passes over the words and a text of n words takes
O(n log n). The hash of one window in 16 sizes is kept for the comparisons.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm.common import bounded_batches, bytes_of, slices, table

# Words of the shortest run that counts.
MIN_LENGTH = 12
SLICE_BYTES = 1 << 20
# Catchers times appended words looked at in one step.
STEP = 1 << 22
# Hashes of windows of 1, 16, 256, ... words are kept.
KEPT_LEVELS = 4

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _doubled(windows: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows twice as long. Those that reach past the end are like no other."""
    out = np.arange(len(windows), dtype=np.uint64) * _M1 + np.uint64(size)
    if len(windows) > size:
        out[:-size] = _mixed(windows[:-size] * _M2 + (windows[size:] ^ (windows[size:] >> np.uint64(29))))
    return out


def _seen_again(windows: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(period, first word, end) of neighbouring blocks of ``size`` words that all stand a period later again."""
    blocks = len(windows) // size
    padded = np.concatenate((windows, np.zeros(4 * size, dtype=np.uint64)))
    own = windows[:blocks * size:size, None]
    step = max(1, STEP // blocks)
    for begin in range(0, 2 * size, step):
        width = min(step, 2 * size - begin)
        appended = np.lib.stride_tricks.as_strided(
            padded[2 * size + begin:], (blocks, width), (size * padded.itemsize, padded.itemsize))
        hit = np.flatnonzero(appended == own)
        if not len(hit):
            continue
        hit = np.sort(hit % width * blocks + hit // width)  # by period, then block
        head = np.ones(len(hit), dtype=bool)
        head[1:] = (hit[1:] != hit[:-1] + 1) | (hit[1:] % blocks == 0)
        at = np.flatnonzero(head)
        first, last = hit[at], hit[np.concatenate((at[1:] - 1, [len(hit) - 1]))]
        yield (2 * size + begin + first // blocks, first % blocks * size, (last % blocks + 1) * size)


def _extended(kept: list[tuple[int, np.ndarray]], period, first, end):
    """Compare backwards from ``first`` and forwards from ``end`` as far as words a period apart agree."""
    for size, windows in reversed(kept):
        active = np.flatnonzero(first >= size)
        while len(active):
            before = first[active] - size
            active = active[windows[before] == windows[before + period[active]]]
            first[active] -= size
            active = active[first[active] >= size]
        active = np.arange(len(end))
        while len(active):
            active = active[windows[end[active]] == windows[end[active] + period[active]]]
            end[active] += size
    return first, end


def runs_of(words: np.ndarray, longest: int, min_length: int = MIN_LENGTH
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.

    ``words`` are hashes of words; a number that stands nowhere else follows
    every document, of at most ``longest`` words.
    """
    found = []

    def report(period, first, end) -> None:
        square = (end - first >= period) & (end - first + period >= min_length)
        found.append((first[square], (end - first + period)[square], period[square]))

    windows = _mixed(words.view(np.uint64) + _M1)
    same = np.flatnonzero(words[1:] == words[:-1])
    if len(same):  # period 1: neighbouring words
        cut = np.flatnonzero(np.diff(same) > 1)
        first, end = same[np.concatenate(([0], cut + 1))], same[np.concatenate((cut, [len(same) - 1]))] + 1
        report(np.ones(len(first), dtype=np.int64), first, end)
    kept, size, level = [], 1, 0
    while 4 * size <= longest:
        if level % KEPT_LEVELS == 0:
            kept.append((size, windows))
        for period, first, end in _seen_again(windows, size):
            # Less than a block more can agree on either side.
            able = end - first + 2 * (size - 1) >= np.maximum(period, min_length - period)
            if able.any():
                report(period[able], *_extended(kept, period[able], first[able], end[able]))
        windows, size, level = _doubled(windows, size), size * 2, level + 1
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    # A stretch with period q also has period 2q: the smallest is the run's.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of all words in a row, with a number of its own after each text."""
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), dtype=np.int64, count=sum(map(len, texts)))
    return np.insert(hashes, np.cumsum([len(words) for words in texts]), np.arange(len(texts)))


Rewrite = Callable[[object, int], "np.ndarray | None"]


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs`` (doc_id, text).

    ``runs`` has start, length and period of every run, by start and period;
    ``collapsed`` is the text's words joined by one space, without those that
    some run holds after its first period. ``rewrite(doc_id, n)`` may put other
    words of the text (their numbers) in the place of its n.

    Null, empty and white texts have no words, no runs and an empty text; rows
    are independent, so repeated rows and ids get equal results. Further
    columns are not looked at. A slice of SLICE_BYTES, or one longer text,
    takes some 100 bytes of memory a word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for part in slices(batch, "raw", SLICE_BYTES):
                texts = [raw.split() for raw in part.column("raw").to_pylist()]
                if rewrite:
                    for k, name in enumerate(part.column("doc_id").to_pylist()):
                        if (order := rewrite(name, len(texts[k]))) is not None:
                            texts[k] = [texts[k][i] for i in order.tolist()]
                sizes = np.array([len(words) for words in texts], dtype=np.int64)
                begin = np.cumsum(sizes + 1) - sizes - 1
                start, length, period = runs_of(numbered(texts), int(sizes.max()), min_length)
                owner = np.searchsorted(begin, start, side="right") - 1
                start = start - begin[owner]
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                collapsed = []
                for k, words in enumerate(texts):
                    if edges[k] < edges[k + 1]:
                        own = slice(edges[k], edges[k + 1])
                        depth = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(depth, start[own] + period[own], 1)
                        np.add.at(depth, start[own] + length[own], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words))
                spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)],
                                                   fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans),
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    rows = bounded_batches(docs.select("doc_id", bytes_of().alias("raw")))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, "
                                "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def longest_run(runs: Column) -> Column:
    """struct(length, start, period) of the longest run, the first of equals; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["start"]).alias("start"),
                                             (-best["period"]).alias("period")))


def planted(doc_id, n: int) -> np.ndarray | None:
    """The order of words that makes a tenth of all documents periodic from some word on; null ids stay."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its runs, the longest of them and the text without their repeats."""
    found = collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    best = longest_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
