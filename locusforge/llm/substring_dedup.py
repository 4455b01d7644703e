"""Removal of repeated byte strings, by suffix arrays per shard.

A byte goes if some 100-byte string that covers it also starts earlier: in a
document of smaller doc_id, or earlier in the same one. Every string is
assigned to the smallest hash among its 32-byte grams (its anchor), so equal
strings have equal anchors at the same place. Neighbouring strings with one
anchor make a segment of less than 170 bytes, and only segments leave their
document:

1. Tasks emit segments as hashes (anchor, content). Equal segments of a task
   are emitted once; the later ones repeat whole.
2. By anchor, equal segments of all tasks meet: all but the first repeat whole.
   Anchors of one segment are done. Those with different segments are unsettled.
3. The bytes of unsettled segments (first occurrences only) are fetched and
   gathered by anchor in shards of bounded size. A suffix array of each shard
   (Larsson-Sadakane) with common prefixes (Kasai) shows which strings repeat.
   An anchor with very many segments is spread over several shards, whose
   sorted strings are merged by binary search.
4. Documents meet their repeated strings and lose the bytes these cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm.common import bounded_batches, bytes_of, slices, stored, table, text_of
from locusforge.llm.suffix_array import common_prefixes, merged_firsts, suffix_array

LENGTH = 100
GRAM = 32
# Bytes of text whose segments are compared inside a task before they are emitted.
TASK_BYTES = 32 << 20
# Bytes whose anchors are found at a time; their places must fit 26 bits.
SLICE_BYTES = 2 << 20
# Segment bytes of a suffix array.
SHARD_BYTES = 1 << 20
# Segments of one anchor in one part; an anchor with more has several parts.
PART_SEGMENTS = 4096
# The strings of a large anchor are merged in so many slots, by their hash.
MERGE_SLOTS = 1024
ROWS_AT_ONCE = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- segments -------------------------------------------------------------
def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    h, size, power = values[data], 1, int(_ODD)
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = size * 2, power * power % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string's start, number of strings) of every segment.

    ``data`` holds whole documents one after the other; ``ends`` are their ends.
    Data of more than SLICE_BYTES is worked on in pieces that share LENGTH - 1
    bytes, so every string is whole in one piece and places fit their bits. A
    segment that a piece's end cuts is put together again.
    """
    if len(data) <= SLICE_BYTES:
        anchor, start, n, _ = _segments(data, ends)
        return anchor, start, n
    found = []
    for begin in range(0, len(data) - LENGTH + 1, SLICE_BYTES - LENGTH + 1):
        piece = data[begin:begin + SLICE_BYTES]
        inner = ends[(ends > begin) & (ends < begin + len(piece))] - begin
        anchor, start, n, place = _segments(piece, np.append(inner, len(piece)))
        found.append((anchor, start + begin, n, place + begin))
    anchor, start, n, place = (np.concatenate(x) for x in zip(*found))
    # One anchor at one place: the parts of a segment on both sides of a cut.
    head = np.ones(len(start), dtype=bool)
    head[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + n[:-1]) | np.isin(start[1:], ends)
    at = np.flatnonzero(head)
    return anchor[at], start[at], np.add.reduceat(n, at) if len(at) else n


def _segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of one piece, and the place of each one's anchor."""
    empty = np.empty(0, dtype=np.int64)
    if len(data) < LENGTH:
        return empty.astype(np.uint64), empty, empty, empty
    hashes = _gram_hashes(data)
    # The smallest hash of a string's grams; of equal ones the leftmost.
    low = np.uint64((1 << 26) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[:len(best) - (width - span)], best[width - span:])
    anchor = (best & low).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:len(anchor)] > 0)
    if not len(at):
        return empty.astype(np.uint64), empty, empty, empty
    own = anchor[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (np.diff(at) != 1)
    # Two documents side by side: strings of one do not run on into the other.
    new |= np.isin(at, starts)
    heads = np.flatnonzero(new)
    return hashes[own[heads]], at[heads], np.diff(np.concatenate((heads, [len(at)]))), own[heads]


# A document is its id and its tag, the hash of its text, which tells texts that
# share a doc_id apart.
SEGMENT_DDL = "kind int, anchor long, content long, id long, tag long, pos long, n long"
_COLUMNS = ["kind", "anchor", "content", "id", "tag", "pos", "n"]
REPEATED, OPEN = 0, 1  # kinds of rows: strings that repeat; a segment still to be compared


def _rows(kind: int, ident, tag, pos, n, anchor=None, content=None) -> pa.RecordBatch:
    none = np.zeros(len(pos), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(pos), kind, dtype=np.int32)), pa.array(none if anchor is None else anchor),
         pa.array(none if content is None else content), pa.array(ident), pa.array(tag), pa.array(pos),
         pa.array(n.astype(np.int64))], _COLUMNS)


def _joined(ident, tag, pos, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that follow each other in one document, as one run each."""
    order = np.lexsort((pos, tag, ident))
    ident, tag, pos, n = ident[order], tag[order], pos[order], n[order]
    head = np.ones(len(pos), dtype=bool)
    head[1:] = (ident[1:] != ident[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
    at = np.flatnonzero(head)
    return ident[at], tag[at], pos[at], np.add.reduceat(n, at) if len(at) else n


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: segments of a task's documents, equal ones once."""
    held: list[tuple] = []
    names: list[tuple] = []  # (ids, tags) of the documents, which are numbered as they come
    size = count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids, tags = (np.concatenate(x) for x in zip(*names))
        by_name = np.lexsort((tags, ids))
        ids, tags = ids[by_name], tags[by_name]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
        rank = np.empty(len(ids), dtype=np.int64)
        rank[by_name] = np.cumsum(new) - 1  # equal rows are one document
        ids, tags = ids[new], tags[new]
        anchor, content, doc, pos, n = (np.concatenate(x) for x in zip(*held))
        doc = rank[doc]
        order = np.lexsort((pos, doc, content, anchor))
        anchor, content, doc, pos, n = (x[order] for x in (anchor, content, doc, pos, n))
        same = np.zeros(len(pos), dtype=bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        again = same.copy()
        again[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
        back = same & ~again
        yield _rows(REPEATED, *_joined(ids[doc[back]], tags[doc[back]], pos[back], n[back]))
        at = np.flatnonzero(~same)
        for i in range(0, len(at), ROWS_AT_ONCE):
            j = at[i:i + ROWS_AT_ONCE]
            yield _rows(OPEN, ids[doc[j]], tags[doc[j]], pos[j], n[j], anchor[j], content[j])

    for batch in batches:
        for part in slices(batch, "raw", SLICE_BYTES):
            raws = part.column("raw").to_pylist()
            joined = b"".join(raws)
            ends = np.cumsum(np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)))
            anchor, start, n = segments(np.frombuffer(joined, dtype=np.uint8), ends)
            digest = xxhash.xxh3_64_intdigest
            view = memoryview(joined)
            content = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist())),
                                  dtype=np.uint64, count=len(start))
            doc = np.searchsorted(ends, start, side="right")
            begin = np.concatenate(([0], ends[:-1]))
            held.append((anchor.view(np.int64), content.view(np.int64), count + doc, start - begin[doc], n))
            names.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag")))
            size, count = size + len(joined), count + len(raws)
            if size >= TASK_BYTES:
                yield from flush()
                held, names, size, count = [], [], 0, 0
    if held:
        yield from flush()


def _settle(batches: Iterator[pa.RecordBatch], part_segments: int = PART_SEGMENTS) -> Iterator[pa.RecordBatch]:
    """Step 2: rows sorted by (kind, anchor, content, id, tag, pos); whole repeats and unsettled segments.

    Only the last row and the number of segments of the anchor at hand are
    kept from batch to batch, so an anchor of any size streams through. The
    content of an unsettled row becomes the part of the anchor it belongs to.
    """
    last = None      # (anchor, content, id, tag, pos) of the last row
    count = 0        # segments of its anchor so far
    pending = None   # its first segment, as long as it is the only one
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        done = int(np.searchsorted(kind, OPEN))
        if done:
            yield batch.slice(0, done)
        anchor, content, ident, tag, pos, n = (batch.column(c).to_numpy()[done:] for c in _COLUMNS[1:])
        if not len(pos):
            continue
        goes_on = last is not None and last[0] == anchor[0]
        new_anchor, new, again = (np.ones(len(pos), dtype=bool) for _ in range(3))
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_anchor[0] = not goes_on
        new[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        new[0] = not goes_on or last[1] != content[0]
        again[1:] = (~new[1:] & (ident[1:] == ident[:-1]) & (tag[1:] == tag[:-1]) & (pos[1:] == pos[:-1]))
        again[0] = not new[0] and last[2:] == (ident[0], tag[0], pos[0])
        group = np.cumsum(new_anchor)
        fresh = np.bincount(group[new], minlength=int(group[-1]) + 1)
        earlier = np.zeros(len(fresh), dtype=np.int64)
        earlier[0] = count if goes_on else 0
        total = fresh + earlier
        before_group = np.concatenate(([0], np.cumsum(fresh)[:-1]))
        inner = np.cumsum(new) - 1 - before_group[group] + earlier[group]
        if pending is not None:
            if goes_on and total[0] > 1:
                yield pending
                pending = None
            elif group[-1] > 0:
                pending = None
        back = ~new & ~again
        if back.any():
            yield _rows(REPEATED, ident[back], tag[back], pos[back], n[back])
        unsettled = new & (total[group] > 1)
        if unsettled.any():
            yield _rows(OPEN, ident[unsettled], tag[unsettled], pos[unsettled], n[unsettled], anchor[unsettled],
                        inner[unsettled] // part_segments)
        if total[-1] == 1 and fresh[-1] == 1:
            at = np.flatnonzero(new)[-1:]
            pending = _rows(OPEN, ident[at], tag[at], pos[at], n[at], anchor[at], np.zeros(1, dtype=np.int64))
        count = int(total[-1])
        last = (int(anchor[-1]), int(content[-1]), ident[-1], tag[-1], pos[-1])


# --- strings --------------------------------------------------------------
STRING = 2  # kind of row: the first place of a string in one part of a large anchor


def repeats_in_shard(raws: list[bytes], ident: np.ndarray, tag: np.ndarray, pos: np.ndarray, n: np.ndarray):
    """Strings of some segments that start earlier in another segment or document.

    Returns (segment, offset) of the repeats, and of the first places of all
    strings.
    """
    text = np.frombuffer(b"".join(raws), dtype=np.uint8)
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    begin = np.cumsum(sizes) - sizes
    order = suffix_array(text, LENGTH)
    group = np.cumsum(common_prefixes(text, order, LENGTH) < LENGTH)
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n, -1)
    starts_string = np.cumsum(edge)[:len(text)] > 0
    wanted = starts_string[order]
    at, group = order[wanted], group[wanted]
    segment = np.searchsorted(begin, at, side="right") - 1
    offset = at - begin[segment]
    place = pos[segment] + offset
    rank = np.lexsort((place, tag[segment], ident[segment], group))
    segment, offset, place, group = segment[rank], offset[rank], place[rank], group[rank]
    owner, text_tag = ident[segment], tag[segment]
    first = np.ones(len(group), dtype=bool)
    first[1:] = group[1:] != group[:-1]
    again = np.zeros(len(group), dtype=bool)
    again[1:] = (~first[1:] & (owner[1:] == owner[:-1]) & (text_tag[1:] == text_tag[:-1])
                 & (place[1:] == place[:-1]))
    later = ~first & ~again
    return (segment[later], offset[later]), (segment[first], offset[first])


_STRING_COLUMNS = ["kind", "anchor", "part", "id", "tag", "pos", "n", "string"]
STRING_DDL = "kind int, anchor long, part long, id long, tag long, pos long, n long, string binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: a suffix array for every shard of segments, cut where an anchor's part ends."""
    def shard(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        ident, tag, pos, n, anchor, part = (rows.column(c).to_numpy()
                                            for c in ("id", "tag", "pos", "n", "anchor", "part"))
        raws, large = rows.column("raw").to_pylist(), rows.column("large").to_numpy(zero_copy_only=False).astype(bool)
        (seg, off), (first_seg, first_off) = repeats_in_shard(raws, ident, tag, pos, n)
        found = _joined(ident[seg], tag[seg], pos[seg] + off, np.ones(len(seg), dtype=np.int64))
        yield _strings(REPEATED, *found)
        merge = large[first_seg]
        seg, off = first_seg[merge], first_off[merge]
        for i in range(0, len(seg), ROWS_AT_ONCE):
            s, o = seg[i:i + ROWS_AT_ONCE], off[i:i + ROWS_AT_ONCE]
            yield _strings(STRING, ident[s], tag[s], pos[s] + o, np.ones(len(s), dtype=np.int64), anchor[s], part[s],
                           [raws[a][b:b + LENGTH] for a, b in zip(s.tolist(), o.tolist())])

    held, size, last = [], 0, None
    for batch in batches:
        anchor, part = batch.column("anchor").to_numpy(), batch.column("part").to_numpy()
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
        sizes = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy() + LENGTH - 1)))
        begin = 0
        for cut in [*([0] if last is not None and len(anchor) and last != (anchor[0], part[0]) else []),
                    *cuts.tolist()]:
            if size + sizes[cut] - sizes[begin] >= SHARD_BYTES:
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                if held:
                    yield from shard(held)
                held, size, begin = [], 0, cut
        if begin < len(anchor):
            held.append(batch.slice(begin))
            size += int(sizes[-1] - sizes[begin])
            last = (anchor[-1], part[-1])
    if held:
        yield from shard(held)


def _strings(kind: int, ident, tag, pos, n, anchor=None, part=None, strings=None) -> pa.RecordBatch:
    none = np.zeros(len(pos), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(pos), kind, dtype=np.int32)), pa.array(none if anchor is None else anchor),
         pa.array(none if part is None else part), pa.array(ident), pa.array(tag), pa.array(pos), pa.array(n),
         pa.array([None] * len(pos) if strings is None else strings, pa.binary())], _STRING_COLUMNS)


def _merge(rows: pa.Table) -> pa.Table:
    """Merge the sorted strings of an anchor's parts; later places of a string repeat it."""
    part = rows.column("part").to_numpy()
    place = np.column_stack([rows.column(c).to_numpy() for c in ("id", "tag", "pos")])
    strings = np.array(rows.column("string").to_pylist(), dtype=f"S{LENGTH}")
    known, first, out = strings[:0], place[:0], []
    for number in np.unique(part):
        own = np.flatnonzero(part == number)
        own = own[np.argsort(strings[own], kind="stable")]
        at = merged_firsts(known, strings[own])
        old = np.flatnonzero(at >= 0)
        a, b = at[old], own[old]
        theirs, ours = first[a], place[b]
        differ = theirs != ours
        column = np.argmax(differ, axis=1)  # the first of id, tag and pos in which they differ
        line = np.arange(len(a))
        earlier = differ.any(axis=1) & (ours[line, column] < theirs[line, column])
        # The later of the two places repeats the string, the earlier one stays known.
        out.append(np.where(earlier[:, None], theirs, ours)[differ.any(axis=1)])
        first = first.copy()
        first[a[earlier]] = ours[earlier]
        new = own[at < 0]
        spot = np.searchsorted(known, strings[new])
        known, first = np.insert(known, spot, strings[new]), np.insert(first, spot, place[new], axis=0)
    repeats = np.concatenate(out)
    return pa.table({**{c: pa.array(repeats[:, k], pa.int64()) for k, c in enumerate(("id", "tag", "pos"))},
                     "n": pa.array(np.ones(len(repeats)), pa.int64())})


# --- documents ------------------------------------------------------------
def keyed_documents(docs: DataFrame) -> DataFrame:
    """(id, tag, raw): doc_id as a whole number (null: smaller than any), the text's 64-bit hash and bytes."""
    smallest = F.lit(-(1 << 63))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), smallest).alias("id"),
                       F.xxhash64(text_of()).alias("tag"), bytes_of().alias("raw"), F.col("doc_id"))


def repeated_strings(keyed: DataFrame, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """(id, tag, start, n): runs of n repeated strings, the first starting at byte ``start``."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _settle(batches, part_segments)

    rows = bounded_batches(keyed.select("id", "tag", "raw")).mapInArrow(_cut, SEGMENT_DDL)
    by = F.when(F.col("kind") == REPEATED, F.xxhash64("id", "tag", "pos")).otherwise(F.col("anchor"))
    settled = stored(rows.repartition(by).sortWithinPartitions("kind", "anchor", "content", "id", "tag", "pos")
                     .mapInArrow(settle, SEGMENT_DDL), "segments")
    unsettled = settled.where(F.col("kind") == OPEN).withColumnRenamed("content", "part")
    large = unsettled.where("part > 0").select("anchor").distinct().withColumn("large", F.lit(True))
    cut = F.substring(F.col("raw"), (F.col("pos") + 1).cast("int"), (F.col("n") + LENGTH - 1).cast("int"))
    fetched = (unsettled.join(keyed.select("id", "tag", "raw"), ["id", "tag"])
               .select("anchor", "part", "id", "tag", "pos", "n", cut.alias("raw"))
               .join(large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False))))
    compared = stored(fetched.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
                      .mapInArrow(_compare, STRING_DDL), "strings")
    merged = (compared.where(F.col("kind") == STRING)
              .withColumn("slot", F.pmod(F.xxhash64("string"), F.lit(MERGE_SLOTS)))
              .select("anchor", "slot", "part", "id", "tag", "pos", "string")
              .groupBy("anchor", "slot").applyInArrow(_merge, "id long, tag long, pos long, n long"))
    found = ["id", "tag", "pos", "n"]
    runs = (settled.where(F.col("kind") == REPEATED).select(*found)
            .unionByName(compared.where(F.col("kind") == REPEATED).select(*found)).unionByName(merged))
    return runs.withColumnRenamed("pos", "start")


def cut_spans(size: int, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal byte spans that runs of strings cover."""
    if not len(starts):
        return starts, starts
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], (starts + n + LENGTH - 1)[order]
    reach = np.maximum.accumulate(ends)
    head = np.ones(len(starts), dtype=bool)
    head[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return starts[at], np.minimum(reach[np.concatenate((at[1:] - 1, [len(starts) - 1]))], size)


def dedup_strings(docs: DataFrame, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) per row of ``docs``: the bytes that stay and the spans removed.

    doc_id must be a whole number; null counts as smaller than any. Rows equal
    in doc_id and text are one document, and rows of one doc_id with other
    texts are documents in the order of their text's 64-bit hash. Null, empty and short
    texts lose nothing. Removal goes by bytes, so ``kept`` may cut characters.
    """
    keyed = keyed_documents(docs)
    runs = (repeated_strings(keyed, part_segments).groupBy("id", "tag")
            .agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw", SLICE_BYTES):
                kept, spans = [], []
                for raw, starts, ns in zip(*(part.column(c).to_pylist() for c in ("raw", "starts", "ns"))):
                    first, last = cut_spans(len(raw), np.array(starts or [], dtype=np.int64),
                                            np.array(ns or [], dtype=np.int64))
                    edges = [0, *np.column_stack((first, last)).ravel().tolist(), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(r) for r in part.column("raw").to_pylist()], pa.int64()),
                     pa.array(kept, pa.binary()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_bytes", "kept", "spans"])

    joined = keyed.join(runs, ["id", "tag"], "left").select("doc_id", "raw", "starts", "ns")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, kept binary, "
                                  "spans array<struct<start:bigint,end:bigint>>")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, spans removed and the digest of what stays."""
    out = dedup_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS g
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w),
b AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM r WHERE k > 1),
s AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE fresh) AS n_spans
  FROM (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS DISTINCT FROM 1 AS fresh FROM b)
  GROUP BY doc_id),
x AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * q + 1, 2), '' ORDER BY q) AS kept
  FROM (SELECT doc_id, h, unnest(range(0, n)) AS q FROM d WHERE doc_id IN (SELECT doc_id FROM s)) d
  LEFT JOIN b ON d.doc_id = b.doc_id AND d.q = b.p WHERE b.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN unhex(h) ELSE unhex(coalesce(x.kept, '')) END) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN x USING (doc_id)
"""
