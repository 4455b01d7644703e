"""Token ids in binary shard files, compressed by a Re-Pair grammar per shard.

Documents are range-partitioned by doc_id; each task encodes its range in
order and writes shards of bounded size to the shared folder. A manifest table
lists the shards that were committed, so files of lost or repeated attempts
are never read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusforge.llm import repair
from locusforge.llm.byte_bpe import byte_characters
from locusforge.llm.common import bounded_batches, open_shared, per_process, slices, spread, stored, table, text_of
from locusforge.llm.remembered import Remembered
from locusforge.session import scratch_path

END_ID = 2
# Ids after which a shard is closed at the next document's end.
SHARD_IDS = 1_000_000
# Texts of ASCII and of Latin letters with a composed form and one lower case:
# the tokenizer's normaliser does no more to them than ``lower``.
SIMPLE = r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*"
LETTERS = r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+"
# A whole run of ASCII signs that does not start with an apostrophe. The
# tokenizer starts a word there too, so a blank before it changes no id.
SIGN = r"\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f"
SIGNS = rf"[{SIGN.replace('!-/', '!-&(-/')}](?<![{SIGN}].)[{SIGN}]*"
# Texts with this may hold special tokens, which the library takes as they are.
SPECIAL = "<|"
# Words remembered in a worker before the memory is emptied.
MAX_REMEMBERED = 800_000
# Their characters, at most, between two slices of texts.
MAX_CHARACTERS = 16_000_000
# Words that are encoded in one call.
ENCODED_AT_ONCE = 4096


class WordEncoder:
    """Ids of whole texts, each distinct blank-separated word encoded once.

    The tokenizer drops white space and no token reaches across it, so the ids
    of a text are those of its words. Simple texts are lower-cased and their
    signs cut off first, so that few words are distinct; words of letters alone
    go to the library's model many at a time, without normaliser and splitter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.simple, self.letters = re.compile(SIMPLE).fullmatch, re.compile(LETTERS).fullmatch
        self.signs = re.compile(SIGNS, re.DOTALL).sub
        self.spelling = {b: c for b, c in enumerate(byte_characters()) if b != ord(" ")}
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.remembered = Remembered(self._encode_words, MAX_REMEMBERED)
        self.characters = 0

    def _cut(self, text: str) -> list[str]:
        if SPECIAL in text:
            return text.replace("\n", " ").split(" ")
        if text.isascii() or self.simple(text):
            return self.signs(r" \g<0>", text.lower()).replace("\n", " ").split(" ")
        words = text.replace("\n", " ").split(" ")
        return list(chain.from_iterable(self._cut(w) if self.simple(w) else [w] for w in words))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.characters += sum(map(len, words))
        own = np.fromiter((self.letters(w) is not None for w in words), dtype=bool, count=len(words))
        plain, rest = np.flatnonzero(own).tolist(), np.flatnonzero(~own).tolist()
        sizes, ids = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)]
        for k in range(0, len(plain), ENCODED_AT_ONCE):
            spelt = " ".join([words[i] for i in plain[k:k + ENCODED_AT_ONCE]]).encode().decode("latin-1")
            got = np.array(self.plain.encode_batch_fast([spelt.translate(self.spelling)])[0].ids, dtype=np.int32)
            ids.append(got)
            sizes.append(np.diff(np.flatnonzero(self.closing[got]), prepend=-1))
        for k in range(0, len(rest), ENCODED_AT_ONCE):
            some = [words[i] for i in rest[k:k + ENCODED_AT_ONCE]]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(sizes[-1].sum())))
        sizes, order = np.concatenate(sizes), np.array(plain + rest, dtype=np.int64)
        in_order = np.argsort(np.repeat(order, sizes), kind="stable")
        return sizes[np.argsort(order)], np.concatenate(ids)[in_order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID after each, and the place where each text ends."""
        if self.characters > MAX_CHARACTERS:
            self.remembered.forget()
        if not self.remembered.number:
            self.characters = 0
        ids, ends = self.remembered.lookup([self._cut(text) for text in texts])
        return np.insert(ids, ends, END_ID), ends + 1 + np.arange(len(ends))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; the manifest of the shards.

    Manifest: (part, shard, path, n_docs, n_ids, n_symbols, n_rules). Null texts are empty, so
    they have the end id alone; rows with a null doc_id come first; rows of
    equal doc_id are ordered by text. An empty table writes no shard.
    """
    rows = docs.select(F.col("doc_id").alias("id"), text_of().alias("text"))
    ordered = bounded_batches(rows).repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, shard = TaskContext.get().partitionId(), 0
        encoder = per_process(("word_bpe", tokenizer), lambda: WordEncoder(tokenizer))
        names, ids, ends, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{shard:05d}-{uuid.uuid4().hex}.rp"
            grammar = repair.compress(np.concatenate(ids))
            sink = pa.BufferOutputStream()
            kept = pa.Table.from_batches([pa.RecordBatch.from_arrays([x], ["id"]) for x in names])
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_table(kept)
            with open_shared(path, "wb") as out:
                out.write(repair.to_bytes(grammar, np.concatenate(ends), sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_pylist([{
                "part": part, "shard": shard, "path": path, "n_docs": kept.num_rows, "n_ids": size,
                "n_symbols": len(grammar.symbols), "n_rules": len(grammar.rules)}], MANIFEST)

        for batch in batches:
            for piece in slices(batch, "text", min(1 << 20, 4 * shard_ids)):
                got, at = encoder.encode(piece.column("text").to_pylist())
                names.append(piece.column("id"))
                ids.append(got)
                ends.append(at + size)
                size += len(got)
                if size >= shard_ids:
                    yield close()
                    names, ids, ends, size, shard = [], [], [], 0, shard + 1
        if names:
            yield close()

    return stored(ordered.mapInArrow(run, MANIFEST_DDL), "token-manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                      ("n_ids", pa.int64()), ("n_symbols", pa.int64()), ("n_rules", pa.int64())])
MANIFEST_DDL = ("part int, shard int, path string, n_docs long, n_ids long, n_symbols long, n_rules long")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``start``: the ids in all shards before. Only per-part sums meet in one window."""
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).select(
        "part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    return (manifest.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(parts, "part").withColumn("start", F.col("part_start") + F.col("in_part")))


def _shard_documents(row: dict) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Documents of a shard, some at a time: their ids' names, where each starts and the last ends, the ids."""
    with open_shared(row["path"], "rb") as source:
        grammar, ends, names = repair.from_bytes(source.read())
    ids = grammar.expand(grammar.symbols).astype(np.int32)
    offsets = np.concatenate(([0], ends))
    kept = pa.ipc.open_stream(names).read_all().column("id").combine_chunks()
    for i in range(0, len(ends), DOCUMENTS_AT_ONCE):
        own = offsets[i:i + DOCUMENTS_AT_ONCE + 1]
        yield kept.slice(i, len(own) - 1), own + row["start"], ids[own[0]:own[-1]]


def _listed(manifest: DataFrame) -> DataFrame:
    return spread(with_starts(manifest).select("path", "start"), "path")


def read_token_files(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, start, ids): the ids of every document, with the number of ids before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(batch.to_pylist() for batch in batches):
            for names, places, ids in _shard_documents(row):
                lists = pa.ListArray.from_arrays(pa.array(places - places[0], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([names, pa.array(places[:-1], pa.int64()), lists],
                                                 ["id", "start", "ids"])

    return _listed(manifest).mapInArrow(run, f"id {id_type}, start long, ids array<int>")


# Documents of a shard handed to Spark at a time.
DOCUMENTS_AT_ONCE = 256


def read_document(path: str, number: int) -> np.ndarray:
    """Ids of one document of a shard file, by random access: only what covers it is read."""
    with open_shared(path, "rb") as source:
        return repair.ShardFile(source).document(number)


def digests(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(batch.to_pylist() for batch in batches):
            for names, places, ids in _shard_documents(row):
                own = (places - places[0]).tolist()
                raw = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(own[:-1], own[1:])]
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(places[:-1], pa.int64()), pa.array(np.diff(places), pa.int64()),
                     pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _listed(manifest).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: where its ids start, how many there are and their checksum."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"),
                                 scratch_path(spark, "token-files"))
    return digests(manifest, docs.schema["doc_id"].dataType.simpleString())
