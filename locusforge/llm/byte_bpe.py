"""Byte-level BPE encoding and decoding with the tokenizers library.

The rank file gives token bytes and ranks. Bytes are written as printable
characters (one character per byte), the merges are recovered from the ranks,
and the tokenizers library encodes Arrow batches of texts. Decoding turns ids
back to bytes by the reversed byte table, so tokens that split a character
come together again before anything is read as UTF-8.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm.common import bounded_batches, per_process, slices, table, text_of
from locusforge.llm.remembered import Remembered

# The split pattern that the cuts and known matches below were derived from.
# Texts of other patterns are encoded whole.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A text is cut before a blank that starts a word and after a newline with no
# other white space on either side: no match of the pattern crosses these
# places or looks beyond them, so the pieces encode independently and repeated
# ones are looked up.
CUTS = r"(?= \S)|(?<=\S\n)(?=\S)"
# A run of Latin letters, with one mark after it or none, behind a newline or a
# blank: matches of the pattern that are known beforehand, so the library's
# model merges them without its splitter.
LATIN = r"(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]?)"
ENCODED_AT_ONCE = 4096
# Pieces remembered in a worker: long ones among them, beside workers of other
# stages that live on in the executor.
MAX_REMEMBERED = 200_000
# Bytes of text, or ids, that are worked on at a time.
SLICE_BYTES = 1 << 20
SLICE_IDS = 1 << 18


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _parts(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of ``token`` after all merges of rank under ``below``, lowest rank and leftmost first."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(options)
        if rank >= below:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Merges in order of rank.

    A token's merge joins the two parts that the lower ranks leave of it. A
    token of which they leave more parts can be reached from any two tokens
    that make it up: all these pairs are merges.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = _parts(token, ranks, rank)
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
        else:
            out += [(token[:i], token[i:]) for i in range(1, len(token))
                    if token[:i] in ranks and token[i:] in ranks]
    return out


class ByteTable:
    """The bytes of every id: all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of_id = {rank: token for token, rank in ranks.items()}
        # Bytes of all tokens in a row, and where each begins.
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(self.bytes_of_id.get(i, b"") for i in range(len(self.sizes))), np.uint8)

    def offsets(self, ids) -> np.ndarray:
        """The byte of the text at which each id's token ends; it starts where the one before ends.

        Offsets count bytes, so a token that is a part of a character has its own.
        """
        return np.cumsum(self.sizes[np.asarray(ids, dtype=np.int64)])

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids: every token's, from the reversed byte table."""
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.spelled[np.repeat(self.begin[ids] - before, sizes) + np.arange(int(sizes.sum()))]

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_flat(np.asarray(ids, dtype=np.int64)).tobytes()


class Codec(ByteTable):
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        ranks = read_ranks(path)
        super().__init__(ranks)
        characters = byte_characters()

        def spell(token: bytes) -> str:
            return "".join(characters[b] for b in token)

        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()},
                           merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cut_up = pattern == CUT_PATTERN
        self.cuts = re.compile(CUTS)
        self.wide = re.compile(r"\s\s")
        self.latin = re.compile(LATIN).fullmatch
        self.spelling = {b: c for b, c in enumerate(characters)}
        self.marks = {m: ranks[m.encode()] for m in "\n.,;:!?"}
        self.remembered = Remembered(self._encode_pieces, MAX_REMEMBERED)

    def _cut(self, text: str) -> list[str]:
        """Pieces of a newline and the text.

        Where no white space stands side by side, every blank and newline
        starts a piece, and the blank is left off. Other texts are cut by CUTS
        and their pieces marked by two newlines, which no other piece has.
        """
        text = "\n" + text
        if self.wide.search(text):
            return ["\n", *("\n\n" + p for p in self.cuts.split(text[1:]))]
        return text.replace("\n", " \n").split(" ")[1:]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[list[int]] = [None] * len(pieces)
        rest = []
        merge, latin, spelling = self.tokenizer.model.tokenize, self.latin, self.spelling
        for i, piece in enumerate(pieces):
            if found := latin(piece):
                line, word, mark = found.groups()
                spelled = (word if line else " " + word).encode().decode("latin-1").translate(spelling)
                ids[i] = [t.id for t in merge(spelled)]
                if line:
                    ids[i].insert(0, self.marks[line])
                if mark:
                    ids[i].append(self.marks[mark])
            else:
                rest.append(i)
        full = [p[2:] if p.startswith("\n\n") else p if p.startswith("\n") else " " + p
                for p in (pieces[i] for i in rest)]
        for k in range(0, len(full), ENCODED_AT_ONCE):
            for i, e in zip(rest[k:], self.tokenizer.encode_batch_fast(full[k:k + ENCODED_AT_ONCE],
                                                                       add_special_tokens=False)):
                ids[i] = e.ids
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the place where each text's ids end.

        Every text is encoded behind a newline, which is a token of its own
        and taken off again. Texts of a pattern that is not cut are encoded
        whole and not remembered.
        """
        if not self.cut_up:
            sizes, ids = self._encode_pieces(["\n\n" + text for text in texts])
            return ids, np.cumsum(sizes)
        ids, ends = self.remembered.lookup([self._cut(text) for text in texts])
        first = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return np.delete(ids, first), ends - 1 - np.arange(len(ends))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the rank file's own merge rule gives them."""
        ids, ends = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []


def worker_codec(path: str, pattern: str) -> Codec:
    return per_process(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def worker_table(path: str) -> ByteTable:
    return per_process(("byte_table", path), lambda: ByteTable(read_ranks(path)))


def encode_documents(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """(id, ids, ends): token ids of every whole text and, if asked for, the byte where each token ends.

    Null texts are empty and have no ids; equal texts have equal ids; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                c = worker_codec(path, pattern)
                ids, ends = c.encode_flat(part.column("text").to_pylist())
                places = pa.array(np.concatenate(([0], ends)), pa.int32())
                lists = pa.ListArray.from_arrays(places, pa.array(ids, pa.int32()))
                bytes_at = pa.nulls(len(lists), pa.list_(pa.int32()))
                if offsets:
                    bytes_at = pa.array([c.offsets(x) for x in np.split(ids, ends[:-1])], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, bytes_at], ["id", "ids", "ends"])

    rows = docs.select(F.col("doc_id").alias("id"), text_of().alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"id {id_type}, ids array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, raw): the bytes that the ids of each row stand for (null ids: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            places = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(places, places[start] + SLICE_IDS, side="right")) - 1)
                c = worker_table(path)
                ids = values[places[start]:places[end]]
                raw = c.decode_flat(ids)
                edges = np.concatenate(([0], np.cumsum(c.sizes[ids])))[places[start:end + 1] - places[start]]
                binary = pa.Array.from_buffers(pa.binary(), end - start, [
                    None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, end - start), lists.slice(start, end - start), binary],
                    ["id", "ids", "raw"])
                start = end

    id_type = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {id_type}, ids array<int>, raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the round trip of every whole text."""
    decoded = decode_documents(encode_documents(docs, path, pattern, offsets=False), path)
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("raw", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, digest of the ids and digest of the decoded bytes."""
    import public_tokenizers
    return digests(table(spark, sf_dir, "documents"),
                   public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
