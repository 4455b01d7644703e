import glob
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from locusforge.llm import repair, token_files as T
from locusforge.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_grammar_round_trip():
    rng = np.random.RandomState(0)
    for ids in ([], [5], [7, 7], [1] * 1000, rng.randint(0, 9, 5000), np.tile(rng.randint(0, 40000, 300), 30),
                rng.randint(0, 49408, 20000)):
        ids = np.array(ids, dtype=np.int64)
        g = repair.compress(ids, min_count=4)
        assert np.array_equal(g.expand(g.symbols), ids)
        back, ends, names = repair.from_bytes(repair.to_bytes(g, np.array([len(ids)]), b"names"))
        assert np.array_equal(back.expand(back.symbols), ids) and ends.tolist() == [len(ids)] and names == b"names"
        starts = back.starts()
        assert starts[-1] == len(ids)
        for _ in range(30):
            a, b = sorted(rng.randint(0, len(ids) + 1, 2))
            assert np.array_equal(back.slice(a, b, starts), ids[a:b])
    with pytest.raises(ValueError):
        repair.from_bytes(b"something else")


def test_repeats_are_compressed():
    ids = np.tile(np.random.RandomState(1).randint(0, 40000, 200), 50)
    assert len(repair.compress(ids).symbols) < len(ids) / 4


def test_frequent_pairs_come_first():
    """Equal neighbours are paired from the left; every rule's length is that of its parts."""
    g = repair.compress(np.array([3] * 65), min_count=2)
    assert np.array_equal(g.expand(g.symbols), np.full(65, 3))
    for (a, b), n in zip(g.rules, g.lengths):
        size = lambda s: 1 if s < g.base else g.lengths[s - g.base]
        assert n == size(a) + size(b)


def test_no_pair_is_frequent_at_the_end():
    """Copies of one long page: rounds go on until no pair of neighbours is frequent."""
    ids = np.tile(np.random.RandomState(2).randint(0, 40000, 2000), 100)
    g = repair.compress(ids)
    pairs = np.unique(np.column_stack((g.symbols[:-1], g.symbols[1:])), axis=0, return_counts=True)[1]
    assert pairs.max(initial=0) < repair.MIN_COUNT
    assert g.lengths.max() > 64 and np.array_equal(g.expand(g.symbols), ids)


def test_encoder_matches_the_library(tokenizer):
    rng = random.Random(6)
    parts = [" ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "a", "The", "ΣΑΣ", "İ", "é", "Å", "0", "10", "7", "'s",
             "!!", ".", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "́", "x́", "가", "각"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", " ", "0"]
    encoder = T.WordEncoder(PATH)
    ids, ends = encoder.encode(texts)
    want = [[*e.ids, T.END_ID] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert encoder.encode([])[0].tolist() == []


def test_latin_words(tokenizer):
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    words = [*letters, *("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(3000)), "a" * 300]
    text = " ".join(w + rng.choice(["", "", ".", ",", ";", ":", "!", "?"]) for w in words)
    want = [*tokenizer.encode(text, add_special_tokens=False).ids, T.END_ID]
    assert T.WordEncoder(PATH).encode([text])[0].tolist() == want


def expected(rows, tokenizer):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, docs, tokenizer, monkeypatch):
    monkeypatch.setattr(T, "MAX_REMEMBERED", 50)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    folder = scratch_path(spark, "token-files")
    manifest = T.write_token_files(docs, PATH, folder, shard_ids=500)
    assert manifest.count() > 3
    got = sorted(map(tuple, T.digests(manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows, tokenizer)
    assert len(glob.glob(f"{folder.removeprefix('file:')}/*.rp")) == manifest.count()
    first = manifest.orderBy("part", "shard").first()
    assert zlib.crc32(T.read_document(first["path"], 1).astype("<u4").tobytes()) == got[1][3]


def test_query(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, T.op6_token_files(spark, "/root/testdata/sf0.001").collect()), key=lambda r: r[1])
    assert got == expected(rows, tokenizer)


def test_empty_table(spark, no_docs):
    assert T.digests(T.write_token_files(no_docs, PATH, scratch_path(spark, "none"))).count() == 0


def test_signs_and_letters(tokenizer):
    """Signs cut off words, apostrophes, special tokens and texts beyond Latin give the library's ids."""
    rng = random.Random(9)
    parts = ["a", "The", "É", "ß", "日本", "İ", "7", "'", "''", "'s", "'LL", ".", "***", "$", "\x00", "\x1c", "\x7f", "<",
             "<|", "|>", "<|endoftext|>", " ", "\n", "\t", "\xa0", "×", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(5000)]
    ids, ends = T.WordEncoder(PATH).encode(texts)
    want = [[*e.ids, T.END_ID] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_memory_is_bounded_by_characters(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "MAX_CHARACTERS", 3000)
    encoder = T.WordEncoder(PATH)
    for k in range(20):
        word = chr(97 + k) * 1000
        want = [*tokenizer.encode(word, add_special_tokens=False).ids, T.END_ID]
        assert encoder.encode([word])[0].tolist() == want
        assert sum(map(len, encoder.remembered.number)) <= 4000


def test_a_document_is_read_from_its_blocks():
    ids = np.tile(np.random.RandomState(3).randint(0, 40000, 700), 30)[:20_500]
    ids = np.concatenate((ids, np.random.RandomState(4).randint(0, 40000, 9000)))
    ends = np.array([0, 5, 5, 20_000, 20_499, len(ids)])
    raw = repair.to_bytes(repair.compress(ids), ends, b"")

    class Counted(io.BytesIO):
        got = 0

        def read(self, size=-1):
            part = super().read(size)
            self.got += len(part)
            return part

    for n, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        source = Counted(raw)
        assert repair.ShardFile(source).document(n).tolist() == ids[a:b].tolist()
        if b - a < 1000:
            assert source.got < len(raw) / 2
