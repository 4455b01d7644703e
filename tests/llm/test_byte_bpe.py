import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from locusforge.llm import byte_bpe as B, remembered

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH),
                             special_tokens={})


def test_round_trip_matches_tiktoken(docs, reference):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
           for r in B.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want


def test_random_texts(reference):
    rng = random.Random(2)
    codec = B.Codec(PATH, public_tokenizers.PATTERN)
    parts = [" ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "a", "The", "é", "ß", "12", "'s", "'", "!!",
             "…", "日本", "🙂", "é", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    got = codec.encode_batch(texts)
    assert got == [reference.encode_ordinary(t) for t in texts]
    for text, ids in zip(texts, got):
        ends = codec.offsets(ids)
        assert codec.decode(ids) == text.encode()
        assert len(ends) == len(ids) and (not ids or ends[-1] == len(text.encode()))


def test_latin_words(reference):
    """Words that skip the library's splitter, with every letter and mark of that path."""
    codec = B.Codec(PATH, public_tokenizers.PATTERN)
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
    words = [*letters, *("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(3000))]
    text = " ".join(w + rng.choice(["", "", ".", ",", ";", ":", "!", "?"]) for w in words)
    assert codec.encode_batch([text, text[1:]]) == [reference.encode_ordinary(text), reference.encode_ordinary(text[1:])]


def test_offsets_of_split_characters():
    codec = B.Codec(PATH, public_tokenizers.PATTERN)
    text = "\U00010348\U0001f9ff"
    ids = codec.encode_batch([text])[0]
    ends = codec.offsets(ids)
    raw = text.encode()
    assert [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())] == [codec.bytes_of_id[i] for i in ids]


def test_memory_is_emptied(monkeypatch, reference):
    monkeypatch.setattr(remembered, "MAX_REMEMBERED", 5)
    codec = B.Codec(PATH, public_tokenizers.PATTERN)
    for text in ("one two three four five six", "two seven eight " * 3, "x" * 500 + " one"):
        assert codec.encode_batch([text]) == [reference.encode_ordinary(text)]


def test_empty_table(no_docs):
    assert B.digests(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    assert B.encode_documents(no_docs, PATH, public_tokenizers.PATTERN).columns == ["id", "ids", "ends"]


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\p{L}+\n*|\p{N}{1,3}|[^\p{L}\p{N}]+"])
def test_other_ranks_and_patterns(pattern):
    """A rank file with tokens of two newlines, and a pattern whose matches run over blanks and newlines."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = B.read_ranks(path)
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert b"\n\n" in ranks
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "The", "12", "1234", "'s", "!!", "é"]
    texts = ["a\n\nb", "a\n\n\nb", "\n\na", "a\nb", "a \nb  c", "",
             *("".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000))]
    assert B.Codec(path, pattern).encode_batch(texts) == [own.encode_ordinary(t) for t in texts]


def test_what_a_worker_remembers_is_bounded():
    import public_tokenizers
    from locusforge.llm import byte_bpe
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert codec.remembered.most == byte_bpe.MAX_REMEMBERED <= 200_000
    codec.remembered.most = 50
    texts = [f"w{i}x q{i}, z{i}" for i in range(200)]
    assert [codec.decode(i).decode() for text in texts for i in codec.encode_batch([text])] == texts
    assert len(codec.remembered.number) < 60
