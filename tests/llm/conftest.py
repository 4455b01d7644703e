from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sample_words import sentence  # noqa: E402

# An extra column that clashes with names the operators use inside.
DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, ID string"

def sample_texts() -> list[str | None]:
    """Nulls, empties, white space, copies, near copies, shared lines, odd characters, a long text."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(1, 120)) for _ in range(24)]
    passage, line = sentence(rng, 40), "  A line that many documents share, Überall und IMMER  "
    out: list[str | None] = [None, "", " \t\n", "x", "\x00 \x1f\x85 \xa0 é", "日本語のテキスト 🙂 mixed\r\nlines\n\n"]
    out += base + base[:4] * 3
    out += [b + " extra" for b in base[4:8]] + [passage + " " + b for b in base[8:14]]
    out += [f"{b[:60]}\n{line}\n{b[60:]}" for b in base[:9]] + [f"{line.upper()}\n{b}\n{line}" for b in base[9:12]]
    out += ["ab" * 400, "spam spam spam " * 60, sentence(rng, 6000)]
    return out


@pytest.fixture(scope="session")
def texts():
    return sample_texts()


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: texts, or (doc_id, text) pairs; texts are numbered from 0."""
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), "clash", "clash") for i, t in pairs],
            DOCS_DDL).repartition(3)
    return make


@pytest.fixture(scope="session")
def docs(make_docs, texts):
    """The sample with a null doc_id and two equal rows besides."""
    return make_docs([*enumerate(texts), (None, texts[7]), (3, texts[3]), (7, texts[7])]).cache()


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
