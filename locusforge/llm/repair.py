"""Re-Pair grammar compression of token ids, in NumPy.

Frequent pairs of neighbouring symbols are replaced by new symbols until no
pair is frequent. Every round takes all pairs whose count is at least a sixteenth
of the highest one, most frequent first, so a shard needs few passes. The
rules and the expansion length of every symbol are kept, which gives random
access: the symbols that cover a range of ids are found by binary search and
only they are expanded.
"""

from __future__ import annotations

import io
import json
import struct
from dataclasses import dataclass

import numpy as np

# Fixed value: the first bytes of a shard file.
MAGIC = b"LFRP2\n"

MIN_COUNT = 16
RULES_A_ROUND = 8192
# Symbols from one mark of a shard file to the next.
MARKED = 1024


@dataclass
class Grammar:
    """``symbols`` expand to the ids; symbol ``base + i`` stands for the pair ``rules[i]``."""
    base: int
    rules: np.ndarray      # (n, 2)
    lengths: np.ndarray    # ids that each rule expands to
    symbols: np.ndarray

    def starts(self) -> np.ndarray:
        """The position among the ids at which each symbol starts, and the end."""
        sizes = np.ones(len(self.symbols), dtype=np.int64)
        made = self.symbols >= self.base
        sizes[made] = self.lengths[self.symbols[made] - self.base]
        return np.concatenate(([0], np.cumsum(sizes)))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols: every pass opens all rules in it by one level."""
        out = symbols.astype(np.int64)
        while len(made := np.flatnonzero(out >= self.base)):
            wide = np.ones(len(out), dtype=np.int64)
            wide[made] = 2
            place = np.cumsum(wide) - wide
            opened = np.empty(int(wide.sum()), dtype=np.int64)
            opened[place] = out
            pairs = self.rules[out[made] - self.base]
            opened[place[made]], opened[place[made] + 1] = pairs[:, 0], pairs[:, 1]
            out = opened
        return out

    def slice(self, start: int, end: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Ids ``start`` to ``end``: only the symbols that cover them are expanded."""
        starts = self.starts() if starts is None else starts
        if end <= start:
            return np.empty(0, dtype=np.int64)
        first = int(np.searchsorted(starts, start, side="right")) - 1
        last = int(np.searchsorted(starts, end, side="left"))
        ids = self.expand(self.symbols[first:last])
        return ids[start - starts[first]:end - starts[first]]


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> Grammar:
    """The grammar of a sequence of ids; an empty one has no rules and no symbols."""
    out = np.asarray(ids, dtype=np.int64)
    base = int(out.max()) + 1 if len(out) else 1
    rules, lengths = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64)
    # The places whose pair may be frequent. A pair of older symbols only grows
    # rarer, so a place ruled out comes back when one of its symbols is replaced.
    likely = np.ones(len(out), dtype=bool)
    # Every round replaces a pair somewhere, so the symbols run out.
    while len(out) > 1:
        place = np.flatnonzero(likely[:-1])
        keys = (out[place] << 32) | out[place + 1]
        pairs, chosen, rare = _frequent(keys, min_count)
        if not len(pairs):
            break
        likely[place[rare]] = False
        rule = np.minimum(np.searchsorted(pairs, keys[chosen]), len(pairs) - 1)
        right = pairs[rule] == keys[chosen]
        at, rule = place[chosen[right]], rule[right]
        # Of neighbouring hits, which overlap, every other one is taken.
        heads = np.concatenate(([True], np.diff(at) > 1))
        run_start = at[np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))]
        taken = (at - run_start) % 2 == 0
        at, rule = at[taken], rule[taken]
        new = len(rules) + base
        made = np.column_stack((pairs >> 32, pairs & 0xFFFFFFFF))
        size = np.ones(made.shape, dtype=np.int64)
        inner = made >= base
        size[inner] = lengths[made[inner] - base]
        rules, lengths = np.vstack((rules, made)), np.concatenate((lengths, size.sum(axis=1)))
        out = out.copy()
        out[at] = new + rule
        likely[at] = True
        likely[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(out), dtype=bool)
        keep[at + 1] = False
        out, likely = out[keep], likely[keep]
    return Grammar(base, rules, lengths, out)


def _frequent(keys: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs to replace in a round, sorted, which keys may be theirs, and which are rare.

    The pairs are all of at least a sixteenth of the top count. Counts by a
    hash of the pair bound the true counts from above, so only keys in full
    enough slots are sorted and counted; those in slots of less than
    ``min_count`` are rare.
    """
    bits = max(8, len(keys).bit_length())
    slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    full = np.bincount(slot, minlength=1 << bits)
    least = max(min_count, int(full.max()) // 16)
    while True:
        place = np.flatnonzero((full >= least)[slot])
        ordered = np.sort(keys[place])
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[:len(ordered)])
        counts = np.diff(np.concatenate((edges, [len(ordered)])))
        top = int(counts.max()) if len(counts) else 0
        # Every pair of ``least`` or more is among the places; fewer may be wanted.
        wanted = max(min_count, top // 16)
        if wanted >= least or least == min_count:
            break
        least = wanted if top >= least else max(min_count, least // 16)
    chosen = np.flatnonzero(counts >= wanted)
    chosen = chosen[np.argsort(-counts[chosen], kind="stable")][:RULES_A_ROUND]
    return np.sort(ordered[edges[chosen]]), place, np.flatnonzero((full < min_count)[slot])


# --- shard files ----------------------------------------------------------
def to_bytes(grammar: Grammar, ends: np.ndarray, names: bytes) -> bytes:
    """A shard file: header, rules, expansion lengths, symbols, end of each document, names, marks.

    ``names`` is kept as it is; a mark is the number of ids before every
    MARKED-th symbol. The header has the sizes of all parts.
    """
    parts = [grammar.rules.astype("<u4").tobytes(), grammar.lengths.astype("<u4").tobytes(),
             grammar.symbols.astype("<u4").tobytes(), np.asarray(ends).astype("<u8").tobytes(), names,
             grammar.starts()[:-1:MARKED].astype("<u8").tobytes()]
    header = json.dumps({"base": grammar.base, "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(parts)


class ShardFile:
    """A shard file opened for reading at any place; only the parts asked for are read."""

    def __init__(self, source):
        self.source = source
        if bytes(source.read(len(MAGIC))) != MAGIC:
            raise ValueError("not a shard file of token ids")
        header = json.loads(source.read(struct.unpack("<I", source.read(4))[0]))
        self.base, self.sizes = header["base"], header["sizes"]
        self.places = (source.tell() + np.cumsum([0, *self.sizes])).tolist()

    def part(self, number: int, first: int = 0, last: int | None = None) -> bytes:
        """Bytes ``first`` to ``last`` of a part."""
        self.source.seek(self.places[number] + first)
        return self.source.read((self.sizes[number] if last is None else min(last, self.sizes[number])) - first)

    def grammar(self, first: int = 0, last: int | None = None) -> Grammar:
        """The grammar with symbols ``first`` to ``last`` alone."""
        return Grammar(self.base, np.frombuffer(self.part(0), "<u4").astype(np.int64).reshape(-1, 2),
                       np.frombuffer(self.part(1), "<u4").astype(np.int64),
                       np.frombuffer(self.part(2, 4 * first, last and 4 * last), "<u4").astype(np.int64))

    def document(self, number: int) -> np.ndarray:
        """Ids of one document: only the marked blocks of symbols that cover it are read."""
        around = np.frombuffer(self.part(3, 8 * max(number - 1, 0), 8 * number + 8), "<u8").astype(np.int64)
        start, end = int(around[0]) if number else 0, int(around[-1])
        if end == start:
            return np.empty(0, dtype=np.int64)
        marks = np.frombuffer(self.part(5), "<u8").astype(np.int64)
        first = int(np.searchsorted(marks, start, side="right")) - 1
        last = int(np.searchsorted(marks, end, side="left"))
        return self.grammar(first * MARKED, last * MARKED).slice(start - int(marks[first]), end - int(marks[first]))


def from_bytes(raw: bytes) -> tuple[Grammar, np.ndarray, bytes]:
    """The grammar, the ends of the documents and the names of a whole file."""
    file = ShardFile(io.BytesIO(raw))
    return file.grammar(), np.frombuffer(file.part(3), "<u8").astype(np.int64), file.part(4)
