"""Suffix arrays in NumPy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

# Every so many positions a common prefix is compared from its first byte.
SAMPLE = 16


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one big-endian number; zeros past the end."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their suffixes, compared by ``depth`` bytes at least.

    Groups of suffixes that agree so far are refined by the rank of what
    follows them, twice as far in each round; suffixes that stand alone keep
    their place and are not sorted again. The end of the text is smaller than
    any byte.
    """
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    first = words_at(text)
    order = np.argsort(first, kind="stable")
    tail = np.minimum(n - order, 8)       # shorter suffixes differ from ones with zero bytes
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (first[order][1:] != first[order][:-1]) | (tail[1:] != tail[:-1])
    if not (tail == 8).all():             # only the last 7 suffixes: put the shorter ones first
        order = order[np.lexsort((tail, first[order]))]
        tail = np.minimum(n - order, 8)
        fresh[1:] = (first[order][1:] != first[order][:-1]) | (tail[1:] != tail[:-1])
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = heads
    reach = 8
    while reach < depth:
        alone = fresh & np.concatenate((fresh[1:], [True]))
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        members = order[places]
        follow = rank[np.minimum(members + reach, n)]
        sub = np.argsort((rank[members] * (n + 2)) + follow + 1, kind="stable")
        members, follow = members[sub], follow[sub]
        group = rank[members]
        order[places] = members
        cut = np.ones(len(places), dtype=bool)
        cut[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        fresh[places] = cut
        head = np.maximum.accumulate(np.where(cut, places, 0))
        rank[members] = head
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, counted up to ``most``.

    Kasai's bound: a suffix shares at most one byte less than the suffix that
    starts one position earlier did. Sampled positions are compared first and
    give the others the length to start from; not where they share ``most``,
    as suffixes that agree that far may be in any order.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    if n > 1:
        before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    words = words_at(text)
    sampled = np.arange(0, n, SAMPLE)
    _extend(text, words, before, shared, sampled, most)
    rest = np.flatnonzero(np.arange(n) % SAMPLE != 0)
    known = shared[rest // SAMPLE * SAMPLE]
    shared[rest] = np.where(known < most, np.maximum(0, known - rest % SAMPLE), 0)
    _extend(text, words, before, shared, rest, most)
    return np.minimum(shared[order], most)


def _extend(text, words, before, shared, positions, most) -> None:
    n = len(text)
    active = positions[(before[positions] >= 0) & (shared[positions] < most)]
    while len(active):
        a, b = active + shared[active], before[active] + shared[active]
        inside = np.maximum(a, b) + 8 <= n
        whole = inside.copy()
        whole[inside] = words[a[inside]] == words[b[inside]]
        shared[active[whole]] += 8
        last, a, b = active[~whole], a[~whole], b[~whole]
        going = np.ones(len(last), dtype=bool)
        for k in range(8):
            ok = going & (a + k < n) & (b + k < n)
            ok[ok] = text[a[ok] + k] == text[b[ok] + k]
            shared[last[ok]] += 1
            going = ok
        active = active[whole]
        active = active[shared[active] < most]


def merged_firsts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where each of the sorted fixed-length strings ``right`` stands in sorted ``left``; -1 if absent.

    The strings of one shard are looked up in another's by binary search.
    """
    if not len(left):
        return np.full(len(right), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
    return np.where(left[at] == right, at, -1)
