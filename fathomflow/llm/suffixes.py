"""Repeated substrings of a set of byte strings by threshold-bounded interval expansion.

The strings are joined with a separator and sorted by their rotations as far as the threshold needs, which
gives a Burrows-Wheeler transform. Breadth-first backward extension of suffix intervals (Beller, Gog,
Ohlebusch and Schnattinger, 2013) then finds the common prefixes of neighbouring suffixes in increasing order:
when all intervals of length l have been extended, every common prefix of length l is known. The expansion
stops at the threshold; neighbours without a value by then share at least that much.
"""

from __future__ import annotations

import numpy as np

#: A byte that UTF-8 never holds.
SEPARATOR = 255
#: Joined strings are shorter than this, so that three ranks fit into 63 bits.
MAX_SYMBOLS = 1 << 21


def sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of all rotations by (at least) their first ``depth`` bytes. Ranks cover 8 bytes, then three times as many."""
    n = len(text)
    wide = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    covered = 8
    while True:
        order = np.argsort(key)
        if covered >= depth:
            return order
        found = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(found[1:] != found[:-1])]).astype(np.uint64)
        key = (rank << np.uint64(42)) | (np.roll(rank, -covered) << np.uint64(21)) | np.roll(rank, -2 * covered)
        covered *= 3


def common_prefixes(transform: np.ndarray, limit: int) -> np.ndarray:
    """Of each suffix in order the common prefix with the one before, where it is shorter than limit, else -1.

    Intervals of a level are extended by every symbol before their suffixes at once: the last-to-first mapping
    takes an interval's suffixes that follow one symbol to a run of neighbours. Only an interval whose right
    border is new can give new borders, so there are at most as many intervals as suffixes in all."""
    n = len(transform)
    inverse = np.argsort(transform, kind="stable").astype(np.int32)  # where the k-th suffix's symbol stands in the transform
    forward = np.empty(n, np.int32)
    forward[inverse] = np.arange(n, dtype=np.int32)
    first = transform[inverse]
    prefix = np.full(n + 1, -1, np.int16)
    prefix[[0, n]] = 0
    owner = np.zeros(n, np.int32)
    left, right = np.array([0]), np.array([n])
    for level in range(limit):
        if not len(left):
            break
        sizes = right - left
        total = int(sizes.sum())
        number = np.repeat(np.arange(len(left), dtype=np.int32), sizes)
        at = np.arange(total) - (np.cumsum(sizes) - sizes - left)[number]
        owner[at] = number
        reached = np.sort(forward[at])
        source = owner[inverse[reached]]
        new_run = (np.diff(reached) != 1) | (np.diff(source) != 0) | (first[reached[1:]] != first[reached[:-1]])
        ends = np.flatnonzero(np.append(new_run, True))
        begins = np.concatenate([[0], ends[:-1] + 1])
        lo, hi = reached[begins].astype(np.int64), reached[ends].astype(np.int64) + 1
        fresh = prefix[hi] < 0
        left, right = lo[fresh], hi[fresh]
        prefix[right] = level
    return prefix[:n]


def window_classes(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(joined, repeated, first): the joined pieces (each with a separator behind), the starts of strings of ``length`` bytes
    that start anywhere else too, and those of each such string's first place. Strings never reach over a piece's end."""
    joined = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
    if len(joined) >= MAX_SYMBOLS:
        raise ValueError("too many symbols for one sort")
    order = sorted_rotations(joined, length)
    alone = common_prefixes(joined[order - 1], length) >= 0  # differs from the suffix before
    alone[:1] = True
    groups = np.flatnonzero(alone)
    repeated, first = np.zeros(len(joined), bool), np.zeros(len(joined), bool)
    repeated[order[~(alone & np.append(alone[1:], True))]] = True
    first[np.minimum.reduceat(order, groups)] = True
    sizes = np.array([len(p) + 1 for p in pieces])
    inside = np.cumsum(sizes).repeat(sizes) - 1 - np.arange(len(joined)) >= length
    return joined, repeated & inside, first & inside


def repeated_starts(pieces: list[bytes], length: int) -> np.ndarray:
    """Marks, over the joined pieces, the starts of strings of ``length`` bytes that start anywhere else too."""
    return window_classes(pieces, length)[1]


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of marks."""
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
