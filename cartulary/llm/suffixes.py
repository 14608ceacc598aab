"""Two-stage suffix sorting in numpy, and adjacent common prefixes.

Suffixes smaller than their successor are sorted directly, by eight bytes at a
time and only where still tied. The others are induced: buckets of first bytes
are scanned in ascending order, and each scanned suffix puts the one before it,
if that starts with a larger byte (or the same, for induced ones), at the next
free place of its bucket. Order is decided by the first ``DEPTH`` bytes at least.
"""

from __future__ import annotations

import numpy as np

#: Suffixes sorted directly are compared on so many bytes; ties beyond keep the order of places.
DEPTH = 104


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(DEPTH + 16, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        out |= padded[k : len(padded) - 8 + k] << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix one place on; the last isn't."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    # an equal pair goes as the next unequal one
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(known[::-1])[::-1] if n > 1 else known
    padded = np.append(step, -1)
    return np.append(padded[at] > 0, False)


def sort_directly(at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places ordered by the DEPTH bytes that follow them."""
    order = at[np.argsort(word[at], kind="stable")]
    key = word[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(at) else at
    for depth in range(8, DEPTH, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        g, w = group[tied], word[order[tied] + depth]
        inner = np.lexsort((w, g))
        order[tied] = order[tied][inner]
        w = w[inner]
        fresh = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))
        split = np.ones(len(group), bool)
        split[1:] = group[1:] != group[:-1]
        split[tied] |= fresh
        group = np.cumsum(split)
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    word = words(text)
    small = smaller_than_next(text)
    direct = sort_directly(np.flatnonzero(small), word)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced = waiting[c]
        wave = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
            bucket.append(wave)
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        scanned = np.concatenate(bucket)
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[text[before] > c]
        if len(before):
            to = text[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(a: np.ndarray, b: np.ndarray, word: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, place by place, at most ``most``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for depth in range(0, most, 8):
        differ = word[a[live] + depth] ^ word[b[live] + depth]
        same = differ == 0
        rest = differ[~same]
        # leading zero bytes of the first difference
        lead = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            lead += rest < (np.uint64(1) << np.uint64(64 - 8 * k))
        out[live[~same]] += lead
        live = live[same]
        out[live] += 8
        if not len(live):
            break
    return np.minimum(out, most)
