"""Words of whole texts as numbers, for operators that count or compare stretches of words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def words_of(text: str | None) -> list[bytes]:
    """The maximal stretches without a space or an ASCII control from tab to carriage return, in UTF-8; none for null."""
    return text.encode().split() if text else []


def numbered(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of several texts, one after another (equal words, equal numbers), and where each text starts.

    The second array has one entry more than there are texts: the last one ends there.
    """
    known: dict[bytes, int] = {}
    give, sizes, parts = known.setdefault, [0], []
    for words in texts:
        sizes.append(len(words))
        parts.append(np.fromiter([give(w, len(known)) for w in words], np.int64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum(np.array(sizes, np.int64))


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each place on; the last n - 1 places have none."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + mixed[k : len(ids) - n + 1 + k]
    return out


def gram_places(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places from which n words follow within the same text."""
    sizes = np.maximum(0, np.diff(bounds) - n + 1)
    first = np.repeat(bounds[:-1] - (np.cumsum(sizes) - sizes), sizes)
    return first + np.arange(sizes.sum())


def repeated_grams(ids: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Places whose n words occur at another place of the same text too."""
    at = gram_places(bounds, n)
    h = gram_hashes(ids, n)[at]
    of = owner(bounds)[at]
    order = np.lexsort((h, of))
    at, h, of = at[order], h[order], of[order]
    same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
    # hashes only gather candidates; what counts is that the words are equal
    at, of = at[tied], of[tied]
    order = np.lexsort((*[ids[at + k] for k in reversed(range(n))], of))
    at, of = at[order], of[order]
    equal = of[1:] == of[:-1]
    for k in range(n):
        equal &= ids[at[1:] + k] == ids[at[:-1] + k]
    return np.sort(at[np.append(False, equal) | np.append(equal, False)]) if len(at) else at


def covered(at: np.ndarray, length: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a stretch that starts at one of ``at`` and is ``length`` long."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, 1)
    np.subtract.at(change, at + length, 1)
    return np.cumsum(change[:-1]) > 0
