"""Runs of words: stretches that repeat with a period and that no neighbouring word extends.

Maximal pairs are enumerated on the LCP-interval tree of a text's suffixes. A
pair (i, j, l) says that the l words from i and from j are equal, that the words
before them differ (or one of them starts the text) and that the words after
them differ. If j - i <= l, the words from i to j + l are a stretch with period
j - i that neither neighbour extends: maximal pairs within that distance are
exactly the runs, and each is whole as it is found. A run shows up with the
multiples of its period too; the least one is kept.

The tree is walked bottom-up. Every interval keeps the places of its suffixes
in lists by the word to the left (the class), and where, in order of place, the
class changes. When a child joins, places of the smaller side look for others of
another class no further away than the interval's prefix is long. Occurrences
of a prefix that lie so close together form few arithmetic progressions, in each of
which all but the first have the same class; so a look touches few changes of
class, and what it lists is a pair. The pairs of all runs of a text are fewer
than a small multiple of its words.

Suffixes are ordered by doubling: rank of the first word, of the first two, four and
so on, only where still tied. The ranks of each step give the common prefixes
and tell which suffixes can take part at all: a pair with a prefix of k to
2k - 1 words lies in a chain of places whose first k words are equal, less than
2k words apart, with more than one class. Others are left out of the tree;
that loses no pair. Texts without such places by hashes of six words aren't sorted.

A task works on the texts of one Arrow batch at a time; nothing is shuffled, so
no group or key can be too large. Memory grows with the longest text (4 bytes a
word for each doubling).

Defined cases: a null or empty text has no words and no runs; words that differ
in any byte differ; equal rows give equal results; other columns are passed on as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import ship_package
from cartulary.llm.wording import covered, gram_hashes, gram_places, numbered, owner, words_of

LEAST_LENGTH = 12

FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Classes:
    """Places in lists by class, and the stretches of one class in order of place."""

    __slots__ = ("lists", "head", "kind", "size")

    def __init__(self, place: int, kind: int) -> None:
        self.lists = {kind: [place]}
        self.head, self.kind, self.size = [place], [kind], 1

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for kind, places in self.lists.items():
            for place in places:
                yield place, kind

    def near(self, place: int, kind: int, far: int) -> Iterator[int]:
        """Places of other classes at most ``far`` away."""
        low, high = place - far, place + far
        for other in set(self.kind[max(0, bisect_right(self.head, low) - 1) : bisect_right(self.head, high)]):
            if other != kind:
                places = self.lists[other]
                yield from places[bisect_left(places, low) : bisect_right(places, high)]

    def add(self, place: int, kind: int) -> None:
        """Take in a place that isn't there yet."""
        head, kinds = self.head, self.kind
        insort(self.lists.setdefault(kind, []), place)
        self.size += 1
        k = bisect_right(head, place)
        if k and kinds[k - 1] == kind:
            return
        if k:
            around = self.lists[kinds[k - 1]]
            following = bisect_right(around, place)
            if following < len(around) and (k == len(head) or around[following] < head[k]):
                head[k:k], kinds[k:k] = [place, around[following]], [kind, kinds[k - 1]]
                return
        if k < len(head) and kinds[k] == kind:
            head[k] = place
        else:
            head.insert(k, place)
            kinds.insert(k, kind)


def joined(a: Classes, b: Classes, prefix: int, found: list[tuple[int, int, int]]) -> Classes:
    """Both children of an interval in one; near pairs of different classes between them are added to ``found``."""
    if a.size < b.size:
        a, b = b, a
    for place, kind in b:
        for other in a.near(place, kind, prefix):
            found.append((min(place, other), max(place, other), prefix))
    for place, kind in b:
        a.add(place, kind)
    return a


def maximal_pairs(places: list[int], common: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal pairs (i, j, l) with j - i <= l of suffixes in order, with ``common`` words shared with the next suffix."""
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, Classes]] = []
    for place, kind, shared in zip(places, left, common, strict=True):
        child = Classes(place, kind)
        while open_ and open_[-1][0] > shared:
            prefix, held = open_.pop()
            child = joined(held, child, prefix, found)
        if shared < least:
            continue
        if open_ and open_[-1][0] == shared:
            open_[-1] = (shared, joined(open_[-1][1], child, shared, found))
        else:
            open_.append((shared, child))
    return found


def doubled_ranks(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes of several texts by their first 1, 2, 4, ... words, until all differ.

    Suffixes of different texts differ from the first word on. A rank is the place of
    the first equal suffix in the order, so those that are alone keep theirs.
    """
    n = len(ids)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    key = owner(bounds) * (int(ids.max()) + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable")
    live = np.arange(n)
    rank = np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    width = 1
    while True:
        sorted_key = key[order[live]] if not levels else key
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1]) if len(live) else np.zeros(0, bool)
        start = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))] if len(live) else live
        rank[order[live]] = start
        levels.append(rank.astype(np.int32))
        alone = fresh & np.append(fresh[1:], True) if len(live) else fresh
        live = live[~alone]
        if not len(live):
            return levels
        at = order[live]
        then = at + width
        key = rank[at] * (n + 1) + np.where(then < ends[at], rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[live], key = at[by], key[by]
        width *= 2


def common_words(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b have in common, pair by pair."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    end_a, end_b = ends[a], ends[b]
    last = len(ends) - 1
    for k in reversed(range(len(levels))):
        rank = levels[k]
        same = (a < end_a) & (b < end_b) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
        step = same.astype(np.int64) << k
        out, a, b = out + step, a + step, b + step
    return out


def taking_part(levels: list[np.ndarray], left: np.ndarray, least: int) -> np.ndarray:
    """Places that can be in a maximal pair with a prefix of ``least`` words or more that is as long as their distance."""
    n = len(left)
    chosen = np.zeros(n, bool)
    for k, rank in enumerate(levels):
        if 2 << k <= least:
            continue
        size = np.bincount(rank, minlength=n)
        at = np.flatnonzero(size[rank] > 1)
        if not len(at):
            break
        at = at[np.argsort(rank[at].astype(np.int64) * n + at, kind="stable")]
        first = np.flatnonzero(np.append(True, (rank[at[1:]] != rank[at[:-1]]) | (at[1:] - at[:-1] >= 2 << k)))
        several = np.maximum.reduceat(left[at], first) != np.minimum.reduceat(left[at], first)
        chosen[at[np.repeat(several, np.diff(np.append(first, len(at))))]] = True
    return np.flatnonzero(chosen)


def runs_of(ids: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    # length = distance + prefix, and the prefix is as long as the distance at least
    least = (least_length + 1) // 2
    texts = _with_repeats(ids, bounds, least)
    if not len(texts):
        return out
    parts = [ids[bounds[t] : bounds[t + 1]] for t in texts]
    held, ids = np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
    ends = np.repeat(held[1:], np.diff(held))
    left = np.append(-1, ids[:-1])
    left[held[:-1]] = -1
    levels = doubled_ranks(ids, held)
    places = taking_part(levels, left, least)
    places = places[np.argsort(levels[-1][places], kind="stable")]
    common = common_words(levels, ends, places[:-1], places[1:])
    common[ends[places[:-1]] != ends[places[1:]]] = 0
    found = maximal_pairs(places.tolist(), [*common.tolist(), 0][: len(places)], left[places].tolist(), least)
    periods: dict[tuple[int, int], int] = {}
    for i, j, prefix in found:
        if j - i + prefix >= least_length:
            stretch = (i, j - i + prefix)
            periods[stretch] = min(j - i, periods.get(stretch, j))
    for (start, length), period in periods.items():
        t = int(np.searchsorted(held, start, side="right")) - 1
        out[texts[t]].append((start - int(held[t]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _with_repeats(ids: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Texts in which ``least`` words, by their hashes, occur after different words."""
    at = gram_places(bounds, least)
    if not len(at):
        return at
    of = owner(bounds)[at]
    left = np.where(at == bounds[of], -1, ids[at - 1])
    h = gram_hashes(ids, least)[at]
    order = np.lexsort((h, of))
    h, of, left = h[order], of[order], left[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
    several = np.maximum.reduceat(left, first) != np.minimum.reduceat(left, first)
    return np.unique(of[first[several]])


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    start, length, period = np.array(runs).T
    gone = covered(start + period, length - period, len(words))
    return [words[k] for k in np.flatnonzero(~gone)]


def with_runs(docs: DataFrame, text_col: str = "text", to: str = "periodic", least_length: int = LEAST_LENGTH) -> DataFrame:
    """docs with a struct: n_words, runs (start, length and period of each), collapsed (kept words joined by one space)."""
    ship_package(docs.sparkSession)

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        words = [words_of(t.as_py()) for t in texts]
        found = runs_of(*numbered(words), least_length)
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
        kept = [b" ".join(collapse(w, runs)).decode() for w, runs in zip(words, found, strict=True)]
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(map(len, words), pa.int64()), pa.array(rows, run), pa.array(kept, pa.string())], names=["n_words", "runs", "collapsed"])

    return docs.withColumn(to, find(F.col(f"`{text_col}`").cast("string")))
