"""Removal of repeated byte strings across documents, by suffix sorting.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts
earlier (smaller document id, or the same document and an earlier start). Strings
are judged on the input; matches never cross documents.

To sort suffixes of any amount of text in bounded tasks, starts are dealt out so
that equal strings meet. The *seed* of a start is the ``SEED``-byte string within its
LENGTH bytes whose hash is least (leftmost, if several): equal strings have equal
seeds at equal offsets. Neighbouring starts mostly share their seed; such a run
travels as one *piece*. Then

1. each task hashes its documents, cuts them into pieces, settles pieces with equal
   content among its own (all but the first are repeats as a whole) and sends seed,
   content hash, place and length of the others, packed, by ranges of the seed's hash;
2. in each range pieces of equal content are settled likewise, pieces with a seed
   of their own are dropped, and of each content that shares its seed with another
   content one piece stays;
3. the bytes of these are fetched, those of a range are joined to one text, and a
   two-stage suffix sort (see suffixes.py) with adjacent common prefixes finds the
   starts whose strings are equal; all but the first of each are repeats;
4. repeated stretches of a document are united and cut out.

A seed in a passage that very many documents share would gather a piece from
each of them. Seeds that are frequent in a sample of documents are therefore chosen
only where a string has no other, that is, only inside such a passage, where pieces
are equal and settle early. The sample decides how work is dealt out, never what
is found, and bounds nothing: seeds with HOT different pieces or more are counted
over all documents. Their pieces are dealt out anew as single starts, each by the
hash of its whole string, so that no range and no sort part gathers them.

Defined cases: null counts as empty; a null id comes after all ids; rows that share
an id come in the order of a hash of their text; rows with equal id and text are
one document and get the same result; texts shorter than LENGTH keep all; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import give_back_memory, materialise, ship_package, text_or_empty
from cartulary.llm.suffixes import common_prefixes, suffix_array, words

LENGTH = 100
SEED = 32
#: Starts that are hashed at once, pieces that a task gathers before it sends them.
REGION = 1 << 17
GATHERED = 250_000
#: Pieces for a range, parts in which a range's suffixes are sorted, and the documents of the sample.
RANGE_PIECES = 200_000
SORT_PARTS = 32
SAMPLE = 1536
SAMPLE_CHARS = 6000
#: Pieces from which on a seed is hot, and pieces of a seed in one sending from which on they are counted.
HOT = 4096
COUNTED = 8

_RANDOM = np.random.default_rng(1)
_BYTES = _RANDOM.integers(1 << 63, dtype=np.uint64, size=256)
_ODD = _RANDOM.integers(1 << 63, dtype=np.uint64, size=16) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 4, 32 and 64 bytes from each place on, by doubling."""
    h, made, n = _BYTES[data], {}, 1
    for k in range(6):
        if len(h) <= n:
            h = np.zeros(0, np.uint64)
        else:
            h = h[:-n] * _ODD[k] + h[n:]
        n *= 2
        made[n] = h
    return made[4], made[32], made[64]


class Frequent:
    """Seeds that should be avoided."""

    def __init__(self, seeds: np.ndarray) -> None:
        self.seeds = np.unique(seeds)
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.seeds >> np.uint64(44)] = True

    def __call__(self, seeds: np.ndarray) -> np.ndarray:
        """Which of the seeds are frequent."""
        out = self.quick[seeds >> np.uint64(44)]
        if len(self.seeds):
            at = np.flatnonzero(out)
            near = np.minimum(np.searchsorted(self.seeds, seeds[at]), len(self.seeds) - 1)
            out[at] = self.seeds[near] == seeds[at]
        return out


def _low(seeds: np.ndarray) -> np.ndarray:
    """The part of seeds that is sent."""
    return seeds & np.uint64((1 << 8 * _KEPT[0]) - 1)


def frequent(texts: list[bytes]) -> np.ndarray:
    """Seeds in many of the texts: 8 at least, and a 512th of them."""
    least = max(8, len(texts) // 512)
    found = [np.unique(_mixed(hashes(np.frombuffer(t, np.uint8))[1])) for t in texts]
    seeds, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
    return seeds[count >= least]


def pieces(data: np.ndarray, ends: np.ndarray, first: int, last: int, avoid: Frequent, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Start, number of starts, seed and content hash of the pieces whose starts are in [first, last).

    With hot, only of pieces with these seeds, start by start, the whole string's hash as seed.
    data holds documents end to end; ends has, for each place in the range, the end of its document.
    """
    part = data[first : min(len(data), last + LENGTH - 1)]
    none = np.zeros(0, np.int64)
    if len(part) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h4, h32, h64 = hashes(part)
    seeds = _mixed(h32)
    place = np.arange(len(seeds), dtype=np.uint64)
    low = (seeds >> np.uint64(33) | avoid(seeds).astype(np.uint64) << np.uint64(31)) << np.uint64(32) | place
    width, span = 1, LENGTH - SEED + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    n = min(len(low), last - first)
    at = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = ends[:n] - (first + np.arange(n)) >= LENGTH
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, n))
    good = valid[start]
    start, count = start[good], count[good]
    stop = start + count - 1

    def whole(i: np.ndarray) -> np.ndarray:
        return (h64[i] * _ODD[8] + h32[i + 64]) * _ODD[9] + h4[i + 96]

    content = _mixed(whole(start) * _ODD[10] + whole(stop) * _ODD[11] + count.astype(np.uint64))
    # the least hashes are small numbers; multiplied they are spread evenly over the ranges
    seed = seeds[at[start]] * _ODD[12]
    if hot is not None:
        among = np.isin(_low(seed), hot)
        start = np.repeat(start[among], count[among]) + _steps(count[among])
        count = np.ones(len(start), np.int64)
        string = whole(start)
        return start + first, count, _mixed(string) * _ODD[13], _mixed(string * _ODD[10] + count.astype(np.uint64))
    return start + first, count, seed, content


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, end to end."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _places(offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and document end of the places in [first, last)."""
    doc = np.searchsorted(offsets, np.arange(first, last), side="right") - 1
    return doc, offsets[doc + 1]


def _planes(a: np.ndarray, keep: int) -> bytes:
    """The low bytes of numbers, byte by byte, so that equal high bytes lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, :keep].T).tobytes()


def _unplaned(data: bytes, n: int, at: int, keep: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :keep] = np.frombuffer(data, np.uint8, n * keep, at).reshape(keep, n).T
    return out.view(np.uint64).ravel(), at + n * keep


_KEPT = (6, 8, 8, 8, 5, 1)


def _packed(columns: tuple[np.ndarray, ...]) -> bytes:
    """Pieces as bytes: seed, content, document key (two columns), start, number of starts."""
    return b"".join(_planes(c.astype(np.uint64, copy=False), k) for c, k in zip(columns, _KEPT, strict=True))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n, at, out = len(blob) // sum(_KEPT), 0, []
    for keep in _KEPT:
        column, at = _unplaned(blob, n, at, keep)
        out.append(column)
    return out


#: Keeps the order of signed ids, with null last.
def _ordered(ids: pa.Array) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return np.where(known, (ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) - np.uint64(0), np.uint64((1 << 64) - 1))


def _settle(seed: np.ndarray, content: np.ndarray, d: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by seed, content and place, and which in that order come first with their content.

    A piece in the place of its content's first one comes from a row equal in id and text, and is left out.
    """
    order = np.lexsort((start, x, d, content, seed))
    s, c = seed[order], content[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
    first = order[fresh][np.cumsum(fresh) - 1]
    kept = fresh | (d[order] != d[first]) | (x[order] != x[first]) | (start[order] != start[first])
    return order[kept], fresh[kept]


SPAN = "d long, x long, start long, stop long"
_SIGN = np.uint64(1 << 63)


def _spans(d: np.ndarray, x: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    start = start.astype(np.int64)
    return [pa.array((d ^ _SIGN).view(np.int64)), pa.array(x.view(np.int64)), pa.array(start), pa.array(start + count.astype(np.int64) + LENGTH - 1)]


def scanned(keyed: DataFrame, ranges: int, avoid: np.ndarray, hot: np.ndarray | None = None) -> DataFrame:
    """Packed pieces by range, (in range -1) the stretches that are repeats within a task, and (in range -2) seeds (d) with a count (x) of pieces.

    With hot, only pieces with these seeds, as single starts. keyed has d (id), x (hash among equal ids) and data (bytes).
    """
    sent = keyed.sparkSession.sparkContext.broadcast((avoid, hot))
    schema = f"range int, blob binary, {SPAN}"
    names = [c.split()[0] for c in schema.split(", ")]

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        seed, content, d, x, start, count = (np.concatenate(c) for c in zip(*held, strict=True))
        order, fresh = _settle(seed, content, d, x, start)
        again = order[~fresh]
        if len(again):
            n = len(again)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1), pa.int32()), pa.nulls(n, pa.binary()), *_spans(d[again], x[again], start[again], count[again])], names=names)
        first = order[fresh]
        columns = tuple(c[first] for c in (seed, content, d, x, start, count))
        edge = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
        many = np.diff(np.append(edge, len(first)))
        noted = many >= COUNTED
        if hot is None and noted.any():
            n, none = int(noted.sum()), pa.nulls(int(noted.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -2), pa.int32()), pa.nulls(n, pa.binary()), pa.array(_low(columns[0][edge[noted]]).astype(np.int64)), pa.array(many[noted]), none, none], names=names)
        to = (columns[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        for some in range(0, len(cuts) - 1, 256):
            pairs = list(zip(cuts[some : some + 256], cuts[some + 1 : some + 257], strict=False))
            blobs = [_packed(tuple(c[a:b] for c in columns)) for a, b in pairs]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in pairs], pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(n, pa.int64())] * 4], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, only = Frequent(sent.value[0]), sent.value[1]
        held, size = [], 0
        for batch in batches:
            for some in _cut(batch):
                d, x = _ordered(some.column(0)), some.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                data, offsets = _buffers(some.column(2))
                for first in range(0, len(data), REGION):
                    last = min(len(data), first + REGION)
                    doc, ends = _places(offsets, first, last)
                    start, count, seed, content = pieces(data, ends, first, last, often, only)
                    mine = doc[start - first]
                    held.append((seed, content, d[mine], x[mine], (start - offsets[mine]).astype(np.uint64), count.astype(np.uint64)))
                    size += len(start)
                    if size >= GATHERED:
                        yield from flush(held)
                        held, size = [], 0
                        give_back_memory()
        if size:
            yield from flush(held)
        held = []
        give_back_memory()

    return keyed.mapInArrow(run, schema)


def without(found: DataFrame, hot: np.ndarray) -> DataFrame:
    """range and blob of scanned pieces, without those of hot seeds."""
    sent = found.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for blob in batch.column(1).to_pylist():
                columns = _unpacked(blob)
                other = ~np.isin(columns[0], sent.value)
                blobs.append(blob if other.all() else _packed(tuple(c[other] for c in columns)) or None)
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["range", "blob"])
            yield made.filter(made.column(1).is_valid())

    return found.mapInArrow(run, "range int, blob binary")


def dealt(keyed: DataFrame, ranges: int, avoid: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Packed pieces by range (range, blob), in which no seed has many different ones, and stretches (SPAN) that are repeats."""
    found = materialise(scanned(keyed, ranges, avoid), "pieces")
    counts = found.filter("range = -2").groupBy("d").agg(F.sum("x").alias("n")).filter(F.col("n") >= HOT)
    # a seed for HOT pieces at most
    hot = np.sort(np.array([r["d"] for r in counts.select("d").toLocalIterator()], np.uint64))
    packed = found.filter("range >= 0").select("range", "blob")
    local = found.filter("range = -1").select("d", "x", "start", "stop")
    if not len(hot):
        return packed, local
    again = materialise(scanned(keyed, ranges, avoid, hot), "starts")
    return without(packed, hot).unionByName(again.filter("range >= 0").select("range", "blob")), local.unionByName(again.filter("range = -1").select("d", "x", "start", "stop"))


def _cut(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes."""
    width = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, width):
        yield batch.slice(start, width)


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and where each begins, with the end."""
    wide = pa.types.is_large_binary(values.type)
    raw = values.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def matched(group: pd.DataFrame) -> pd.DataFrame:
    """A range's repeated stretches (want -1), and the pieces whose bytes are wanted, by part of the range."""
    columns = [np.concatenate(c) for c in zip(*(_unpacked(b) for b in group["blob"]), strict=True)]
    seed, content, d, x, start, count = columns
    order, fresh = _settle(seed, content, d, x, start)
    first = order[fresh]
    s = seed[first]
    edge = np.ones(len(s) + 1, bool)
    edge[1:-1] = s[1:] != s[:-1]
    shared = first[~(edge[:-1] & edge[1:])]
    took = np.concatenate([order[~fresh], shared])
    part = int(group["range"].iloc[0]) * SORT_PARTS + (seed[shared] % np.uint64(SORT_PARTS)).astype(np.int64)
    want = np.concatenate([np.full(len(order) - len(first), -1), part])
    arrays = _spans(d[took], x[took], start[took], count[took])
    return pd.DataFrame({"want": want, **{c: a.to_numpy() for c, a in zip(("d", "x", "start", "stop"), arrays, strict=True)}})


def repeats(group: pd.DataFrame) -> pd.DataFrame:
    """Repeated stretches among the pieces of a range, by suffix sorting."""
    group = group.sort_values(["d", "x", "start"], key=lambda c: _as_order(c) if c.name == "d" else (c.to_numpy().view(np.uint64) if c.name == "x" else c))
    data = group["data"].tolist()
    size = np.array([len(b) for b in data])
    text = np.frombuffer(b"".join(data), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(data)), size)
    window = begin[owner + 1] - np.arange(len(text)) >= LENGTH
    order = suffix_array(text)
    order = order[window[order]]
    word = words(text)
    same = np.append(False, common_prefixes(order[:-1], order[1:], word, LENGTH) >= LENGTH)
    classes = np.cumsum(~same)
    # pieces are in the order of their places, so the least place in the text is the earliest
    lowest = np.full(classes[-1] + 1 if len(classes) else 1, len(text), np.int64)
    np.minimum.at(lowest, classes, order)
    again = np.sort(order[order != lowest[classes]])
    if not len(again):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("d", "x", "start", "stop")})
    split = np.append(True, (again[1:] != again[:-1] + 1) | (owner[again[1:]] != owner[again[:-1]]))
    a, b = again[split], again[np.append(split[1:], True)]
    piece = owner[a]
    base = group["start"].to_numpy()[piece] - begin[piece]
    return pd.DataFrame({"d": group["d"].to_numpy()[piece], "x": group["x"].to_numpy()[piece], "start": base + a, "stop": base + b + LENGTH})


def _as_order(c: pd.Series) -> np.ndarray:
    return c.to_numpy().view(np.uint64) ^ _SIGN


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents with their keys (d, x, doc_id, data), and the repeated stretches (d, x, start, stop)."""
    spark = docs.sparkSession
    ship_package(spark)
    t = text_or_empty(text_col)
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).alias("n_bytes")).first()
    n, n_bytes = size["n"], size["n_bytes"]
    unique = not ids.groupBy("i").count().filter("count > 1").limit(1).count()
    null_key = (1 << 63) - 1
    x = F.lit(0).cast("long") if unique else F.xxhash64(t)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_key)).alias("d"), x.alias("x"), F.col(id_col).alias("doc_id"), t.cast("binary").alias("data"))
    every = max(1, -(-n // SAMPLE))
    sample = [bytes(r["s"]) for r in docs.filter(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(every)) == 0).select(F.substring(t, 1, SAMPLE_CHARS).cast("binary").alias("s")).limit(2 * SAMPLE).toLocalIterator()]
    ranges = int(min(1 << 31, max(32, n_bytes / ((LENGTH - SEED + 2) / 2) / RANGE_PIECES)))
    packed, local = dealt(keyed.select("d", "x", "data"), ranges, frequent(sample))
    settled = materialise(packed.groupBy("range").applyInPandas(matched, f"want long, {SPAN}"), "settled")
    wanted = settled.filter("want >= 0")
    per_doc = wanted.groupBy("d", "x").agg(F.collect_list(F.struct("want", "start", "stop")).alias("wanted"))
    joined = keyed.select("d", "x", "data").join(per_doc, ["d", "x"])
    # rows equal in id and text give the same pieces: one of them is enough
    fetched = joined.select("d", "x", "data", F.explode("wanted").alias("w")).select("w.want", "d", "x", "w.start", F.expr("substring(data, cast(w.start as int) + 1, cast(w.stop - w.start as int))").alias("data"))
    if not unique:
        fetched = fetched.dropDuplicates(["want", "d", "x", "start"])
    sorted_ = materialise(fetched.groupBy("want").applyInPandas(repeats, SPAN), "repeats")
    return keyed, local.unionByName(settled.filter("want < 0").select("d", "x", "start", "stop")).unionByName(sorted_)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of starts and stops, united), kept (bytes that are left) of each document."""
    keyed, spans = removed_spans(docs, id_col, text_col)
    per_doc = spans.groupBy("d", "x").agg(F.collect_list(F.struct("start", "stop")).alias("all"))
    rows = keyed.join(per_doc, ["d", "x"], "left").select("doc_id", "data", F.col("all.start").alias("a"), F.col("all.stop").alias("b"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _cut(batch):
                made = [_united(*v) for v in zip(*(some.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())),
                    pa.array([m[2] for m in made], pa.list_(pa.int64())), pa.array([m[3] for m in made], pa.binary()),
                ], names=["doc_id", "n_bytes", "starts", "stops", "kept"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, starts array<long>, stops array<long>, kept binary")


def _united(data: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[int, list[int], list[int], bytes]:
    """Length, united stretches and what they leave."""
    if not starts:
        return len(data), [], [], data
    a, b = np.array(starts), np.array(stops)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    fresh = np.append(True, a[1:] > b[:-1])
    begin, end = a[fresh], b[np.append(fresh[1:], True)]
    kept = [data[i:j] for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)]
    return len(data), begin.tolist(), end.tolist(), b"".join(kept)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    made = cut(docs, id_col, text_col)
    return made.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


