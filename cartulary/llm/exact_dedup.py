"""Exact deduplication with two Bloom passes.

Pass 1 reads one 64-bit hash per row. Every task keeps two bit arrays: bits set
once and bits set more than once. The arrays are merged block by block in two
levels, and a bit counts as repeated if two hashes set it anywhere. A hash all
of whose bits are repeated is *possibly* repeated; a hash that occurs twice
always is. Pass 2 probes that filter: only possibly repeated rows are shuffled
and compared exactly, the rest pass straight through.

The filter has a fixed upper size (``max_filter_bytes``), so what is sent to
executors doesn't grow without bound. As it fills, hashes set fewer bits (down to
one), which keeps most single rows out of the shuffle up to about two rows a bit;
beyond that more and more rows take the exact path, of which only hashes are
shuffled in ``decisions``. Results never change.

Defined cases: a null text counts as empty; a null id counts as larger than any
id; rows equal in id and text are copies of each other; an empty table gives an
empty result. Only the named columns of the input are read, so other columns
may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.shared import materialise, one_spaced, ship_package

BITS_PER_ROW = 16
PROBES = 4
BLOCK_BYTES = 8192
MAX_FILTER_BYTES = 64 << 20
#: Groups at least this large, and of at least a thousandth of the rows, are joined by broadcast.
HOT_GROUP = 1000


def filter_bits(rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> int:
    """Bits of the filter for so many rows: a power of two, at least one block."""
    wanted = max(BLOCK_BYTES * 8, rows * BITS_PER_ROW)
    return min(1 << (wanted - 1).bit_length(), 1 << ((max_filter_bytes * 8).bit_length() - 1))


class Filter(NamedTuple):
    """Bits as bytes, and how many of them a hash sets."""

    bitmap: np.ndarray
    count: int


def probe_count(rows: int, bits: int) -> int:
    """How many bits a hash sets: PROBES while there is room, one in a crowded filter."""
    return max(1, min(PROBES, bits // (4 * max(1, rows))))


def probes(hashes: np.ndarray, bits: int, count: int = PROBES) -> np.ndarray:
    """Bit positions of each hash, one row per hash, by double hashing."""
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    at = h[:, None] + step[:, None] * np.arange(count, dtype=np.uint64)[None, :]
    return (at * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) & np.uint64(bits - 1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _get(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _merge(a: tuple[np.ndarray, np.ndarray], once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return a[0] | once, a[1] | twice | (a[0] & once)


def bloom_filter(hashes: DataFrame, rows: int, max_filter_bytes: int = MAX_FILTER_BYTES, repeated: bool = False) -> Filter:
    """Bits that the hashes in the one column set, or with ``repeated`` those that at least two of them set.

    Tasks send compressed blocks; blocks meet in two levels, so that no task
    gets a block from every other task. The driver gets the merged filter only,
    of at most ``max_filter_bytes``.
    """
    bits = filter_bits(rows, max_filter_bytes)
    count_of = probe_count(rows, bits)
    schema = "block int, slot int, once binary, twice binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        slot, seen = 0, False
        for batch in batches:
            h = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            if not len(h):
                continue
            if not seen:
                slot, seen = int(h[0]) & 63, True
            at, count = np.unique(probes(h, bits, count_of).ravel(), return_counts=True)
            _set(twice, at[(count > 1) | _get(once, at)])
            _set(once, at)
        blocks = once.reshape(-1, BLOCK_BYTES)
        used = np.flatnonzero(blocks.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 256)):
            if len(part):
                yield pa.RecordBatch.from_arrays([
                    pa.array(part, pa.int32()), pa.array(np.full(len(part), slot), pa.int32()),
                    pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in part], pa.binary()),
                    pa.array([zlib.compress(twice.reshape(-1, BLOCK_BYTES)[k].tobytes(), 1) for k in part], pa.binary()),
                ], names=["block", "slot", "once", "twice"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = (np.zeros(BLOCK_BYTES, np.uint8), np.zeros(BLOCK_BYTES, np.uint8))
        for once, twice in zip(group["once"], group["twice"], strict=True):
            total = _merge(total, np.frombuffer(zlib.decompress(once), np.uint8), np.frombuffer(zlib.decompress(twice), np.uint8))
        return pd.DataFrame({"block": [group["block"].iloc[0]], "slot": [0], "once": [zlib.compress(total[0].tobytes(), 1)], "twice": [zlib.compress(total[1].tobytes(), 1)]})

    merged = hashes.mapInArrow(local, schema).groupBy("block", "slot").applyInPandas(merge, schema).groupBy("block").applyInPandas(merge, schema)
    out = np.zeros((bits // 8 // BLOCK_BYTES, BLOCK_BYTES), np.uint8)
    kept = "twice" if repeated else "once"
    for row in merged.select("block", kept).toLocalIterator():
        out[row["block"]] = np.frombuffer(zlib.decompress(row[kept]), np.uint8)
    return Filter(out.ravel(), count_of)


def probed(df: DataFrame, hashed: Column, made: Filter) -> Column:
    """A condition on rows of df: whether all bits of a hash are set in the filter."""
    sent = df.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        bitmap, count = sent.value
        return pd.Series(_get(bitmap, probes(h.to_numpy(), len(bitmap) * 8, count)).all(axis=1))

    return probe(hashed)


def possibly_among(df: DataFrame, hashed: Column, keys: DataFrame) -> Column:
    """A condition on rows of df: true for every row whose hash is in the one column of keys, and few others."""
    ship_package(df.sparkSession)
    return probed(df, hashed, bloom_filter(keys, keys.count()))


def possibly_repeated(df: DataFrame, hashed: Column, max_filter_bytes: int = MAX_FILTER_BYTES, rows: int | None = None) -> Column:
    """A condition on rows of df: true for every row whose hash occurs more than once, and few others."""
    ship_package(df.sparkSession)
    made = bloom_filter(df.select(hashed.alias("h")), df.count() if rows is None else rows, max_filter_bytes, True)
    return probed(df, hashed, made)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. Groups that hold a
    thousandth of all rows or more (there can be a thousand at most) reach the
    rows by broadcast, smaller ones by a join on the hash; so no task gets a hot group.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), one_spaced(text_col).alias("t"))
    n = docs.count()
    hit = possibly_repeated(base, F.xxhash64("t"), max_filter_bytes, n)
    rows = materialise(base.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), hit.alias("maybe"), F.monotonically_increasing_id().alias("rid")), "hashed")
    again = rows.filter("maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
    groups = materialise(again.groupBy("sha").agg(first.alias("f"), F.count("*").alias("group_size")).filter("group_size > 1").select("sha", F.col("f.doc_id").alias("keep_id"), F.col("f.rid").alias("keep_rid"), "group_size"), "groups")
    least = max(HOT_GROUP, n // 1000)
    hot, rest = groups.filter(F.col("group_size") >= least), groups.filter(F.col("group_size") < least)
    by_hot = again.join(F.broadcast(hot.withColumnRenamed("sha", "hot_sha")), F.col("sha") == F.col("hot_sha"), "left")
    held = F.col("hot_sha").isNotNull()
    kept = F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True))
    out = ["doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    single = rows.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    cold = by_hot.filter(~held).select("doc_id", "sha", "rid").join(rest, "sha", "left")
    return single.unionByName(by_hot.filter(held).select(*out)).unionByName(cold.select(*out))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that surely have no copy aren't shuffled. For the others each task first
    drops all but its own first row of a text, so a hot text doesn't gather anywhere.
    Of rows that share an id, the one whose raw text has the least hash comes first.
    """
    t = one_spaced(text_col)
    hit = possibly_repeated(docs, F.xxhash64(t), max_filter_bytes)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    marked = docs.select(row, F.sha2(t, 256).alias("sha"), F.col(id_col).alias("k"), F.xxhash64(text_col).alias("raw"), hit.alias("maybe"))
    order = Window.partitionBy("sha").orderBy(F.col("k").asc_nulls_last(), "raw")
    first = marked.filter("maybe").withColumn("n", F.row_number().over(order)).filter("n = 1").select("row")
    return marked.filter("not maybe").select("row").unionByName(first).select("row.*")
