"""One CSV entry over many tasks: chunks whose quote state is found by composing transition tables.

Where a record ends depends on whether a line end lies within quotes, which depends
on all bytes before. A chunk can't know them, but it can say for each state in which
it may start in which state it ends, where its first record ends and how many it
ends: a table of six rows. Tables compose, so a scan over the few numbers of an
entry's chunks gives the true state at each cut and the number of rows before it.
What lies before the first record end of a chunk belongs to the last chunk
before it that has one.

States are where a byte stands (outside quotes, inside, or after a quote inside that
may close the field) and whether the row has said anything yet, because blank rows
have no number: a row that is nothing, or only an empty quoted field, is blank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.storage import written

#: States: outside, inside, after a quote inside; first for rows without content, then for others.
OUT, IN, CLOSING, OUT_SAID, IN_SAID, CLOSING_SAID = range(6)
#: Next state after a quote, a separator, a line end and any other byte.
NEXT = {
    OUT: (IN, OUT_SAID, OUT, OUT_SAID),
    IN: (CLOSING, IN_SAID, IN_SAID, IN_SAID),
    CLOSING: (IN_SAID, OUT_SAID, OUT, IN_SAID),
    OUT_SAID: (IN_SAID, OUT_SAID, OUT, OUT_SAID),
    IN_SAID: (CLOSING_SAID, IN_SAID, IN_SAID, IN_SAID),
    CLOSING_SAID: (IN_SAID, OUT_SAID, OUT, IN_SAID),
}
QUOTE, SEPARATOR, LINE_END, OTHER = range(4)
ENDS_HERE = (OUT, CLOSING, OUT_SAID, CLOSING_SAID)

CHUNK = "path string, entry int, chunk int, table string, sep string, header array<string>, content binary"
CHUNK_BYTES = 4 << 20
#: How chunks are stored: a writer or reader holds 16 MiB of them. Parquet's own rule looks at sizes once in a hundred rows.
STORED = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}


def transitions(data: bytes, sep: bytes) -> list[tuple[int, int, int, int]]:
    """For each start state: end state, the place after the first record end (-1: none), rows that end, and how many at the first end.

    Start states that have met go on as one.
    """
    now = tuple(range(6))
    cuts, first, rows = [-1] * 6, [0] * 6, [0] * 6
    known: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = {}
    ended: dict[tuple[int, ...], int] = {}
    waiting, at = set(range(6)), 0

    def step(kind: int) -> None:
        nonlocal now
        found = known.get((now, kind))
        if found is None:
            ending = tuple(s for s in range(6) if kind == LINE_END and now[s] in ENDS_HERE)
            found = known[now, kind] = (tuple(NEXT[s][kind] for s in now), ending, tuple(s for s in ending if now[s] >= OUT_SAID))
        now, ending, said = found
        if ending:
            ended[said] = ended.get(said, 0) + 1
            for s in waiting.intersection(ending):
                cuts[s], first[s] = at + 1, int(s in said)
            waiting.difference_update(ending)

    kinds = {b'"': QUOTE, sep: SEPARATOR, b"\r": LINE_END, b"\n": LINE_END}
    for found in re.finditer(rb'["\r\n' + re.escape(sep) + rb"]", data):
        if found.start() > at:
            step(OTHER)
        at = found.start()
        step(kinds[found[0]])
        at += 1
    if at < len(data):
        step(OTHER)
    for said, n in ended.items():
        for s in said:
            rows[s] += n
    return list(zip(now, cuts, rows, first, strict=True))


def cut_up(pieces: Iterator[bytes], delimiter: Callable[[bytes], str], parse: Callable[[str, str], Iterator[list[str]]]) -> Iterator[tuple[str, list[str], bytes]]:
    """Separator, header and content of each chunk of an entry; the first ones are held until the header is whole."""
    held: list[bytes] = []
    sep, header = None, None
    for piece in pieces:
        if header is not None:
            yield sep, header, piece
            continue
        held.append(piece)
        start = b"".join(held)
        if len(start) < 4096:
            continue
        sep = delimiter(start)
        header = _whole_header(start, sep, parse)
        if header is not None:
            for early in held:
                yield sep, header, early
    if header is None:
        start = b"".join(held)
        sep = delimiter(start)
        header = next(parse(start.decode("utf-8", "replace"), sep), [])
        for early in held:
            yield sep, header, early


def _whole_header(start: bytes, sep: str, parse: Callable[[str, str], Iterator[list[str]]]) -> list[str] | None:
    """The first record, if it ends within these bytes."""
    after, state = 0, OUT
    while True:
        state, _, rows, _ = transitions(start[after : after + 4096], sep.encode())[state]
        after += 4096
        if rows:
            return next(parse(start[:after].decode("utf-8", "replace"), sep))
        if after >= len(start):
            return None


def _numbered(group: pd.DataFrame) -> pd.DataFrame:
    """The scan over an entry's chunks: where each is cut, to which its beginning belongs, and the number of its first row."""
    group = group.sort_values("chunk")
    state, rows, owner, out = OUT, 0, 0, []
    for chunk, table in zip(group["chunk"], group["moves"], strict=True):
        end, cut, ended, first = (int(x) for x in table[4 * state : 4 * state + 4])
        out.append((chunk, cut, owner, rows + first) if chunk else (0, 0, 0, 0))
        if cut >= 0:
            owner = chunk
        state, rows = end, rows + ended
    made = pd.DataFrame(out, columns=["chunk", "cut", "owner", "first_row"])
    return made.assign(path=group["path"].iloc[0], entry=group["entry"].iloc[0])[["path", "entry", "chunk", "cut", "owner", "first_row"]]


def owned(chunks: DataFrame) -> DataFrame:
    """Chunks with the cut, the number of their first row and the beginnings of later chunks that belong to them.

    Only the numbers of an entry meet in a task. Beginnings are shuffled by
    themselves; they are as long as the rows that lie across cuts.
    """

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one content at a time leaves its buffer
            tables = [[n for row in transitions(batch.column(4)[i].as_py(), batch.column(3)[i].as_py().encode()) for n in row] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(tables, pa.list_(pa.int64()))], names=["path", "entry", "chunk", "moves"])

    tables = chunks.select("path", "entry", "chunk", "sep", "content").mapInArrow(moves, "path string, entry int, chunk int, moves array<bigint>")
    places = written(tables.groupBy("path", "entry").applyInPandas(_numbered, "path string, entry int, chunk int, cut long, owner int, first_row long"), "cuts")
    key = ["path", "entry", "chunk"]
    beginning = F.when(F.col("cut") < 0, F.col("content")).otherwise(F.expr("substring(content, 1, cast(cut as int))"))
    later = chunks.select(*key, "content").join(places.filter("chunk > 0"), key).select("path", "entry", F.col("owner").alias("to"), "chunk", beginning.alias("bytes"))
    tails = later.filter(F.length("bytes") > 0).groupBy("path", "entry", F.col("to").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("chunk", "bytes"))).alias("t"))
    own = chunks.join(places, key)
    return own.join(tails.select(*key, F.transform("t", lambda x: x["bytes"]).alias("tails")), key, "left")


def rows_of(chunks: DataFrame, parse: Callable[[str, str], Iterator[list[str]]], schema: str, most: int = 5000) -> DataFrame:
    """path, table, row_pos, header, cells of all rows of chunks as ``owned`` gives them; row 0 of an entry is its header and left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["cut"] < 0:
                    continue
                text = (row["content"][row["cut"] :] + b"".join(row["tails"] or ())).decode("utf-8", "replace")
                rows = parse(text, row["sep"])
                first = row["first_row"]
                if not first and next(rows, None) is not None:
                    first = 1
                while held := list(islice(rows, most)):
                    yield _batch(row["path"], row["table"], first - 1, row["header"], held)
                    first += len(held)

    return chunks.mapInArrow(work, schema)


def _batch(where: str, table: str, first: int, header: list[str], rows: list[list[str]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([where] * n), pa.array([table] * n), pa.array(range(first, first + n), pa.int64()), pa.array([header] * n, pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))], names=["path", "table", "row_pos", "header", "cells"])
