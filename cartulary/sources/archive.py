"""Archives of published tables: ZIP entries, tolerant CSV, manifests of observations."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.sources import chunks
from cartulary.storage import written

ROWS = "path string, table string, row_pos long, header array<string>, cells array<string>"
OBSERVATION = "source string, period string, month string, observedAt string, lastModified string, contentLength long, sha256 string, path string, status string, tlsVerified boolean, error string"
CHUNK = pa.schema([("path", pa.string()), ("entry", pa.int32()), ("chunk", pa.int32()), ("table", pa.string()), ("sep", pa.string()), ("header", pa.list_(pa.string())), ("content", pa.binary())])
ARCHIVE_NAME = r"([0-9]{8}T[0-9]{6}Z)-([0-9a-f]{12})\.zip$"


def delimiter(data: bytes) -> str:
    """A comma if the first line has more of them than of semicolons, else a semicolon."""
    head = re.split(rb"[\r\n]", data[:4096], maxsplit=1)[0]
    return "," if head.count(b",") > head.count(b";") else ";"


def parse_csv(text: str, sep: str) -> Iterator[list[str]]:
    """Rows of a CSV text whose quoted fields may hold stray quotes.

    A quote ends a quoted field only before a separator, a line end or the end of the
    text; two quotes are one. Any of CR, LF and CRLF ends a line; blank lines are skipped.
    """
    special = re.compile(rf'["\r\n{re.escape(sep)}]')
    row: list[str] = []
    at = start = 0
    quoted = seen = False
    n = len(text)

    def field(end: int) -> str:
        value = text[start:end]
        if seen:
            if len(value) >= 2 and value[0] == value[-1] == '"':
                value = value[1:-1]
            value = value.replace('""', '"')
        return value

    while at < n:
        if quoted:
            at = text.find('"', at)
            if at < 0:
                at = n
                break
            after = text[at + 1 : at + 2]
            if after == '"':
                at += 2
                continue
            quoted = after not in ("", sep, "\r", "\n")
            at += 1
            continue
        found = special.search(text, at)
        if not found:
            at = n
            break
        at, c = found.start(), found[0]
        if c == '"':
            quoted = seen = True
            at += 1
            continue
        row.append(field(at))
        seen = False
        at += 1
        if c != sep:
            if c == "\r" and text[at : at + 1] == "\n":
                at += 1
            if row != [""]:
                yield row
            row = []
        start = at
    if start < n or row:
        row.append(field(n))
        if row != [""]:
            yield row


def clean_header(cells: list[str]) -> list[str]:
    """Names without byte-order mark and surrounding space."""
    return [c.replace("﻿", "").strip() for c in cells]


def entries(data: bytes, size: int = chunks.CHUNK_BYTES) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Table name and content, piece by piece, of each CSV in an archive, and in archives within it; folders don't matter."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            name = info.filename.rsplit("/", 1)[-1]
            if name.lower().endswith(".csv"):
                with z.open(info) as stream:
                    yield name[:-4], iter(partial(stream.read, size), b"")
            elif name.lower().endswith(".zip"):
                yield from entries(z.read(info), size)


def read_archives(spark: SparkSession, path: str | list[str], chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """path, table, row_pos, header, cells of all rows of all archives.

    A task unpacks an archive as a stream of chunks; from then on every chunk of
    an entry is a task's work, however its quotes lie (see ``chunks``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (table, pieces) in enumerate(entries(data, chunk_bytes)):
                    for k, (sep, header, content) in enumerate(chunks.cut_up(pieces, delimiter, parse_csv)):
                        yield pa.RecordBatch.from_pylist([{"path": where, "entry": n, "chunk": k, "table": table, "sep": sep, "header": clean_header(header), "content": content}], schema=CHUNK)

    each = files.mapInArrow(split, chunks.CHUNK).repartition(max(2, 2 * spark.sparkContext.defaultParallelism), "path", "entry", "chunk")
    return chunks.rows_of(chunks.owned(written(each, "chunks", chunks.STORED)), parse_csv, ROWS)


def archive_sums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, sha256, length of every archive; contents stay in the tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


class _Hashed:
    """A stream without places to go back to, which counts the digest of what passes."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.sha = out, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.sha.update(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class _Archive:
    """An archive that is written row by row: only the row at hand is in memory. It has no name until it is whole."""

    def __init__(self, folder: str, period: str, stamp: str, sep: str) -> None:
        self.folder, self.period, self.stamp, self.sep = folder, period, stamp, sep
        self.where, self.base = fs.FileSystem.from_uri(folder)
        self.where.create_dir(f"{self.base}/{period}", recursive=True)
        self.own = f"{self.base}/{period}/{stamp}.attempt-{TaskContext.get().taskAttemptId()}"
        self.file = self.where.open_output_stream(self.own)
        self.out = _Hashed(self.file)
        self.zip = zipfile.ZipFile(self.out, "w")
        self.table, self.text = None, None

    def _end(self) -> None:
        if self.text is not None:
            self.text.close()

    def put(self, table: str, header: list[str], rows: list[list[str]]) -> None:
        """Rows of a table; tables come one after the other."""
        if table != self.table:
            self._end()
            info = zipfile.ZipInfo(f"{table}.csv")
            info.compress_type = zipfile.ZIP_DEFLATED
            # sizes come after the content, so an entry may be of any length
            self.table, self.text = table, io.TextIOWrapper(self.zip.open(info, "w", force_zip64=True), encoding="utf-8", newline="", write_through=False)
            self.csv = csv.writer(self.text, delimiter=self.sep, lineterminator="\r\n")
            self.csv.writerow(header)
        self.csv.writerows(rows)

    def done(self) -> dict[str, str]:
        self._end()
        self.zip.close()
        self.file.close()
        sha = self.out.sha.hexdigest()
        name = f"{self.period}/{self.stamp}-{sha[:12]}.zip"
        self.where.move(self.own, f"{self.base}/{name}")
        return {"period": self.period, "stamp": self.stamp, "sha256": sha, "path": f"{self.folder}/{name}"}


def write_archives(rows: DataFrame, folder: str, sep: str = ";") -> DataFrame:
    """Write rows (period, stamp, table, row_pos, header, cells) as archives; period, stamp, sha256, path for each.

    An archive is immutable: its name carries its stamp and the start of its digest,
    and it is complete once it has that name. One archive is one task's work: its rows are
    sorted by the JVM, which spills, and stream into the file, whatever their number.
    """
    names = ("period", "stamp", "table", "row_pos", "cells", "header")
    schema = pa.schema([(n, pa.string()) for n in ("period", "stamp", "sha256", "path")])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            ends = np.cumsum(pc.fill_null(batch.column(4).value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).tolist()
            cells = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([w[1:] != w[:-1] for w in where])) + 1).tolist(), batch.num_rows]
            for start, end in pairwise(cuts):
                period, stamp, table = (w[start] for w in where)
                if held is None or (held.period, held.stamp) != (period, stamp):
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([held.done()], schema=schema)
                    held = _Archive(folder, period, stamp, sep)
                held.put(table, batch.column(5)[start].as_py(), cells[start:end])
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.done()], schema=schema)

    # rows of equal place go by content, so that a task that is run again writes the same bytes
    ordered = rows.select(*names).repartition("period", "stamp").sortWithinPartitions(*names)
    return written(ordered.mapInArrow(put, "period string, stamp string, sha256 string, path string"), "archives")


def archive_list(spark: SparkSession, path: str) -> DataFrame:
    """path, period, stamp, short: archives by name, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.select("path", "length", F.regexp_extract("path", r"/([0-9]{4,6})/[^/]*$", 1).alias("period"), F.regexp_extract("path", ARCHIVE_NAME, 1).alias("stamp"), F.regexp_extract("path", ARCHIVE_NAME, 2).alias("short"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Observations from JSON lines; old lines name the period month and lack tlsVerified."""
    raw = spark.read.schema(OBSERVATION).json(path)
    return raw.select("source", F.coalesce("period", "month").alias("period"), F.col("observedAt").alias("observed_at"), F.col("lastModified").alias("last_modified"), F.col("contentLength").alias("content_length"), "sha256", "path", "status", F.coalesce("tlsVerified", F.lit(True)).alias("tls_verified"), "error")


def append_manifest(observations: DataFrame, path: str) -> None:
    """Append observations to a manifest: JSON lines under the published names, a new file each time; what is there stays."""
    names = {"period": "period", "observed_at": "observedAt", "last_modified": "lastModified", "content_length": "contentLength", "tls_verified": "tlsVerified"}
    observations.select(*[F.col(c).alias(names.get(c, c)) for c in observations.columns]).write.mode("append").json(path)


def named_columns(rows: DataFrame, table: str, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """A table's rows as columns found by header name, whatever its case and place; absent ones are null.

    columns maps each result column to the header names to try, in order.
    """
    upper = F.transform("header", lambda h: F.upper(h))

    def cell(names: tuple[str, ...]):
        places = [F.nullif(F.array_position(upper, n.upper()), F.lit(0).cast("long")) for n in names]
        found = F.coalesce(*places)
        return F.when(found.isNotNull(), F.get("cells", found.cast("int") - 1))

    return rows.filter(F.col("table") == table).select("path", "row_pos", *[cell(names).alias(c) for c, names in columns.items()])


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table; empty with the schema if there is none, or only an empty folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(where) and (fs.getFileStatus(where).isFile() or len(list(fs.listStatus(where))) > 0)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
