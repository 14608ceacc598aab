"""Writing and reading WARC archives, with segments put together again.

Writing: each row becomes a record. Of rows with equal payloads (of at least
``min_bytes``) the one with the smallest id is a response, the others are
revisits that refer to it and carry no payload. Payloads go out in chunked
transfer framing; a record whose block exceeds ``segment_bytes`` is cut into a
first segment and continuation records. Every record is a gzip member of its own.
Tasks write files of their own, closed at about FILE_BYTES of records.

Reading: tasks parse whole files, gzipped or not, of this or any other writer. Unsegmented
records are decoded in place. Segments are grouped by the identifier of the record that they
continue, ordered by segment number, checked for gaps and against the stated total length,
joined and then decoded from chunked framing; each group is one record. Digests are
checked. Records of KEPT types are returned, others (warcinfo, request, metadata, unknown ones) are passed
over; ``inventory`` counts all. Identifiers are opaque text; only those that this module
wrote name a page. Digests are optional, blocks that aren't HTTP are payloads as they are.

Defined cases: a null payload counts as empty; a null id stays null and comes
after all ids; rows with the same id and payload are of the same type; control
characters in a URL are percent-encoded and a null URL is empty; a payload that
fails its digest or length, or segments that lack one of their number, are an error, or with ``strict=False`` a row
whose ``digest_ok`` is false (its payload is null where it can't be put together); digest_ok is null where
nothing is stated that can be checked; an empty table gives no records; other columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.exact_dedup import bloom_filter, probed
from cartulary.llm.files import read_bytes, task_number, whole_file
from cartulary.llm.shared import fresh_dir, join_groups, materialise, ship_package, text_or_empty

CHUNK_BYTES = 8192
SEGMENT_BYTES = 65536
FILE_BYTES = 64 << 20
GZIP_LEVEL = 4
#: Files that one task reads back, on average, once there are enough for all cores.
FILES_READ = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, refers_to_id string, digest_ok boolean"
PARTS = RECORDS + ", origin_id string, segment int, total_length long"
#: Types of records that hold payloads or stand for one.
KEPT = frozenset({"response", "revisit", "resource", "conversion", "continuation"})


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), CHUNK_BYTES):
        part = payload[i : i + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def from_chunks(data: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions are ignored and trailers skipped."""
    parts, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(parts)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        parts.append(data[at : at + n])
        at += n + 2


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes | None, sha: bytes, size: int, refers_to: int | None, revisit: bool, unique: str, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page, or its segments; a revisit needs no payload, only its SHA-1 and size."""
    own = f"urn:page:{'' if page_id is None else page_id}:{unique}"
    shared = {"WARC_Target_URI": _clean(url), "WARC_Payload_Digest": f"sha1:{base64.b32encode(sha).decode()}", "Content_Type": "application/http; msgtype=response"}
    start = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: {size}\r\n".encode()
    if revisit:
        target = "" if refers_to is None else refers_to
        yield _record("revisit", own, start + b"\r\n", WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:page:{target}:>", **shared)
        return
    block = start + b"Transfer-Encoding: chunked\r\n\r\n" + to_chunks(payload)
    if len(block) <= segment_bytes:
        yield _record("response", own, block, **shared)
        return
    starts = range(0, len(block), segment_bytes)
    for k, i in enumerate(starts, 1):
        total = len(block) if k == len(starts) else None
        part = block[i : i + segment_bytes]
        if k == 1:
            yield _record("response", own, part, WARC_Segment_Number=1, **shared)
        else:
            yield _record("continuation", f"{own}:{k}", part, WARC_Segment_Origin_ID=f"<{own}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """All keys (page, sha) of payloads that are long enough, and those that revisit another page, with refers_to; no payload is shuffled."""
    t = text_or_empty(payload_col)
    ids = materialise(pages.filter(F.octet_length(t) >= min_bytes).select(F.col(id_col).cast("long").alias("page"), F.unhex(F.sha1(t.cast("binary"))).alias("sha")), "payloads")
    first = F.min(F.struct(F.col("page").isNull().alias("null_id"), "page"))
    groups = materialise(ids.groupBy("sha").agg(first.alias("f"), F.count("*").alias("n")).filter("n > 1").select("sha", F.col("f.page").alias("refers_to"), "n"), "payload-groups")
    both = join_groups(ids, groups.withColumn("again", F.lit(True)), "sha", "n", ids.count()).filter("again")
    return ids, both.filter(~F.col("page").eqNullSafe(F.col("refers_to"))).select("page", "sha", "refers_to").distinct()


def _key(page: str, sha: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(page), F.lit(-1)), F.col(page).isNull(), F.col(sha))


def _kinds(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload (null for revisits), own_sha, size, refers_to, revisit of every page.

    A Bloom filter of the revisits' keys says which pages surely are responses: their
    payloads stay where they are. Of the others those that surely are revisits
    leave their payloads behind; a second filter, of the few keys that passed the
    first by chance, finds the rest, which are joined as they are.
    """
    t = text_or_empty(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), t.cast("binary").alias("payload"), F.unhex(F.sha1(t.cast("binary"))).alias("own_sha"), F.octet_length(t).cast("long").alias("size"))
    keys, seen = revisits(pages, id_col, payload_col, min_bytes)
    seen = materialise(seen, "revisits")
    of_seen = bloom_filter(seen.select(_key("page", "sha").alias("h")), seen.count())
    on = F.col("page").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s"))
    chance = keys.filter(probed(keys, _key("page", "sha"), of_seen)).join(seen.select(F.col("page").alias("p"), F.col("sha").alias("s")), on, "left_anti")
    chance = materialise(chance.select(_key("page", "sha").alias("h")).distinct(), "not-revisits")
    if min_bytes:
        # payloads that are too short have no key; whether they pass the first filter is settled by the join
        chance = chance.unionByName(rows.filter(F.col("size") < min_bytes).select(_key("page_id", "own_sha").alias("h")))
    of_chance = bloom_filter(chance, chance.count())
    marked = rows.withColumn("maybe", probed(rows, _key("page_id", "own_sha"), of_seen)).withColumn("unsure", probed(rows, _key("page_id", "own_sha"), of_chance))
    names = ["page_id", "url", "payload", "own_sha", "size"]
    surely = marked.filter("not maybe").select(*names, F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    meets = F.col("page_id").eqNullSafe(F.col("page")) & (F.col("own_sha") == F.col("sha"))
    light = marked.filter("maybe and not unsure").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "own_sha", "size")
    again = light.join(seen.hint("merge"), meets).select(*names, "refers_to", F.lit(True).alias("revisit"))
    rest = marked.filter("maybe and unsure").select(*names).join(seen.hint("merge"), meets, "left").select(*names, "refers_to", F.col("sha").isNotNull().alias("revisit"))
    return surely.unionByName(again).unionByName(rest)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the archives; a row (path, records, bytes) for each file."""
    ship_package(pages.sparkSession)
    both = _kinds(pages, id_col, url_col, payload_col, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, row = task_number(), 0, 0
        made: list[tuple[str, int, int]] = []
        pending = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        page = next(pending, None)
        while page is not None:
            path, records, size = f"{folder}/part-{task:06d}-{number:04d}.warc.gz", 0, 0
            with whole_file(path) as out:
                while page is not None and size < FILE_BYTES:
                    for data in records_of(*page, f"{task}-{row}", segment_bytes):
                        out.write(gzip.compress(data, GZIP_LEVEL, mtime=0))
                        records, size = records + 1, size + len(data)
                    row += 1
                    page = next(pending, None)
            made.append((path, records, size))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    return materialise(both.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of any version; folded lines are joined."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record does not start where it should")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data[at : at + 2] == b"\r\n":
            at += 2


def _unpacked(data: bytes) -> bytes:
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def _page(identifier: str | None) -> int | None:
    """The page of an identifier that ``records_of`` made; null for any other."""
    found = re.match(r"urn:page:(-?\d+):", identifier or "")
    return int(found[1]) if found else None


def _opened(fields: dict[str, str], block: bytes, strict: bool = True) -> dict:
    """A whole record's row, with its payload decoded and checked."""
    own, target, kind = fields.get("warc-record-id", "").strip("<>"), fields.get("warc-refers-to"), fields["warc-type"]
    http, body = {}, block
    if kind in ("response", "revisit") and block[:5] == b"HTTP/":
        head, _, body = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    algorithm, _, stated = fields.get("warc-payload-digest", "").rpartition(":")
    length = http.get("x-payload-length", "")
    row = {"record_id": own, "page_id": _page(own), "url": fields.get("warc-target-uri", "").strip("<>"), "record_type": kind, "refers_to": None, "refers_to_id": None, "payload_digest": stated or None, "payload_bytes": int(length) if length.isdigit() else None, "payload": None, "digest_ok": None}
    if kind == "revisit":
        target = target.strip("<>") if target else None
        return row | {"refers_to": _page(target), "refers_to_id": target}
    whole = True
    try:
        payload = from_chunks(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    except (ValueError, IndexError):
        if strict:
            raise
        payload, whole = body, False
    found = digest(payload)
    known = bool(stated) and algorithm.lower() in ("", "sha1") and len(stated) == 32
    ok = (found == stated.upper() if known else None) if whole else False
    if strict and ok is False:
        raise ValueError(f"the payload of {own} fails its digest")
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": stated or found, "digest_ok": ok}


def reassemble(group: pd.DataFrame, strict: bool = True) -> pd.DataFrame:
    """The record whose segments these are."""
    group = group.drop_duplicates("segment").sort_values("segment")
    first, total = group.iloc[0], group["total_length"].iloc[-1]
    block = b"".join(group["payload"])
    wrong = None
    if group["segment"].tolist() != list(range(1, len(group) + 1)) or pd.isna(total):
        wrong = f"segments are missing from {first['origin_id']}"
    elif len(block) != total:
        wrong = f"the segments of {first['origin_id']} fail the total length"
    if wrong and strict:
        raise ValueError(wrong)
    own = first["record_id"] if first["segment"] == 1 else first["origin_id"]
    fields = {"warc-record-id": own, "warc-type": first["record_type"], "warc-target-uri": first["url"] or "", "warc-payload-digest": first["payload_digest"] or ""}
    row = _opened(fields, b"" if wrong else block, strict)
    if wrong:
        row |= {"payload": None, "payload_bytes": None, "digest_ok": False}
    return pd.DataFrame([row]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "digest_ok": "boolean"})


def _dealt(files: DataFrame) -> DataFrame:
    """A fixed number of parts: what the names of files weigh says nothing about the work."""
    n = files.count()
    return files.select("path").repartition(max(1, min(n, max(2 * files.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_READ)))))


def inventory(files: DataFrame) -> DataFrame:
    """path, record_type, records: how many records of each type the archives hold, also of those that ``read`` passes over."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                counts = Counter(fields.get("warc-type", "") for fields, _ in parse(_unpacked(read_bytes(path))))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["path", "record_type", "records"])

    return _dealt(files).mapInArrow(run, "path string, record_type string, records long")


def read(files: DataFrame, strict: bool = True) -> DataFrame:
    """Records of the archives that the column ``path`` names, segments put together."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for fields, block in parse(_unpacked(read_bytes(path))):
                    if fields.get("warc-type") not in KEPT:
                        continue
                    if "warc-segment-number" in fields:
                        own = fields.get("warc-record-id", "").strip("<>")
                        total = fields.get("warc-segment-total-length", "")
                        rows.append({"record_id": own, "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": fields.get("warc-payload-digest"), "payload": block, "origin_id": fields.get("warc-segment-origin-id", own).strip("<>"), "segment": int(fields["warc-segment-number"]), "total_length": int(total) if total.isdigit() else None})
                    else:
                        rows.append(_opened(fields, block, strict))
                    size += len(block)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    parts = _dealt(files).mapInArrow(run, PARTS)
    names = [c.split()[0] for c in RECORDS.split(", ")]
    whole = parts.filter("segment is null").select(*names)
    joined = parts.filter("segment is not null").groupBy("origin_id").applyInPandas(lambda group: reassemble(group, strict), RECORDS)
    return whole.unionByName(joined)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = [c.split() for c in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in columns], names=[c for c, _ in columns])


def round_trip(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from archives written and read back."""
    files = write(pages, folder or fresh_dir(pages.sparkSession, "warc"), **how)
    records = read(files)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
