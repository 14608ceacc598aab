"""Evidence bundles: ordered lines, digest, checks, writing and reading.

The digest of a bundle covers its lines one after another, so they pass through one
hash: partitions are sorted by all executors and stream through the driver, which
holds one of them at a time. Lines are written by
the executors as gzipped JSON lines, one file for each sorted partition.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import exprs as E
from cartulary.operators import canonical, differ, merkle, snapshots, versions
from cartulary.schemas import BUNDLE_VERSION, CANON_VERSION, CHANGE_KINDS
from cartulary.sources import archive
from cartulary.storage import written

#: What the digest covers, in this order.
DIGEST_FIELDS = ("bundle_version", "canon_version", "source", "period", "from_stamp", "from_sha256", "from_root", "to_stamp", "to_sha256", "to_root", "counts", "line_policy", "max_detail", "changes_sha256", "lines")
#: Fields of the first version, which had no line policy: every kind was written.
DIGEST_FIELDS_1 = tuple(f for f in DIGEST_FIELDS if f != "line_policy")
FIRST_VERSION = "cartulary-bundle-1"
#: A policy for open periods, which mostly grow: everything but plain additions.
REVISIONS_ONLY = tuple(k for k in CHANGE_KINDS if k != "added")


def serialize(line: dict) -> str:
    """A line's JSON: fixed order of keys, fields in order of name, absent sides null, a newline at the end."""
    out = {"kind": line["kind"], "table": line["table"], "id": line["id"], "beforeHash": line.get("before"), "afterHash": line.get("after")}
    for key, name in (("old", "before"), ("new", "after")):
        if line.get(key):
            out[name] = dict(sorted(line[key].items()))
    if line.get("fields") is not None:
        out["fields"] = line["fields"]
    if line.get("omitted"):
        out["valuesOmitted"] = True
    return json.dumps(out, ensure_ascii=False, separators=(",", ":")) + "\n"


#: Characters that JSON texts escape, the backslash first.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
ESCAPES |= {chr(n): f"\\u{n:04x}" for n in range(32) if chr(n) not in ESCAPES}


def json_text(text: Column) -> Column:
    """A string as JSON, null as null; texts without control characters need two replacements only."""
    plain = text
    for c in ("\\", '"'):
        plain = F.replace(plain, F.lit(c), F.lit(ESCAPES[c]))
    rest = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(to).alias("to")) for c, to in ESCAPES.items() if c not in '\\"'])
    odd = F.aggregate(rest, plain, lambda made, e: F.replace(made, e["c"], e["to"]))
    return F.coalesce(F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), odd).otherwise(plain), F.lit('"')), F.lit("null"))


def _object(pairs: Column) -> Column:
    """A map as a JSON object, keys in order; null for a null map."""
    entries = F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def line_text() -> Column:
    """What ``serialize`` gives, from columns of the same names, without leaving the JVM."""
    shown = lambda f: F.concat(F.lit('{"field":'), json_text(f["field"]), F.lit(',"before":'), json_text(f["before"]), F.lit(',"after":'), json_text(f["after"]), F.lit("}"))
    fields = F.concat(F.lit(',"fields":['), F.array_join(F.transform("fields", shown), ","), F.lit("]"))
    parts = [F.lit('{"kind":'), json_text(F.col("kind")), F.lit(',"table":'), json_text(F.col("table")), F.lit(',"id":'), json_text(F.col("id"))]
    for name in ("before", "after"):
        parts += [F.lit(f',"{name}Hash":'), F.coalesce(_object(F.col(name)), F.lit("null"))]
    for key, name in (("old", "before"), ("new", "after")):
        parts.append(F.when(F.size(key) > 0, F.concat(F.lit(f',"{name}":'), _object(F.col(key)))).otherwise(""))
    return F.concat(*parts, F.coalesce(fields, F.lit("")), F.when(F.col("omitted"), ',"valuesOmitted":true').otherwise(""), F.lit("}\n"))


def build(before: DataFrame, after: DataFrame, before_values: DataFrame, after_values: DataFrame, kinds: Iterable[str] = CHANGE_KINDS, max_detail: int | None = 200_000) -> DataFrame:
    """table, id, kind, line: the serialised lines; order them by (table, id) to write or hash them.

    Changes beyond ``max_detail`` have lines without values; with None every line has them.
    """
    # counted, cut by the budget and joined with values: the comparison runs once
    changes = written(differ.line_policy(differ.diff(before, after), tuple(kinds)), "changes")
    marked = differ.detail_budget(changes, max_detail)
    chosen = differ.detailed(marked.filter("detailed").drop("detailed"), before_values, after_values).withColumn("omitted", F.lit(False))
    bare = marked.filter("not detailed").select("kind", "table", "id", "before", "after", F.lit(None).cast("map<string,string>").alias("old"), F.lit(None).cast("map<string,string>").alias("new"), F.lit(None).cast(chosen.schema["fields"].dataType).alias("fields"), F.lit(True).alias("omitted"))
    # hashes are named as published
    side = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.lit("byteHash"), F.col(f"{c}.byte_hash"), F.lit("valueHash"), F.col(f"{c}.value_hash")))
    rows = chosen.unionByName(bare).select("kind", "table", "id", side("before").alias("before"), side("after").alias("after"), "old", "new", "fields", "omitted")

    return rows.select("table", "id", "kind", line_text().alias("line"))


def changes_digest(lines: DataFrame) -> tuple[str, int]:
    """SHA-256 of the lines in order, and their number; partitions stream through the driver one at a time."""
    total, n = hashlib.sha256(), 0
    for row in lines.orderBy("table", "id").select("line").toLocalIterator(prefetchPartitions=True):
        total.update(row["line"].encode())
        n += 1
    return total.hexdigest(), n


def digest(manifest: dict) -> str:
    """SHA-256 over the manifest's fields as a JSON array, by the rules of its version; the time of building isn't part of it."""
    fields = DIGEST_FIELDS_1 if manifest["bundle_version"] == FIRST_VERSION else DIGEST_FIELDS
    body = [manifest[f] for f in fields]
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def manifest(lines: DataFrame, counts: dict[str, int], source: str, period: str, before: dict, after: dict, kinds: Iterable[str] = CHANGE_KINDS, max_detail: int | None = 200_000, canon_version: str = "", bundle_version: str = BUNDLE_VERSION) -> dict:
    """The manifest of written lines; before and after have stamp, sha256 and root."""
    changes_sha, n = changes_digest(lines)
    out = {"bundle_version": bundle_version, "canon_version": canon_version, "source": source, "period": period, "counts": [counts.get(k, 0) for k in CHANGE_KINDS], "line_policy": list(kinds), "max_detail": max_detail, "changes_sha256": changes_sha, "lines": n}
    out |= {f"from_{k}": v for k, v in before.items()} | {f"to_{k}": v for k, v in after.items()}
    return out | {"digest": digest(out)}


def verify(m: dict, lines: DataFrame) -> list[tuple[str, bool, str]]:
    """Checks of a bundle: name, whether it holds, detail."""
    sha, n = changes_digest(lines)
    by = {r["kind"]: r["n"] for r in lines.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # five rows
    stated = dict(zip(CHANGE_KINDS, m["counts"], strict=True))
    kept = set(m["line_policy"])
    unique = lines.groupBy("table", "id").count().filter("count > 1").limit(1).count() == 0
    return [
        ("digest", digest(m) == m["digest"], m["digest"]),
        ("changes", sha == m["changes_sha256"], sha),
        ("lines", n == m["lines"], str(n)),
        ("counts", all(by.get(k, 0) == stated[k] for k in kept), json.dumps(by, sort_keys=True)),
        ("policy", set(by) <= kept, ",".join(sorted(kept))),
        ("arithmetic", m["lines"] == sum(stated[k] for k in kept), str(sum(stated.values()))),
        ("unique", unique, ""),
    ]


def parsed(json_lines: DataFrame) -> DataFrame:
    """Bundle lines (text in the column line) as columns."""
    pair = "struct<byteHash:string,valueHash:string>"
    schema = f"kind string, table string, id string, beforeHash {pair}, afterHash {pair}, before map<string,string>, after map<string,string>, fields array<struct<field:string,before:string,after:string>>, valuesOmitted boolean"
    return json_lines.select(F.from_json("line", schema).alias("l")).select("l.*")


def filtered(lines: DataFrame, kind: str | None = None, table: str | None = None, field: str | None = None, readable: bool = False, numeric: bool = False) -> DataFrame:
    """Parsed lines by kind, table, a field that changed, whether values are written and whether a field moved as a number."""
    out = lines
    if kind:
        out = out.filter(F.col("kind") == kind)
    if table:
        out = out.filter(F.col("table") == table)
    if field:
        out = out.filter(F.exists("fields", lambda f: f["field"] == field))
    if readable:
        out = out.filter(~F.coalesce("valuesOmitted", F.lit(False)))
    if numeric:
        out = out.filter(F.exists("fields", lambda f: E.movement(f["before"], f["after"]) == "numeric"))
    return out


def folder_of(root: str, source: str, period: str, from_stamp: str, to_stamp: str, canon_version: str, bundle_version: str = BUNDLE_VERSION) -> str:
    """Where a bundle is kept; the first bundle version adds no suffix."""
    tail = "" if bundle_version == FIRST_VERSION else f"-{bundle_version}"
    return f"{root}/{source}/{period}/{from_stamp}-{to_stamp}-{canon_version}{tail}"


def write(lines: DataFrame, m: dict, folder: str) -> None:
    """Write lines in order as gzipped text files, then manifest.json: a folder without one isn't a bundle."""
    spark = lines.sparkSession
    lines.repartitionByRange("table", "id").sortWithinPartitions("table", "id").select("line").withColumn("line", F.rtrim(F.col("line"), F.lit("\n"))).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/changes")
    spark.createDataFrame([(json.dumps(m, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")


def read(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """The manifest, and the lines (table, id, kind, line) of a written bundle."""
    m = json.loads(spark.read.text(f"{folder}/manifest.json").first()["value"])
    raw = spark.read.text(f"{folder}/changes").select(F.concat("value", F.lit("\n")).alias("line"))
    return m, raw.select(F.get_json_object("line", "$.table").alias("table"), F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.kind").alias("kind"), "line")


def verify_against(m: dict, lines: DataFrame, before: DataFrame, after: DataFrame, before_header: dict, after_header: dict) -> list[tuple[str, bool, str]]:
    """Checks of a bundle against both copies: their digests and roots, and whether the bundle built anew is the same.

    Copies are canonical records; headers have stamp, sha256 and root as computed from the archives at hand.
    """
    checks = [(f"{name} archive", h["sha256"] == m[f"{side}_sha256"], h["sha256"]) for name, side, h in (("earlier", "from", before_header), ("later", "to", after_header))]
    if not all(ok for _, ok, _ in checks):
        return checks
    checks += [(f"{name} root", h["root"] == m[f"{side}_root"], h["root"]) for name, side, h in (("earlier", "from", before_header), ("later", "to", after_header))]
    kinds = tuple(m["line_policy"])
    made = written(build(before, after, canonical.fields(before), canonical.fields(after), kinds, m["max_detail"]), "rebuilt")
    counts = {r["kind"]: r["changes"] for r in differ.kind_counts(differ.diff(before, after)).collect()}  # five rows
    again = manifest(made, counts, m["source"], m["period"], before_header, after_header, kinds, m["max_detail"], m["canon_version"], m["bundle_version"])
    published, _ = changes_digest(lines)
    return [
        *checks,
        ("rebuilt changes", again["changes_sha256"] == m["changes_sha256"], again["changes_sha256"]),
        ("rebuilt digest", again["digest"] == m["digest"], again["digest"]),
        ("published changes", published == again["changes_sha256"], published),
    ]


def verify_archives(spark: SparkSession, folder: str, archives: str) -> list[tuple[str, bool, str]]:
    """Checks of a written bundle by itself and against the two archives that it names, from their bytes.

    Archives are found by period and stamp under a folder. Their digests are taken from the files,
    their records and roots from parsing them; nothing that the bundle says is used but to compare.
    """
    m, lines = read(spark, folder)
    checks = verify(m, lines)
    listed = {r["stamp"]: r["path"] for r in archive.archive_list(spark, archives).filter(F.col("period") == m["period"]).collect()}  # copies of one period
    sides = {side: listed.get(m[f"{side}_stamp"]) for side in ("from", "to")}
    lacking = [(f"{name} archive", False, f"no archive {m['period']} {m[f'{side}_stamp']}") for name, side in (("earlier", "from"), ("later", "to")) if sides[side] is None]
    if lacking:
        return checks + lacking
    held, heads = _copies(spark, [sides["from"], sides["to"]], m["source"], [m["from_stamp"], m["to_stamp"]], m["canon_version"])
    return checks + verify_against(m, lines, *held, *heads)


def _copies(spark: SparkSession, paths: list[str], source: str, stamps: list[str], version: str) -> tuple[list[DataFrame], list[dict]]:
    """Records and headers (stamp, sha256, root) of archives, read and reduced in the same jobs."""
    made = written(snapshots.records_of(spark, paths, source, version), "records")
    sums = {r["path"]: r["sha256"] for r in archive.archive_sums(spark, paths).collect()}  # a row per archive
    roots = {r["path"]: r["root"] for r in merkle.roots(made, "path").collect()}
    held = [made.filter(F.col("path") == p).drop("path") for p in paths]
    return held, [{"stamp": s, "sha256": sums[p], "root": roots.get(p, merkle.EMPTY_ROOT)} for p, s in zip(paths, stamps, strict=True)]


def from_archives(spark: SparkSession, archives: str, source: str, period: str, out: str, first: str | None = None, second: str | None = None, kinds: Iterable[str] = CHANGE_KINDS, max_detail: int | None = 200_000) -> str:
    """Build and write the bundle of two copies of a period (the newest, or named ones) from their archives; its folder."""
    a, b = versions.pair(archive.archive_list(spark, archives), period, first, second)
    listed = {r["stamp"]: r["path"] for r in archive.archive_list(spark, archives).filter(F.col("period") == period).collect()}  # copies of one period
    held, heads = _copies(spark, [listed[a], listed[b]], source, [a, b], CANON_VERSION)
    one, two = held
    lines = written(build(one, two, canonical.fields(one), canonical.fields(two), kinds, max_detail), "lines")
    counts = {r["kind"]: r["changes"] for r in differ.kind_counts(differ.diff(one, two)).collect()}  # five rows
    m = manifest(lines, counts, source, period, *heads, kinds=kinds, max_detail=max_detail, canon_version=CANON_VERSION)
    folder = folder_of(out, source, period, a, b, CANON_VERSION)
    write(lines, m, folder)
    return folder


def summary_text(period: str, counts: dict[str, int], records: tuple[int, int], schema_changes: list[tuple[str, str | None, str | None]] = (), rules_differ: bool = False) -> str:
    """A comparison of two copies in words."""
    out = [f"period {period}", f"  records {records[0]:,} -> {records[1]:,}"]
    names = {"added": "added", "recordedAmendment": "recorded amendment", "silentRevision": "SILENT REVISION", "reformatted": "reformatted only", "removed": "removed"}
    out += [f"  {names[k]:<18} {counts.get(k, 0):,}" for k in CHANGE_KINDS]
    if schema_changes:
        out.append(f"  columns changed in {len(schema_changes)} tables:")
        out += [f"    {t}: {a or '(absent)'} -> {b or '(absent)'}" for t, a, b in schema_changes]
    if rules_differ:
        out.append("  the copies were made under different canonical rules; this comparison isn't sound")
    return "\n".join(out)
