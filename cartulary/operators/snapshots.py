"""Snapshots: archives to canonical records and Merkle roots, stored and read again.

Snapshots are stored in two Parquet tables of a folder, each in parts by source,
period, stamp and canonical rules: ``records`` in order of (table, id), and
``headers``, a row for each, so that a root is known without reading records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import canonical, merkle
from cartulary.schemas import CANON_VERSION, source
from cartulary.sources import archive
from cartulary.storage import exists, names_in, written

RECORD = "table string, id string, byte_hash string, value_hash string"
HEADER = "canon_version string, source string, period string, stamp string, archive_sha256 string, root string, records long, tables array<struct<table:string,rows:long,schema:string,content_addressed:boolean,duplicate_keys:long>>"


def records_of(spark: SparkSession, path: str | list[str], source_id: str, version: str = CANON_VERSION) -> DataFrame:
    """Canonical records of all archives under a path or several, each with the path of its archive."""
    return canonical.records(archive.read_archives(spark, path), source(source_id).tables, version)


def headers_of(spark: SparkSession, path: str, records: DataFrame, source_id: str, version: str = CANON_VERSION) -> DataFrame:
    """A header for each archive whose records these are; archives without a record have the root of the empty tree."""
    listed = archive.archive_list(spark, path).select("path", "period", "stamp").join(archive.archive_sums(spark, path).select("path", F.col("sha256").alias("archive_sha256")), "path")
    tables = records.groupBy("path", "table").agg(*canonical.table_measures(version))
    by_archive = tables.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("table", "rows", "schema", "content_addressed", "duplicate_keys"))).alias("tables"))
    both = listed.join(merkle.roots(records, "path"), "path", "left").join(by_archive, "path", "left")
    root, n = F.coalesce("root", F.lit(merkle.EMPTY_ROOT)), F.coalesce("records", F.lit(0)).cast("long")
    return both.select("path", F.lit(version).alias("canon_version"), F.lit(source_id).alias("source"), "period", "stamp", "archive_sha256", root.alias("root"), n.alias("records"), "tables")


def _place(source_id: str, period: str, stamp: str) -> str:
    return f"source={source_id}/period={period}/stamp={stamp}"


def store(folder: str, records: DataFrame, headers: DataFrame) -> None:
    """Write the snapshots of archives (records and headers as above), all archives in two jobs.

    A snapshot's own folders are replaced as a whole, so a store that is run again, also after a failure between the
    two jobs, leaves each record once; other snapshots aren't touched.
    """
    keys = ["source", "period", "stamp", "canon"]
    head = headers.withColumn("canon", F.col("canon_version"))
    own = head.select("path", *keys)
    rows = records.select("path", "table", "id", "byte_hash", "value_hash").join(own, "path").drop("path")
    ordered = rows.repartitionByRange(*keys, "table", "id").sortWithinPartitions(*keys, "table", "id")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{folder}/records")
    # headers come last: a snapshot without one isn't complete; folder names read back as numbers, so the texts stay in the rows
    said = {f"header_{c}": F.col(c) for c in ("source", "period", "stamp")}
    head.drop("path").withColumns(said).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{folder}/headers")


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of all stored snapshots; records aren't read."""
    if not exists(spark, f"{folder}/headers"):
        return spark.createDataFrame([], HEADER)
    found = spark.read.option("basePath", f"{folder}/headers").parquet(f"{folder}/headers")
    texts = [F.col(f"header_{c}").alias(c) for c in ("source", "period", "stamp")]
    return found.select("canon_version", *texts, "archive_sha256", "root", "records", "tables")


def stored(spark: SparkSession, folder: str, source_id: str, period: str, stamp: str, current: str = CANON_VERSION) -> list[str]:
    """Rules under which a copy is stored: the current ones first, then others, newest first."""
    base = f"{folder}/headers/{_place(source_id, period, stamp)}"
    found = sorted((n.removeprefix("canon=") for n in names_in(spark, base) if n.startswith("canon=")), reverse=True)
    return sorted(found, key=lambda v: v != current)


def read(spark: SparkSession, folder: str, source_id: str, period: str, stamp: str, version: str = CANON_VERSION) -> DataFrame:
    """Records of one stored snapshot; only its folder is read."""
    return spark.read.schema(RECORD).parquet(f"{folder}/records/{_place(source_id, period, stamp)}/canon={version}")


def load_or_build(spark: SparkSession, folder: str, archives: str, source_id: str, period: str, stamp: str, version: str = CANON_VERSION) -> DataFrame:
    """Records of a copy under the given rules: read if stored, else built from its archive, stored and read."""
    if version not in stored(spark, folder, source_id, period, stamp, version):
        found = [r["path"] for r in archive.archive_list(spark, archives).filter((F.col("period") == period) & (F.col("stamp") == stamp)).collect()]  # one copy
        if not found:
            raise ValueError(f"no archive of {source_id} {period} {stamp}")
        made = written(records_of(spark, found[0], source_id, version), "records")
        store(folder, made, headers_of(spark, found[0], made, source_id, version))
    return read(spark, folder, source_id, period, stamp, version)


def rules_differ(before: DataFrame, after: DataFrame) -> bool:
    """Whether two headers (one row each) come from different canonical rules, so that their records can't be compared."""
    return before.first()["canon_version"] != after.first()["canon_version"]


def proof_documents(headers_: DataFrame, records: DataFrame, wanted: DataFrame, anchored: DataFrame) -> DataFrame:
    """A proof document (JSON) for each wanted record (path, table, id).

    Records and headers are those of archives, as above. A record's path leads to
    its archive's root; the earliest day on which that root was anchored for the
    period (anchored has day, period, root) is attached, null if there is none.
    """
    numbered = written(merkle.leaves(records, "path"), "numbered")
    picked = written(numbered.join(wanted.select("path", "table", "id").distinct(), ["path", "table", "id"]), "picked")
    # blocks are reduced only for trees that hold a wanted record, and paths are made only for wanted leaves
    trees = written(numbered.join(picked.select("path").distinct(), "path", "left_semi"), "trees")
    steps = merkle.proofs(merkle.levels(trees, "path"), "path", wanted=picked.select("path", "idx"))
    first = anchored.groupBy("period", "root").agg(F.min("day").alias("anchored_day"))
    rows = picked.join(steps.select("path", "idx", "steps"), ["path", "idx"]).join(headers_, "path").join(records.select("path", "table", "id", "byte_hash"), ["path", "table", "id"]).join(first, ["period", "root"], "left")
    body = F.struct("period", "anchored_day", "table", "id", "byte_hash", F.col("idx").alias("leaf_index"), F.col("records").alias("leaf_count"), "root", "archive_sha256", "canon_version", "stamp", F.col("steps").alias("proof"))
    return rows.select("period", "stamp", "table", "id", "anchored_day", F.col("idx").alias("leaf_index"), F.size("steps").alias("steps"), F.to_json(body).alias("document"), "hash", F.col("steps").alias("path_up"), "root")
