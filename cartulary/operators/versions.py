"""Captures of periods, recovery inventory, anchor entries, republication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.schemas import CANON_VERSION

MAX_ENTRIES = 100


def newest(archives: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Of each source and period the copy with the latest stamp, within bounds."""
    rows = archives
    if first:
        rows = rows.filter(F.col("period") >= first)
    if last:
        rows = rows.filter(F.col("period") <= last)
    w = W.partitionBy("source", "period").orderBy(F.desc("stamp"), F.desc("sha256"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def newest_pairs(archives: DataFrame) -> DataFrame:
    """source, period, from_stamp, to_stamp: the two latest copies of periods that have two."""
    w = W.partitionBy("source", "period").orderBy(F.desc("stamp"))
    rows = archives.select("source", "period", "stamp").distinct().withColumn("prior", F.lead("stamp").over(w)).withColumn("n", F.row_number().over(w))
    return rows.filter("n = 1 and prior is not null").select("source", "period", F.col("prior").alias("from_stamp"), F.col("stamp").alias("to_stamp"))


def versions_by_period(observations: DataFrame) -> DataFrame:
    """source, period, version (in order of first sight), sha256, first_seen: distinct contents of a period."""
    seen = observations.filter(F.col("status").isin("stored", "unchanged") & F.col("sha256").isNotNull()).groupBy("source", "period", "sha256").agg(F.min("observed_at").alias("first_seen"))
    w = W.partitionBy("source", "period").orderBy("first_seen", "sha256")
    return seen.withColumn("version", F.row_number().over(w))


def republications(observations: DataFrame) -> DataFrame:
    """source, day, periods, first_period, last_period, bytes: periods stored again on a day."""
    w = W.partitionBy("source", "period").orderBy("observed_at", "sha256")
    stored = observations.filter("status = 'stored'").withColumn("n", F.row_number().over(w)).filter("n > 1")
    return stored.groupBy("source", F.substring("observed_at", 1, 10).alias("day")).agg(F.count("*").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.sum("content_length").alias("bytes"))


def captures(archives: DataFrame, anchored: DataFrame, current: str = CANON_VERSION, grace_days: int = 2) -> DataFrame:
    """archives (source, period, stamp, sha256, root, canon_version) with after_close, stale_canon, anchored_root, anchor_matches (null if not anchored)."""
    a = anchored.select("period", F.col("id").alias("short"), "canon_version", F.col("root").alias("anchored_root")).distinct()
    rows = archives.withColumn("short", F.substring("sha256", 1, 12)).join(a, ["period", "short", "canon_version"], "left")
    return rows.select("source", "period", "stamp", "sha256", "root", "canon_version", E.after_close("period", "stamp", grace_days).alias("after_close"), (F.col("canon_version") != current).alias("stale_canon"), "anchored_root", (F.col("anchored_root") == F.col("root")).alias("anchor_matches"))


def recovery(caps: DataFrame, anchored: DataFrame, current: str = CANON_VERSION) -> DataFrame:
    """source, period, held, status, orphan_roots, served_day; only roots under the current rules count as orphans."""
    held = caps.groupBy("source", "period").agg(F.count("*").alias("held"), F.max("after_close").alias("late"), F.min("stamp").alias("first"))
    lost = anchored.filter(F.col("canon_version") == current).select("period", "root").distinct().join(caps.select("period", "root").distinct(), ["period", "root"], "left_anti").groupBy("period").agg(F.count("*").alias("orphan_roots"))
    out = held.join(lost, "period", "left").withColumn("orphan_roots", F.coalesce("orphan_roots", F.lit(0)).cast("long"))
    status = F.when(F.col("held") > 1, "diffable").when(F.col("orphan_roots") > 0, "priorAnchored").when(F.col("late"), "currentOnly").otherwise("neverRewritten")
    return out.select("source", "period", "held", status.alias("status"), "orphan_roots", F.to_date(E.stamp_time("first")).alias("served_day"))


def candidate(root: str, caps: DataFrame, anchored: DataFrame, period: str) -> str:
    """exactHistoricalVersion, copyOfHeldVersion or unattestedExternalCopy: what a root from elsewhere is."""
    held = caps.filter((F.col("period") == period) & (F.col("root") == root)).limit(1).count() > 0
    known = anchored.filter((F.col("period") == period) & (F.col("root") == root)).limit(1).count() > 0
    return "copyOfHeldVersion" if held else "exactHistoricalVersion" if known else "unattestedExternalCopy"


def _suffix(version: Column, mark: str) -> Column:
    n = F.regexp_extract(version, r"-(\d+)$", 1)
    return F.when(n == "1", "").otherwise(F.concat(F.lit(f"_{mark}"), n))


def of_source(anchored: DataFrame, ns: str | None, first: str = "cr") -> DataFrame:
    """Parsed entries of one publisher; those without a namespace are of the first one, whose keys had none."""
    return anchored.filter(F.coalesce("ns", F.lit(first)) == (ns or first))


def version_entries(caps: DataFrame, ns: str | None = None) -> DataFrame:
    """key, type, value: a root and a meta entry for each capture (with records)."""
    tail = F.concat(F.lit(f"{ns}_" if ns else ""), F.col("period"), F.lit("_"), F.substring("sha256", 1, 12), _suffix(F.col("canon_version"), "c"))
    meta = F.concat_ws("|", "canon_version", F.col("records").cast("string"), "sha256", "stamp")
    rows = F.array(F.struct(F.concat(F.lit("ver_"), tail).alias("key"), F.col("root").alias("value")), F.struct(F.concat(F.lit("vmeta_"), tail).alias("key"), meta.alias("value")))
    return caps.select(F.explode(rows).alias("e")).select("e.key", F.lit("string").alias("type"), "e.value")


def diff_entries(diffs: DataFrame, ns: str | None = None) -> DataFrame:
    """key, type, value of bundles: period, from_sha256, to_sha256, versions, digest, changes_sha256 and the five counts."""
    short = lambda c: F.substring(c, 1, 12)
    tail = F.concat(F.lit(f"{ns}_" if ns else ""), F.col("period"), F.lit("_"), short("from_sha256"), F.lit("_"), short("to_sha256"), _suffix(F.col("canon_version"), "c"), _suffix(F.col("bundle_version"), "b"))
    counts = F.concat_ws(",", *[F.col(c).cast("string") for c in ("added", "recorded_amendment", "silent_revision", "reformatted", "removed")])
    meta = F.concat_ws("|", "bundle_version", counts, "changes_sha256")
    rows = F.array(F.struct(F.concat(F.lit("diff_"), tail).alias("key"), F.col("digest").alias("value")), F.struct(F.concat(F.lit("dmeta_"), tail).alias("key"), meta.alias("value")))
    return diffs.select(F.explode(rows).alias("e")).select("e.key", F.lit("string").alias("type"), "e.value")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, type, value of landed anchor entries: JSON files that hold an array of entries each; values are kept as text."""
    return spark.read.schema("key string, type string, value string").option("multiLine", "true").option("recursiveFileLookup", "true").json(path).filter("key is not null")


def day_entries(day: str, snapshots: DataFrame, ns: str | None = None) -> DataFrame:
    """key, type, value: a root and a meta entry for each snapshot (period, root, canon_version, records, sha256) of a day, and the marker of the latest day."""
    prefix = f"{ns}_" if ns else ""
    tail = F.concat(F.lit(f"{prefix}{day}_"), F.col("period"))
    meta = F.concat_ws("|", "canon_version", F.col("records").cast("string"), "sha256")
    rows = F.array(F.struct(F.concat(F.lit("root_"), tail).alias("key"), F.col("root").alias("value")), F.struct(F.concat(F.lit("meta_"), tail).alias("key"), meta.alias("value")))
    latest = snapshots.sparkSession.createDataFrame([(f"latest_{ns}" if ns else "latest", day)], "key string, value string")
    return snapshots.select(F.explode(rows).alias("e")).select("e.key", "e.value").unionByName(latest).select("key", F.lit("string").alias("type"), "value")


def day_plan(entries: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """day entries with batch and place: a period's two entries stay together, and the latest marker ends the last batch."""
    marker = F.col("key").startswith("latest")
    per = (most - 1) // 2
    if per < 1:
        raise ValueError("a batch has to hold a period and the marker")
    period = F.when(~marker, F.substring_index("key", "_", -1))
    numbered = entries.withColumn("period", period).withColumn("n", F.dense_rank().over(W.orderBy(marker, "period")) - 1)
    last = numbered.filter(~marker).agg(F.coalesce(F.max("n"), F.lit(0)).alias("last"))  # one row
    batch = F.floor(F.when(marker, F.col("last")).otherwise(F.col("n")) / per).cast("long")
    out = numbered.crossJoin(F.broadcast(last)).withColumn("batch", batch)
    place = F.row_number().over(W.partitionBy("batch").orderBy(marker, "n", F.desc("key"))) - 1
    return out.select("batch", place.cast("long").alias("place"), "key", "type", "value")


def repeated_keys(entries: DataFrame) -> DataFrame:
    """key, times: keys that more than one entry has; a plan with any of them is an error."""
    return entries.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")


def checked(entries: DataFrame) -> DataFrame:
    """The entries, or an error that names a repeated key."""
    found = repeated_keys(entries).orderBy("key").first()
    if found:
        raise ValueError(f"{found['times']} entries have the key {found['key']}")
    return entries


def parse_days(entries: DataFrame) -> DataFrame:
    """ns, day, period, root, canon_version, records, sha256 from day entries; a lacking meta entry leaves nulls."""
    pattern = r"^root_(?:([a-z]{2})_)?([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]+)$"
    key = F.col("key")
    roots = entries.filter(key.rlike(pattern)).select(F.substring(key, 6, 10_000).alias("tail"), F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).alias("ns"), F.regexp_extract(key, pattern, 2).alias("day"), F.regexp_extract(key, pattern, 3).alias("period"), F.col("value").alias("root"))
    meta = F.split("value", r"\|")
    metas = entries.filter(key.startswith("meta_")).select(F.substring(key, 6, 10_000).alias("tail"), F.get(meta, F.lit(0)).alias("canon_version"), F.get(meta, F.lit(1)).try_cast("long").alias("records"), F.nullif(F.get(meta, F.lit(2)), F.lit("")).alias("sha256"))
    return roots.join(metas, "tail", "left").drop("tail")


def pair(archives: DataFrame, period: str, first: str | None = None, second: str | None = None) -> tuple[str, str]:
    """Stamps of the two copies to compare, the earlier one first: the named ones, or the two newest."""
    stamps = sorted(r["stamp"] for r in archives.filter(F.col("period") == period).select("stamp").distinct().collect())  # copies of one period
    named = [s for s in (first, second) if s]
    lacking = [s for s in named if s not in stamps]
    if lacking:
        raise ValueError(f"no copy of {period} has the stamp {lacking[0]}")
    chosen = sorted({*named, *[s for s in reversed(stamps) if s not in named][: 2 - len(named)]})
    if len(chosen) != 2:
        raise ValueError(f"{period} has no two different copies")
    return chosen[0], chosen[1]


def survey(observations: DataFrame) -> DataFrame:
    """source, periods, versions, observations, rewritten (periods with more than one version), bytes: totals of a publisher's archives."""
    by = versions_by_period(observations).groupBy("source", "period").agg(F.count("*").alias("versions"))
    held = by.groupBy("source").agg(F.count("*").alias("periods"), F.sum("versions").alias("versions"), F.count_if(F.col("versions") > 1).alias("rewritten"))
    seen = observations.groupBy("source").agg(F.count("*").alias("observations"), F.coalesce(F.sum(F.when(F.col("status") == "stored", F.col("content_length"))), F.lit(0)).alias("bytes"))
    return seen.join(held, "source", "left").select("source", F.coalesce("periods", F.lit(0)).alias("periods"), F.coalesce("versions", F.lit(0)).alias("versions"), "observations", F.coalesce("rewritten", F.lit(0)).alias("rewritten"), "bytes")


def plan(entries: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """entries with batch and place: transactions of at most so many entries, in order of key.

    Entries number a few per period, so they are numbered in one partition.
    """
    n = F.row_number().over(W.orderBy("key")) - 1
    return entries.withColumn("n", n).select(F.floor(F.col("n") / most).cast("long").alias("batch"), (F.col("n") % most).cast("long").alias("place"), "key", "type", "value")


def parse_versions(entries: DataFrame, family: str = "canon") -> DataFrame:
    """ns, period, id, canon, root, records, sha256, stamp from version entries; keys are split from the right."""
    pattern = r"^ver_(?:(.+)_)?([0-9]+)_([0-9a-f]+?)(?:_c([0-9]+))?$"
    key = F.col("key")
    part = lambda k: F.nullif(F.regexp_extract(key, pattern, k), F.lit(""))
    roots = entries.filter(key.rlike(pattern)).select(F.substring(key, 5, 10_000).alias("tail"), part(1).alias("ns"), part(2).alias("period"), part(3).alias("id"), F.coalesce(part(4), F.lit("1")).cast("int").alias("canon"), F.col("value").alias("root"))
    meta = F.split("value", r"\|")
    metas = entries.filter(key.startswith("vmeta_")).select(F.substring(key, 7, 10_000).alias("tail"), F.get(meta, F.lit(1)).try_cast("long").alias("records"), F.nullif(F.get(meta, F.lit(2)), F.lit("")).alias("sha256"), F.nullif(F.get(meta, F.lit(3)), F.lit("")).alias("stamp"))
    return roots.join(metas, "tail", "left").drop("tail")


def parse_diffs(entries: DataFrame) -> DataFrame:
    """ns, period, from_id, to_id, canon, bundle, digest, counts, changes_sha256 from bundle entries."""
    pattern = r"^diff_(?:(.+)_)?([0-9]+)_([0-9a-f]+?)_([0-9a-f]+?)(?:_c([0-9]+))?(?:_b([0-9]+))?$"
    key = F.col("key")
    part = lambda k: F.nullif(F.regexp_extract(key, pattern, k), F.lit(""))
    rows = entries.filter(key.rlike(pattern)).select(F.substring(key, 6, 10_000).alias("tail"), part(1).alias("ns"), part(2).alias("period"), part(3).alias("from_id"), part(4).alias("to_id"), F.coalesce(part(5), F.lit("1")).cast("int").alias("canon"), F.coalesce(part(6), F.lit("1")).cast("int").alias("bundle"), F.col("value").alias("digest"))
    meta = F.split("value", r"\|")
    numbers = F.transform(F.split(F.get(meta, F.lit(1)), ","), lambda x: x.try_cast("long"))
    good = (F.size(numbers) == 5) & ~F.exists(numbers, lambda x: x.isNull())
    metas = entries.filter(key.startswith("dmeta_")).select(F.substring(key, 7, 10_000).alias("tail"), F.when(good, numbers).alias("counts"), F.nullif(F.get(meta, F.lit(2)), F.lit("")).alias("changes_sha256"))
    return rows.join(metas, "tail", "left").drop("tail")
