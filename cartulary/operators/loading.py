"""Loading all index tables of archives at once: published columns by name, typed, folded into keyed state, and the ledger.

An archive counts as loaded when the ledger has it, and the ledger gets it only after every
table has taken its rows. A load that fails in between is run again from the start; rows
that are there already win again, so nothing doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import exprs as E
from cartulary.operators import index, state
from cartulary.schemas import COMPACT_DATES, DATE_COLUMNS, INDEX_SOURCES, TABLES
from cartulary.sources import archive
from cartulary.storage import alone, exists, written

LEDGER = "source_month string, archive_stamp string, sha256 string, row_counts string"
_WHERE = ("source_month", "archive_stamp")


def _typed(column: str, kind: str) -> Column:
    if kind == "double":
        return E.number(column)
    if column in COMPACT_DATES:
        return E.compact_date(column)
    if column.startswith("fecha") or column in DATE_COLUMNS:
        # a time of day stays with its date
        return F.coalesce(F.when(F.trim(F.col(column)).rlike(E.ISO), F.trim(F.col(column))), E.iso_date(column))
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def table_rows(rows: DataFrame, table: str) -> DataFrame:
    """path, row_pos and the columns of an index table from published rows; absent columns are null."""
    published, headers = INDEX_SOURCES[table]
    fields = [f.strip().split(" ") for f in TABLES[table].split(",")]
    own = {name: kind for name, kind in fields if name not in _WHERE}
    named = archive.named_columns(rows, published, {c: headers.get(c, (c.upper(),)) for c in own})
    return named.select("path", "row_pos", *[_typed(c, kind).alias(c) for c, kind in own.items()])


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Archives that are loaded."""
    path = f"{folder}/ledger"
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def load_archives(spark: SparkSession, archives: str, folder: str, force: bool = False, buckets: int = state.BUCKETS) -> DataFrame:
    """Load what the ledger lacks into every index table; the ledger's new rows (source_month, archive_stamp, sha256, row_counts as JSON).

    Archives are parsed once, whatever the number of tables; tables that nothing names are read over.
    """
    listed = archive.archive_list(spark, archives).select("path", F.col("period").alias("source_month"), F.col("stamp").alias("archive_stamp"))
    fresh = written(index.not_loaded(listed, ledger(spark, folder), force).join(archive.archive_sums(spark, archives).select("path", "sha256"), "path"), "fresh")
    paths = [r["path"] for r in fresh.select("path").collect()]  # one row per archive
    if not paths:
        return spark.createDataFrame([], LEDGER)
    new = alone(spark, lambda: _folded(spark, archives, folder, fresh, buckets), "ledger")
    new.write.mode("append").parquet(f"{folder}/ledger")
    return new


def _folded(spark: SparkSession, archives: str, folder: str, fresh: DataFrame, buckets: int) -> DataFrame:
    """Fold the archives of ``fresh`` into the index tables; their rows for the ledger."""
    known = [name for name, _ in INDEX_SOURCES.values()]
    rows = alone(spark, lambda: archive.read_archives(spark, archives).filter(F.col("table").isin(known)).join(F.broadcast(fresh.select("path", *_WHERE)), "path"), "published")
    there = {r["table"] for r in rows.select("table").distinct().collect()}  # the published tables at most
    counts = fresh.select(*_WHERE).withColumn("n", F.lit(0).cast("long")).withColumn("table", F.lit("")).limit(0)
    for table in [t for t, (published, _) in INDEX_SOURCES.items() if published in there]:
        typed = table_rows(rows, table).join(F.broadcast(fresh.select("path", *_WHERE)), "path")
        state.fold(spark, folder, table, typed.drop("path"), buckets)
        counts = counts.unionByName(typed.groupBy(*_WHERE).agg(F.count("*").alias("n")).withColumn("table", F.lit(table)))
    said = counts.groupBy(*_WHERE).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n"))))).alias("row_counts"))
    return fresh.join(said, [*_WHERE], "left").select(*_WHERE, "sha256", F.coalesce("row_counts", F.lit("{}")).alias("row_counts"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An index table as loaded; empty if nothing was."""
    held = state.read(spark, folder, name)
    if held is None:
        return spark.createDataFrame([], TABLES[name])
    return held.select(*[c.strip().split(" ")[0] for c in TABLES[name].split(",")])

