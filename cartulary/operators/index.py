"""The longitudinal index: latest-wins fold of all months, ledger, entity resolution, coverage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.functions.names import initials_joined, normalised_name
from cartulary.schemas import COALESCED_KEYS, INDEX_KEYS, TABLES
from cartulary.sources.archive import table_or_empty
from cartulary.storage import replace, settle


#: Columns that say where a row comes from or in which order it was loaded.
_NOT_CONTENT = {"load_seq", "row_pos", "sha256", "archive_stamp", "source_month"}


def latest_wins(rows: DataFrame, keys: tuple[str, ...], coalesce: bool = False, order: tuple[str, ...] = ("source_month", "load_seq", "row_pos")) -> DataFrame:
    """Of each key the row of the newest month; of equal months the one loaded last.

    Rows without a whole key are left out; with coalesce, missing parts count as the
    empty string. Rows that agree in all of ``order`` are told apart by their content, so the
    winner doesn't depend on how rows are dealt out. The limit to the first row works
    within each task before the shuffle.
    """
    parts = [F.coalesce(F.col(k), F.lit("")) if coalesce else F.col(k) for k in keys]
    usable = rows if coalesce else rows.filter(_all(E.filled(k) for k in keys))
    content = F.xxhash64(*sorted(c for c in rows.columns if c not in _NOT_CONTENT))
    w = W.partitionBy(*parts).orderBy(*[F.col(c).desc_nulls_last() for c in order], content)
    return usable.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def load(rows: DataFrame, table: str) -> DataFrame:
    """latest_wins with a table's own key."""
    return latest_wins(rows, INDEX_KEYS[table], table in COALESCED_KEYS)


def load_counts(rows: DataFrame, table: str) -> DataFrame:
    """One row: rows read, without a key, and held after folding."""
    keys = INDEX_KEYS[table]
    bad = F.lit(False) if table in COALESCED_KEYS else ~_all(E.filled(k) for k in keys)
    read = rows.agg(F.count("*").alias("rows_read"), F.count_if(bad).alias("no_key"))
    return read.crossJoin(F.broadcast(load(rows, table).agg(F.count("*").alias("held"))))  # one row each


def not_loaded(archives: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Archives that the ledger doesn't have yet; all of them when forced."""
    return archives if force else archives.join(ledger.select("source_month", "archive_stamp"), ["source_month", "archive_stamp"], "left_anti")


def load_range(current: DataFrame | None, rows: DataFrame, table: str, ledger: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index table after loading archives that the ledger lacks, and the ledger's new rows.

    rows are a table's rows of several archives (with source_month, archive_stamp,
    sha256, row_pos); archives load in order of month and stamp, so a later copy of
    a month wins over an earlier one, and rows that are held lose only to rows of
    the same month or a newer one.
    """
    archives = rows.select("source_month", "archive_stamp", "sha256").distinct()
    new = not_loaded(archives, ledger, force)
    fresh = rows.join(new.select("source_month", "archive_stamp"), ["source_month", "archive_stamp"], "left_semi")
    # stamps sort as text, so their order is the order of loading
    ranked = fresh.withColumn("load_seq", F.col("archive_stamp"))
    if current is not None:
        held = current.withColumn("load_seq", F.lit("")).withColumn("row_pos", F.lit(-1).cast("long"))
        ranked = ranked.unionByName(held, allowMissingColumns=True)
    out = latest_wins(ranked, INDEX_KEYS[table], table in COALESCED_KEYS).drop("load_seq", "row_pos")
    counts = fresh.groupBy("source_month", "archive_stamp").agg(F.count("*").alias("n"))
    entries = new.join(counts, ["source_month", "archive_stamp"], "left").select("source_month", "archive_stamp", "sha256", F.lit(table).alias("table"), F.coalesce("n", F.lit(0)).alias("rows"))
    return out.drop("sha256"), entries


def save(spark: SparkSession, folder: str, table: str, rows: DataFrame) -> None:
    """Put a new state of an index table in the place of the old one: whole or not at all."""
    made = f"{folder}/.{table}-{uuid.uuid4().hex}"
    rows.write.parquet(made)
    replace(spark, made, f"{folder}/{table}")


def ask(spark: SparkSession, folder: str, sql: str, args: dict | None = None) -> DataFrame:
    """SQL with named parameters over the saved index; tables that aren't there are empty."""
    for name, schema in TABLES.items():
        settle(spark, f"{folder}/{name}")
        table_or_empty(spark, f"{folder}/{name}", schema).createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


def spans(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, rows, dated, first_day, last_day for tables given with their date column."""
    out = None
    for name, (df, column) in sorted(tables.items()):
        day = E.iso_date(column)
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.count(day).alias("dated"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
        out = one if out is None else out.unionByName(one)
    return out


def month_gaps(rows: DataFrame, column: str = "source_month") -> DataFrame:
    """month: months between the first and the last that have no rows."""
    have = rows.filter(E.filled(column)).select(F.col(column).alias("month")).distinct()
    ends = have.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = ends.select(F.explode(F.sequence(F.to_date(F.concat("a", F.lit("01")), "yyyyMMdd"), F.to_date(F.concat("b", F.lit("01")), "yyyyMMdd"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyyMM").alias("month"))
    return every.join(have, "month", "left_anti")


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...], *keys: str) -> DataFrame:
    """keys, share, value: the value at place floor((n - 1) * share) in order; it is a value that occurs."""
    # windows run over distinct values, with the number of rows up to each
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("here"))
    upto = F.sum("here").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    n = F.sum("here").over(W.partitionBy(*keys))
    ranked = counted.select(*keys, value, "here", upto.alias("upto"), n.alias("n")).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    at = F.floor((F.col("n") - 1) * F.col("share"))
    return ranked.filter((F.col("upto") > at) & (F.col("upto") - F.col("here") <= at)).select(*keys, "share", F.col(value).alias("value"))


def cross_month(tender: DataFrame, contract: DataFrame) -> DataFrame:
    """One row: tender-contract links, those whose rows come from different months, their share."""
    t = tender.select("nro_sicop", F.col("source_month").alias("tender_month"))
    both = contract.select("nro_sicop", F.col("source_month").alias("contract_month")).join(t, "nro_sicop")
    n = both.agg(F.count("*").alias("links"), F.count_if(F.col("tender_month") != F.col("contract_month")).alias("crossing"))
    return n.withColumn("share", E.ratio("crossing", "links"))


def lagged_stages(stage_dates: DataFrame) -> DataFrame:
    """One row: stage rows, and those whose month is after that of their publication."""
    month = F.regexp_replace(F.substring(E.iso_date("publicacion"), 1, 7), "-", "")
    return stage_dates.agg(F.count("*").alias("rows"), F.count_if(F.col("source_month") > month).alias("lagged"))


def stitched_durations(tender: DataFrame, contract: DataFrame) -> DataFrame:
    """nro_sicop, nro_contrato, days, same_month: publication to first contract notice."""
    t = tender.select("nro_sicop", E.iso_date("fecha_publicacion").alias("published"), F.col("source_month").alias("tender_month"))
    c = contract.select("nro_sicop", "nro_contrato", "secuencia", E.iso_date("fecha_notificacion").alias("noticed"), "source_month")
    both = c.join(t, "nro_sicop").withColumn("days", E.days_between("published", "noticed"))
    return both.select("nro_sicop", "nro_contrato", "secuencia", "days", (F.col("tender_month") == F.col("source_month")).alias("same_month"))


# Entity resolution


def actors(bid: DataFrame, award: DataFrame, contract: DataFrame, appeal: DataFrame, sanction: DataFrame, supplier: DataFrame) -> DataFrame:
    """cedula, nombre: everyone who appears as a supplier anywhere."""
    seen = None
    for df in (bid, award, contract, appeal, sanction, supplier):
        one = df.filter(E.filled("cedula_proveedor")).select(F.trim("cedula_proveedor").alias("cedula"))
        seen = one if seen is None else seen.union(one)
    names = supplier.groupBy(F.trim("cedula_proveedor").alias("cedula")).agg(F.max("nombre").alias("nombre"))
    return seen.distinct().join(names, "cedula", "left")


def with_names(people: DataFrame) -> DataFrame:
    """people with norm_name (comparable name), serial and legal form of company ids."""
    spread = people.withColumn("flat", normalised_name("nombre"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(norm_name=b["flat"].map(initials_joined))[["cedula", "nombre", "norm_name"]]

    named = spread.select("cedula", "nombre", "flat").mapInPandas(work, "cedula string, nombre string, norm_name string")
    company = F.col("cedula").rlike(r"^3\d{9}$")
    return named.withColumn("serial", F.when(company, F.substring("cedula", 5, 6))).withColumn("legal_form", F.when(company, F.substring("cedula", 2, 3)))


def supplier_groups(named: DataFrame) -> DataFrame:
    """norm_name, serial, members (sorted), group_id, group_name: companies with equal names and serials."""
    rows = named.filter(F.col("serial").isNotNull() & (F.length("norm_name") >= 3))
    by = rows.groupBy("norm_name", "serial").agg(F.array_sort(F.collect_set("cedula")).alias("members"), F.max(F.struct(F.length("nombre").alias("l"), "nombre")).alias("best"))
    return by.filter(F.size("members") >= 2).select("norm_name", "serial", "members", F.concat(F.lit("group:"), F.get("members", F.lit(0))).alias("group_id"), F.col("best.nombre").alias("group_name"))


def rejected_names(named: DataFrame) -> DataFrame:
    """norm_name, serials, reason: equal names whose serials differ aren't merged."""
    rows = named.filter(F.col("serial").isNotNull() & (F.length("norm_name") >= 3))
    return rows.groupBy("norm_name").agg(F.countDistinct("serial").alias("serials")).filter("serials > 1").withColumn("reason", F.lit("name-shared-serials-differ"))


def serial_collisions(named: DataFrame) -> DataFrame:
    """serial, names: one serial under several names."""
    return named.filter("serial is not null").groupBy("serial").agg(F.countDistinct("norm_name").alias("names")).filter("names > 1")


def resolve(named: DataFrame, bid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity and entity_member: groups, everyone else alone, and consortia beside them."""
    groups = supplier_groups(named)
    member = groups.select(F.col("group_id").alias("entity_id"), F.explode("members").alias("cedula_proveedor"), F.lit("member").alias("role"))
    alone = named.select("cedula", "nombre").join(member.select(F.col("cedula_proveedor").alias("cedula")), "cedula", "left_anti")
    selfs = alone.select(F.concat(F.lit("supplier:"), F.col("cedula")).alias("entity_id"), F.col("cedula").alias("cedula_proveedor"), F.lit("self").alias("role"))
    consortia = consortium_members(bid)
    joint = consortia.select(F.concat(F.lit("consorcio:"), F.col("id_consorcio")).alias("entity_id"), "cedula_proveedor", F.lit("consortium_member").alias("role"))
    by_group = groups.select(F.col("group_id").alias("entity_id"), F.col("group_name").alias("canonical_name"), F.lit("group").alias("kind"), F.size("members").alias("member_count"), F.to_json(F.struct("norm_name", "serial", "members")).alias("evidence"))
    by_self = alone.select(F.concat(F.lit("supplier:"), F.col("cedula")).alias("entity_id"), F.coalesce("nombre", "cedula").alias("canonical_name"), F.lit("supplier").alias("kind"), F.lit(1).alias("member_count"), F.lit("{}").alias("evidence"))
    by_joint = consortia.groupBy("id_consorcio").agg(F.countDistinct("cedula_proveedor").cast("int").alias("member_count")).select(F.concat(F.lit("consorcio:"), F.col("id_consorcio")).alias("entity_id"), F.col("id_consorcio").alias("canonical_name"), F.lit("consortium").alias("kind"), "member_count", F.lit("{}").alias("evidence"))
    return by_group.unionByName(by_self).unionByName(by_joint), member.unionByName(selfs).unionByName(joint)


def consortium_members(bid: DataFrame) -> DataFrame:
    """id_consorcio, cedula_proveedor, bids."""
    return bid.filter(E.filled("id_consorcio") & E.filled("cedula_proveedor")).groupBy("id_consorcio", "cedula_proveedor").agg(F.count("*").alias("bids"))


def owning_entity(entity: DataFrame, member: DataFrame) -> DataFrame:
    """cedula_proveedor, entity_id, canonical_name: the one entity, not a consortium, that stands for a supplier."""
    return member.join(entity.filter("kind <> 'consortium'").select("entity_id", "canonical_name"), "entity_id").select("cedula_proveedor", "entity_id", "canonical_name")
