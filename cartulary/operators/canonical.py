"""Canonical records: identity, byte and value hashes, schema fingerprints. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.exprs import canonical_number
from cartulary.operators import occurrences
from cartulary.schemas import CANON_VERSION, FIELD_MARK, PART_MARK, RECORD_MARK, TableDef
from cartulary.storage import written


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rows_of(df: DataFrame, table: str, position: str) -> DataFrame:
    """table, row_pos, header, cells: any DataFrame as a published table of texts."""
    names = [c for c in df.columns if c != position]
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])
    return df.select(F.lit(table).alias("table"), F.col(position).cast("long").alias("row_pos"), F.array(*map(F.lit, names)).alias("header"), cells.alias("cells"))


def encode(table: Column, id_: Column, pairs: Column, version: str = CANON_VERSION) -> Column:
    """The text that is hashed: version, table, id and the fields in order of their names."""
    body = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], F.lit(FIELD_MARK), p["v"])), RECORD_MARK)
    return F.concat(F.lit(version + PART_MARK), table, F.lit(PART_MARK), id_, F.lit(PART_MARK), body)


def schema_fingerprint(table: Column, header: Column, version: str = CANON_VERSION) -> Column:
    """16 hex digits of a table's ordered columns."""
    text = F.concat(F.lit(f"{version}{PART_MARK}schema{PART_MARK}"), table, F.lit(PART_MARK), F.array_join(header, RECORD_MARK))
    return F.substring(F.sha2(text, 256), 1, 16)


def _by_table(defs: dict[str, TableDef], part: str) -> Column:
    entries = [x for t, d in defs.items() for x in (F.lit(t), F.array(*map(F.lit, getattr(d, part))).cast("array<string>"))]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,array<string>>")


#: Columns of published rows; any others, such as an archive's path, tell copies apart and stay.
_ROW = ("table", "row_pos", "header", "cells")


def identified(rows: DataFrame, defs: dict[str, TableDef], version: str = CANON_VERSION) -> DataFrame:
    """rows with pairs, id and whether the id comes from the content.

    The key names a row if all its columns exist and not all are blank; the first
    row in file order keeps it. Other rows are named by their content and an
    occurrence number. Blank keys never meet in a window on the key. Rows are written
    once and then numbered; equal rows and repeated keys may be any share of a table
    (see ``occurrences``).
    """
    own = [c for c in rows.columns if c not in _ROW]
    keys = F.coalesce(F.try_element_at(_by_table(defs, "key"), F.col("table")), F.array().cast("array<string>"))
    usable = (F.size(keys) > 0) & F.forall(keys, lambda k: F.array_contains("header", k))
    cell = lambda k: F.coalesce(F.get(F.col("cells"), F.array_position("header", k).cast("int") - 1), F.lit(""))
    parts = F.transform(keys, lambda k: _trim(cell(k)))
    raw = F.when(usable & F.exists(parts, lambda p: p != ""), F.array_join(parts, "|"))
    # a header may repeat a name; cells beyond the header fall away, missing ones are empty
    pairs = F.transform(F.col("header"), lambda k, i: F.struct(k.alias("k"), F.coalesce(F.get(F.col("cells"), i), F.lit("")).alias("v")))
    base = rows.select(*own, "table", "row_pos", "header", pairs.alias("pairs"), raw.alias("key"))
    # rows without a key are spread by their content
    apart = F.when(F.col("key").isNull(), F.xxhash64("pairs"))
    base = written(base.withColumn("apart", apart), "identified")
    n = base.count()
    turned = occurrences.numbered(base, [*own, "table", "key", "apart"], "row_pos", "turn", n=n)
    keyed = turned.withColumn("duplicate_key", F.col("key").isNotNull() & (F.col("turn") > 1)).withColumn("content_addressed", F.col("key").isNull() | F.col("duplicate_key"))
    digest = F.substring(F.sha2(encode(F.col("table"), F.lit(""), F.col("pairs"), version), 256), 1, 32)
    named = keyed.withColumn("name", F.when(F.col("content_addressed"), digest).otherwise(F.col("key")))
    counted = occurrences.numbered(named, [*own, "table", "content_addressed", "name"], "row_pos", "n", n=n)
    id_ = F.when(F.col("content_addressed"), F.concat(F.lit("sha256:"), F.col("name"), F.lit("#"), (F.col("n") - 1).cast("string"))).otherwise(F.col("name"))
    return counted.select(*own, "table", "row_pos", "header", "pairs", id_.alias("id"), "content_addressed", "duplicate_key")


def records(rows: DataFrame, defs: dict[str, TableDef], version: str = CANON_VERSION) -> DataFrame:
    """table, id, byte_hash (fields as published), value_hash (without volatile fields, numbers in canonical form), fields, row_pos."""
    own = [c for c in rows.columns if c not in _ROW]
    volatile = F.coalesce(F.try_element_at(_by_table(defs, "volatile"), F.col("table")), F.array().cast("array<string>"))
    kept = F.filter("pairs", lambda p: ~F.array_contains(volatile, p["k"]))
    values = F.transform(kept, lambda p: F.struct(p["k"].alias("k"), F.coalesce(canonical_number(p["v"]), _trim(p["v"])).alias("v")))
    t, i = F.col("table"), F.col("id")
    return identified(rows, defs, version).select(*own, "table", "id", F.sha2(encode(t, i, F.col("pairs"), version), 256).alias("byte_hash"), F.sha2(encode(t, i, values, version), 256).alias("value_hash"), "content_addressed", "duplicate_key", "header", "pairs", "row_pos")


def table_measures(version: str = CANON_VERSION) -> list[Column]:
    """Aggregates of a table's records: rows, schema, content_addressed, duplicate_keys."""
    return [F.count("*").alias("rows"), F.first(schema_fingerprint(F.col("table"), F.col("header"), version)).alias("schema"), F.max("content_addressed").alias("content_addressed"), F.count_if("duplicate_key").alias("duplicate_keys")]


def table_stats(recs: DataFrame, version: str = CANON_VERSION) -> DataFrame:
    """table, rows, schema, content_addressed, duplicate_keys."""
    return recs.groupBy("table").agg(*table_measures(version))


def fields(recs: DataFrame) -> DataFrame:
    """table, id, values: a record's fields as a map; of a repeated name the last value."""
    names = F.transform("pairs", lambda p: p["k"])
    last = F.filter("pairs", lambda p, i: F.size("pairs") - F.array_position(F.reverse(names), p["k"]) == i)
    return recs.select("table", "id", F.map_from_entries(last).alias("values"))
