"""Differences between two canonical copies, down to the field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.schemas import CHANGE_KINDS, CONTRACT_TABLE, DETAIL_ORDER


def diff(before: DataFrame, after: DataFrame, contract_table: str = CONTRACT_TABLE) -> DataFrame:
    """kind, table, id, and the hashes of both sides of every record that changed.

    One full outer join on (table, id); new records of a contract that was there before are amendments.
    """
    a = before.select("table", "id", F.struct("byte_hash", "value_hash").alias("before"))
    b = after.select("table", "id", F.struct("byte_hash", "value_hash").alias("after"))
    both = a.join(b, ["table", "id"], "full_outer").filter(~F.col("before.byte_hash").eqNullSafe(F.col("after.byte_hash")))
    number = F.split("id", r"\|")[0]
    prior = before.filter(F.col("table") == contract_table).select(number.alias("number")).filter("number <> ''").distinct().withColumn("amends", F.lit(True))
    marked = both.withColumn("number", F.when((F.col("table") == contract_table) & F.col("before").isNull(), number)).join(prior, "number", "left")
    kind = (
        F.when(F.col("after").isNull(), "removed")
        .when(F.col("before").isNull(), F.when(F.col("amends"), "recordedAmendment").otherwise("added"))
        .when(F.col("before.value_hash") == F.col("after.value_hash"), "reformatted")
        .otherwise("silentRevision")
    )
    return marked.select(kind.alias("kind"), "table", "id", "before", "after")


def kind_counts(changes: DataFrame) -> DataFrame:
    """kind, changes: every kind, with 0 for those that don't occur."""
    kinds = changes.sparkSession.createDataFrame([(k,) for k in CHANGE_KINDS], "kind string")
    return kinds.join(changes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("changes"))


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """table and both fingerprints where they differ; stats have table and schema."""
    a, b = before.select("table", F.col("schema").alias("before")), after.select("table", F.col("schema").alias("after"))
    return a.join(b, "table", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def field_diff(before: Column, after: Column) -> Column:
    """Fields of two maps that differ, in order of name; a missing field is null, an empty one is not."""
    empty = F.create_map().cast("map<string,string>")
    zipped = F.map_zip_with(F.coalesce(before, empty), F.coalesce(after, empty), lambda _, b, a: F.struct(b.alias("before"), a.alias("after")))
    changed = F.filter(F.map_entries(zipped), lambda e: ~e["value"]["before"].eqNullSafe(e["value"]["after"]))
    return F.array_sort(F.transform(changed, lambda e: F.struct(e["key"].alias("field"), e["value"]["before"].alias("before"), e["value"]["after"].alias("after"))))


def detailed(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """changes with the values of both sides (maps) and the fields that differ; sides have table, id, values."""
    b = before.select("table", "id", F.col("values").alias("old"))
    a = after.select("table", "id", F.col("values").alias("new"))
    joined = changes.join(b, ["table", "id"], "left").join(a, ["table", "id"], "left")
    revised = F.col("kind").isin("silentRevision", "reformatted")
    return joined.select("kind", "table", "id", "before", "after", F.when(F.col("kind") == "removed", F.col("old")).alias("old"), F.when(F.col("kind").isin("added", "recordedAmendment"), F.col("new")).alias("new"), F.when(revised, field_diff(F.col("old"), F.col("new"))).alias("fields"))


def field_changes(details: DataFrame) -> DataFrame:
    """table, id, kind, field, before, after, movement, direction: a row for each field that changed."""
    rows = details.select("kind", "table", "id", F.explode("fields").alias("f"))
    out = rows.select("kind", "table", "id", F.col("f.field").alias("field"), F.col("f.before").alias("before"), F.col("f.after").alias("after"))
    return out.withColumn("movement", E.movement("before", "after")).withColumn("direction", E.direction("before", "after"))


def field_summary(rows: DataFrame) -> DataFrame:
    """Per table and field: changes and how values moved."""
    def of(column: str, value: str) -> Column:
        return F.count_if(F.coalesce(F.col(column) == value, F.lit(False))).alias(value)

    return rows.groupBy("table", "field").agg(F.count("*").alias("changes"), *[of("movement", m) for m in ("numeric", "reprint", "filled", "cleared", "text")], *[of("direction", d) for d in ("up", "down")])


def table_summary(lines: DataFrame) -> DataFrame:
    """Per table: changes, and how many of each kind."""
    return lines.groupBy("table").agg(F.count("*").alias("changes"), *[F.count_if(F.col("kind") == k).alias(k) for k in CHANGE_KINDS])


def line_policy(changes: DataFrame, kinds: Sequence[str] = CHANGE_KINDS) -> DataFrame:
    """Changes of the kinds that a bundle lists."""
    unknown = set(kinds) - set(CHANGE_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return changes.filter(F.col("kind").isin(*kinds))


def detail_budget(changes: DataFrame, most: int | None = 200_000) -> DataFrame:
    """changes with the column detailed: whether values are written, by kind first and then by (table, id).

    Kinds that fit as a whole need only their counts; rows are numbered just within
    the one kind that the budget cuts. Without a budget (None) all values are written.
    """
    if most is None:
        return changes.withColumn("detailed", F.lit(True))
    if most < 0:
        raise ValueError("the budget can't be negative")
    counts = {r["kind"]: r["n"] for r in changes.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # five rows
    left, whole, cut = most, [], None
    for kind in DETAIL_ORDER:
        n = counts.get(kind, 0)
        if n <= left:
            whole.append(kind)
            left -= n
        elif cut is None:
            cut = kind
            break
    fits = changes.filter(F.col("kind").isin(*whole)).withColumn("detailed", F.lit(True))
    out = changes.filter(~F.col("kind").isin(*whole, cut or "")).withColumn("detailed", F.lit(False))
    if cut is None:
        return fits.unionByName(out)
    edge = changes.filter(F.col("kind") == cut)
    first = edge.select("table", "id").orderBy("table", "id").limit(left).withColumn("detailed", F.lit(True))
    part = edge.join(first, ["table", "id"], "left").withColumn("detailed", F.coalesce("detailed", F.lit(False)))
    return fits.unionByName(out).unionByName(part.select(*changes.columns, "detailed"))


def transitions(versions: DataFrame) -> DataFrame:
    """versions (table, id, stamp, byte_hash, value_hash) with the kind of step from the copy before.

    Every copy of a record's history is a row; copies without the record are absent rows (null hashes).
    """
    w = W.partitionBy("table", "id").orderBy("stamp")
    prior_b, prior_v = F.lag("byte_hash").over(w), F.lag("value_hash").over(w)
    first = F.row_number().over(w) == 1
    rows = versions.select("*", first.alias("first"), prior_b.alias("pb"), prior_v.alias("pv"))
    step = (
        F.when(F.col("first"), F.when(F.col("byte_hash").isNull(), "absent").otherwise("present"))
        .when(F.col("pb").isNull() & F.col("byte_hash").isNull(), "absent")
        .when(F.col("pb").isNull(), "added")
        .when(F.col("byte_hash").isNull(), "removed")
        .when(F.col("pb") == F.col("byte_hash"), "unchanged")
        .when(F.col("pv") == F.col("value_hash"), "reformatted")
        .otherwise("silentRevision")
    )
    return rows.select("table", "id", "stamp", "byte_hash", "value_hash", step.alias("step"))


def versions_of(copies: dict[str, DataFrame]) -> DataFrame:
    """Records of several copies (by stamp) with a row for every record and copy, absent ones with null hashes."""
    parts = [df.select("table", "id", F.lit(stamp).alias("stamp"), "byte_hash", "value_hash") for stamp, df in sorted(copies.items())]
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    stamps = F.array(*map(F.lit, sorted(copies)))
    grid = seen.select("table", "id").distinct().select("table", "id", F.explode(stamps).alias("stamp"))
    return grid.join(seen, ["table", "id", "stamp"], "left")
