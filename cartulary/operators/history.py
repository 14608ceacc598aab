"""What became of records over all copies of a period, each copy with its proof.

Versions are kept as validity intervals: copies in a row that hold a record with the same
hashes are one row, so a record that never changes is one row however many copies there
are, and no grid of records times copies is made. A record's own history, copy by
copy, with leaf and path to the copy's root, is made for the records that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.operators import merkle, occurrences
from cartulary.storage import written


def copies_of(records: DataFrame) -> DataFrame:
    """stamp, seq: the copies in order, one row each."""
    return records.select("stamp").distinct().withColumn("seq", F.row_number().over(W.orderBy("stamp")))


def intervals(records: DataFrame, copies: DataFrame) -> DataFrame:
    """table, id, byte_hash, value_hash, first_seq, last_seq of records (stamp, table, id and hashes) of several copies.

    A window holds a record's copies, and each row is read once.
    """
    rows = records.join(F.broadcast(copies), "stamp").select("table", "id", "byte_hash", "value_hash", "seq")
    w = W.partitionBy("table", "id").orderBy("seq")
    goes_on = (F.lag("byte_hash").over(w) == F.col("byte_hash")) & (F.lag("value_hash").over(w) == F.col("value_hash")) & (F.lag("seq").over(w) == F.col("seq") - 1)
    run = F.sum(F.when(goes_on, 0).otherwise(1)).over(w)
    return rows.withColumn("run", run).groupBy("table", "id", "run").agg(F.first("byte_hash").alias("byte_hash"), F.first("value_hash").alias("value_hash"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).drop("run")


def steps(held: DataFrame, wanted: DataFrame, copies: DataFrame) -> DataFrame:
    """table, id, stamp, byte_hash, value_hash, step of the wanted records in every copy; copies without one have null hashes."""
    grid = wanted.select("table", "id").distinct().crossJoin(F.broadcast(copies))  # a row per copy, for wanted records only
    inside = (F.col("seq") >= F.col("first_seq")) & (F.col("seq") <= F.col("last_seq"))
    mine = held.join(wanted.select("table", "id").distinct(), ["table", "id"], "left_semi").withColumnsRenamed({"table": "t", "id": "i"})
    met = grid.join(mine, (F.col("t") == F.col("table")) & (F.col("i") == F.col("id")) & inside, "left")
    w = W.partitionBy("table", "id").orderBy("seq")
    prior, prior_value = F.lag("byte_hash").over(w), F.lag("value_hash").over(w)
    rows = met.select("table", "id", "stamp", "seq", "byte_hash", "value_hash", prior.alias("pb"), prior_value.alias("pv"))
    gone = F.col("byte_hash").isNull()
    step = (
        F.when(F.col("seq") == 1, F.when(gone, "absent").otherwise("present"))
        .when(F.col("pb").isNull(), F.when(gone, "absent").otherwise("added"))
        .when(gone, "removed")
        .when(F.col("pb") == F.col("byte_hash"), "unchanged")
        .when(F.col("pv") == F.col("value_hash"), "reformatted")
        .otherwise("silentRevision")
    )
    return rows.select("table", "id", "stamp", "byte_hash", "value_hash", step.alias("step"))


def proven(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """table, id, stamp, byte_hash, value_hash, step, leaf_index, hash, steps, root, ok of the wanted records (table, id) in every copy.

    records have stamp, table, id and hashes. ``ok`` says whether the leaf made from
    the record itself leads to the copy's root; it is null where the copy lacks the record.
    A wanted record that no copy has is an error.
    """
    asked = written(wanted.select("table", "id").distinct(), "asked")
    copies = written(copies_of(records), "copies")
    # all other rows stay where they are
    mine = occurrences.likely(records, asked, ["table", "id"]).join(asked, ["table", "id"], "left_semi")
    rows = written(steps(intervals(mine, copies), asked, copies), "steps")
    absent = rows.groupBy("table", "id").agg(F.count("byte_hash").alias("n")).filter("n = 0").limit(5).collect()
    if absent or (asked.head(1) and not copies.head(1)):
        raise ValueError("in no copy: " + ", ".join(f"{r['table']} {r['id']}" for r in absent))
    numbered = merkle.leaves(records, "stamp")
    places = written(occurrences.likely(numbered, asked, ["table", "id"]).join(asked, ["table", "id"], "left_semi").select("stamp", "table", "id", "idx"), "places")
    paths = merkle.proofs(merkle.levels(numbered, "stamp"), "stamp", wanted=places.select("stamp", "idx"))
    # paths, which are long, meet the rows last
    own = rows.withColumn("hash", merkle.leaf(F.col("table"), F.col("id"), F.col("byte_hash"))).join(places, ["stamp", "table", "id"], "left")
    checked = merkle.verified(own.join(paths.select("stamp", "idx", "steps", "root"), ["stamp", "idx"], "left"))
    return checked.select("table", "id", "stamp", "byte_hash", "value_hash", "step", F.col("idx").alias("leaf_index"), "hash", "steps", "root", "ok")
