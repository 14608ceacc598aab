"""An index table as keyed state in buckets: a batch rewrites the buckets that it touches and no others.

Rows lie in buckets by the hash of their key. A batch reads the buckets of its own keys,
folds its rows in and writes those buckets under a name of its own; then a small file that
says where each bucket is takes effect under the next name. Readers see the state
before the batch or after it, never a part. Of each key the row wins that is first in
a total order (month, stamp, place in the archive, content), so neither the way rows
are dealt into files, nor batches, nor a batch that is run again changes the result.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators.index import latest_wins
from cartulary.schemas import COALESCED_KEYS, INDEX_KEYS
from cartulary.storage import freed, get_text, names_in, passing, put_text, remove, written

BUCKETS = 64
ORDER = ("source_month", "archive_stamp", "row_pos")


def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(buckets)).cast("int")


def current(spark: SparkSession, folder: str, table: str) -> dict:
    """Where each bucket is: schema, buckets, batch and place by bucket; empty before the first batch."""
    names = [n for n in names_in(spark, f"{folder}/{table}/states") if n.endswith(".json")]
    return json.loads(get_text(spark, f"{folder}/{table}/states/{max(names)}")) if names else {}


def _rows(spark: SparkSession, folder: str, table: str, at: dict, chosen: list[int] | None = None) -> DataFrame | None:
    places = sorted({place for b, place in at.get("places", {}).items() if chosen is None or int(b) in chosen})
    if not places:
        return None
    base = f"{folder}/{table}/data"
    kept = [[int(b), place] for b, place in at["places"].items() if chosen is None or int(b) in chosen]
    # an earlier batch's folder also holds buckets that a later one has replaced
    valid = spark.createDataFrame(kept, "bucket int, place string")
    held = spark.read.option("basePath", base).schema(f"{at['schema']}, place string, bucket int").parquet(*[f"{base}/place={p}" for p in places])
    return held.join(F.broadcast(valid), ["bucket", "place"], "left_semi").drop("bucket", "place")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The state's rows without their place in archives; None before the first batch."""
    held = _rows(spark, folder, table, current(spark, folder, table))
    return None if held is None else held.drop("row_pos")


def fold(spark: SparkSession, folder: str, table: str, rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Fold rows (the table's columns with source_month, archive_stamp and, if known, row_pos) into the state; the buckets that were rewritten."""
    keys, at = INDEX_KEYS[table], current(spark, folder, table)
    if "row_pos" not in rows.columns:
        rows = rows.withColumn("row_pos", F.lit(None).cast("long"))
    n = at.get("buckets", buckets)
    bucket = _bucket(keys, n)
    made = latest_wins(rows, keys, table in COALESCED_KEYS, ORDER)
    place = uuid.uuid4().hex
    target = f"{folder}/{table}/data/place={place}"
    with passing(spark), freed(spark):
        if at.get("places"):
            fresh = written(made.withColumn("bucket", bucket), "batch")
            touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most as many as there are buckets
            if not touched:
                return []
            held = _rows(spark, folder, table, at, touched)
            both = fresh.drop("bucket") if held is None else fresh.drop("bucket").unionByName(held, allowMissingColumns=True)
            made = latest_wins(both, keys, table in COALESCED_KEYS, ORDER)
        # a bucket has as many files as it fills, so no task sorts a whole one
        made.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(target)
    touched = sorted(int(name.removeprefix("bucket=")) for name in names_in(spark, target) if name.startswith("bucket="))
    if not touched:
        remove(spark, target)
        return []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    places = {**at.get("places", {}), **{str(b): place for b in touched}}
    number = at.get("number", 0) + 1
    said = {"number": number, "buckets": n, "schema": schema, "places": places}
    put_text(spark, f"{folder}/{table}/states/{number:012d}-{time.time_ns()}.json", json.dumps(said))
    return touched


def tidy(spark: SparkSession, folder: str, table: str) -> int:
    """Delete the places that no bucket is at any more, when no reader is left; how many there were."""
    live = set(current(spark, folder, table).get("places", {}).values())
    gone = [n for n in names_in(spark, f"{folder}/{table}/data") if n.startswith("place=") and n.removeprefix("place=") not in live]
    for name in gone:
        remove(spark, f"{folder}/{table}/data/{name}")
    return len(gone)
