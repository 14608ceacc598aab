"""Pages of long results by an index of files, so that a deep page costs what the first one costs.

Rows are sorted over all tasks and written in that order; the index has a row for each
file: its name, its rows, the rows before it and its first key. A page reads the files that its
rows lie in, and a cursor, the key of the last row seen, finds its file by the first keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.storage import shared_folder

FILE_ROWS = 100_000


def store(rows: DataFrame, order: list[str], folder: str, file_rows: int = FILE_ROWS) -> None:
    """Write rows in order of unique keys (text or numbers, none null) in files of at most so many rows, and the index of the files."""
    spark = rows.sparkSession
    made = f"{shared_folder(spark)}/cartulary/pages-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows).parquet(made)
    held = spark.read.schema(rows.schema).parquet(made)
    key = F.struct(*order)
    files = held.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    index = files.select(F.concat(F.lit(f"{made}/"), "file").alias("path"), "n", before.cast("long").alias("before"), "first.*")
    index.coalesce(1).write.mode("overwrite").parquet(folder)


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def page(spark: SparkSession, folder: str, schema, order: list[str], number: int, size: int) -> DataFrame:
    """Rows of a page, from 1, in order; only its files are read."""
    start, end = (number - 1) * size, number * size
    index = spark.read.parquet(folder)
    files = index.filter((F.col("before") < end) & (F.col("before") + F.col("n") > start)).orderBy("before").collect()  # as many as a page touches
    if not files:
        return _read(spark, [], schema)
    skip = start - files[0]["before"]
    return _read(spark, [f["path"] for f in files], schema).orderBy(*order).offset(skip).limit(size)


def _after(order: list[str], cursor: tuple) -> Column:
    """Keys beyond a cursor, in order of all their parts."""
    out = F.lit(False)
    for c, v in reversed(list(zip(order, cursor, strict=True))):
        out = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def following(spark: SparkSession, folder: str, schema, order: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """So many rows after a key (from the start without one), in order; reads from the key's own file on, no more files than hold them."""
    index = spark.read.parquet(folder)
    if cursor is None:
        start = 0
    else:
        at = index.filter(~_after(order, cursor)).agg(F.max("before")).first()[0]
        start = at or 0
    own = index.filter(F.col("before") >= start).orderBy("before")
    # the cursor's file may end at the cursor, so its rows don't count
    first = index.filter(F.col("before") == start).first()
    end = start + (first["n"] if first else 0) + size
    paths = [f["path"] for f in own.filter(F.col("before") < end).collect()]
    rows = _read(spark, paths, schema)
    return (rows if cursor is None else rows.filter(_after(order, cursor))).orderBy(*order).limit(size)
