"""Session-level helpers: shared storage, shipped code, text as bytes, salted joins."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: a space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and the
    session runs on one machine (tests), a temporary folder is made and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cartulary.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cartulary-")
        spark.conf.set("cartulary.shared.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/cartulary/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage at a place that outlives any executor, so work above it is
    never repeated. Temporary tables stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts are long, so batches are small: bytes of an Arrow batch to Python, and rows that the Parquet reader decodes
#: at once. Larger buffers grow by doubling and leave heap and native memory of executors fragmented.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "524288", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def give_back_memory() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; for arrays of some hundred numbers much faster than a hash table."""
    out = np.sort(values)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless PYTHONPATH already leads them to it; keep batches small."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    root = Path(__file__).resolve().parents[2]
    if any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    if spark.conf.get("cartulary.shipped", None) == spark.sparkContext.applicationId:
        return
    target = Path(tempfile.mkdtemp(prefix="cartulary-code-")) / "cartulary.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "cartulary").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set("cartulary.shipped", spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text; empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def one_spaced(column: str = "text") -> Column:
    """The text with each run of white space as one space; empty for null."""
    return F.regexp_replace(text_or_empty(column), SPACE, " ")


def likely_first(turn: Column, rows: int, wanted: int) -> Column:
    """Whether a row's hex digest can be among the ``wanted`` least of so many rows, but for a negligible chance.

    Keeps tasks from each sending as many candidates as are wanted in all.
    """
    share = (1.5 * wanted + 100) / max(1, rows)
    return F.lit(True) if share >= 1 else F.substring(turn, 1, 8) < F.lit(f"{int(share * 16**8):08x}")


#: Groups at least this large, and of at least a thousandth of all rows, reach their rows by broadcast.
HOT_GROUP = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """rows left joined to groups on ``key``, however uneven the groups are.

    groups has one row per key, with the number of its rows in ``size``; n is the
    number of rows. Groups of max(HOT_GROUP, n / 1000) rows or more, a thousand
    at most, are broadcast; the others meet in a join whose keys are all small.
    groups is read twice, so it should be a written table.
    """
    least = max(HOT_GROUP, n // 1000)
    others = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) >= least).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in others])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    met = marked.filter("__hot is not null").select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in others])
    rest = marked.filter("__hot is null").select(*rows.columns).join(groups.filter(F.col(size) < least), key, "left")
    return met.unionByName(rest.select(*rows.columns, *others))
