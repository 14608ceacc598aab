"""Tables written to the folder that all machines share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, on one machine (tests), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cartulary.folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cartulary-")
        spark.conf.set("cartulary.folder", folder)
    return folder.rstrip("/")


#: Spark's setting for deleting an execution's shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written in the innermost ``passing``; None outside of any.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within are deleted when each ends; else they stay until the driver collects garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes within are removed at the end: nothing that is used later may read them."""
    noted: list[str] = []
    token = _noted.set(noted)
    try:
        yield
    finally:
        _noted.reset(token)
        for path in noted:
            remove(spark, path)


def _write(df: DataFrame, what: str, options: dict[str, int]) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cartulary/{what}-{uuid.uuid4().hex}"
    with freed(spark):
        # digests in hex shrink by half under zstd and not at all under snappy
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def _note(path: str) -> None:
    noted = _noted.get()
    if noted is not None:
        noted.append(path)


def written(df: DataFrame, what: str, options: dict[str, int] | None = None) -> DataFrame:
    """df from a Parquet table that it was written to; options are the writer's."""
    path, made = _write(df, what, options or {})
    _note(path)
    return made


def alone(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What make() gives, from a table that it was written to; the tables that were written on the way are removed."""
    with passing(spark):
        path, made = _write(make(), what, {})
    _note(path)
    return made


def together(spark: SparkSession, makes: Iterable[Callable[[], DataFrame]], what: str, by: str | None = None) -> tuple[str, DataFrame]:
    """Folder and rows of a table to which what each of these gives is added, one after the other; ``by`` is a column to part it by.

    Only one of them has its shuffle files and tables on the way on disk at a time.
    """
    path = f"{shared_folder(spark)}/cartulary/{what}-{uuid.uuid4().hex}"
    _note(path)
    schema = None
    for make in makes:
        with passing(spark), freed(spark):
            df = make()
            schema = schema or df.schema
            made = df.write.mode("append").option("compression", "zstd")
            (made.partitionBy(by) if by else made).parquet(path)
    return path, spark.read.schema(schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    where, fs = _hadoop(spark, path)
    return bool(fs.exists(where))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    where, fs = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def replace(spark: SparkSession, made: str, target: str) -> None:
    """Put a finished folder in the place of another.

    Never a part is seen, but between two renames there is nothing under the name; ``settle`` puts the
    old folder back after a crash there. Tables that are read while they are replaced belong in ``operators.state``.
    """
    settle(spark, target)
    new, fs = _hadoop(spark, made)
    old, _ = _hadoop(spark, target)
    before, _ = _hadoop(spark, f"{target}{BEFORE}{uuid.uuid4().hex}")
    if fs.exists(old):
        fs.rename(old, before)
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        settle(spark, target)
        raise OSError(f"{made} can't be moved to {target}")
    fs.delete(before, True)


#: Between a folder's name and a number, while another takes its place.
BEFORE = ".before-"


def settle(spark: SparkSession, target: str) -> None:
    """After a replacement that was broken off: the old folder back under its name, or out of the way if the new one is there."""
    folder, name = target.rstrip("/").rpartition("/")[::2]
    for left in names_in(spark, folder):
        if left.startswith(f"{name}{BEFORE}"):
            if exists(spark, target):
                remove(spark, f"{folder}/{left}")
            else:
                where, fs = _hadoop(spark, f"{folder}/{left}")
                fs.rename(where, _hadoop(spark, target)[0])


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears under its name only when it is whole; there must be none yet."""
    made, fs = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    target, _ = _hadoop(spark, path)
    fs.mkdirs(target.getParent())
    out = fs.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(made, target):
        raise OSError(f"{path} can't be written")


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where, fs = _hadoop(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    where, fs = _hadoop(spark, path)
    fs.delete(where, True)
