"""Numbers of rows within their key, also where a key holds most of the rows.

Keys with few rows are numbered by a window. The rows of a hot key are sorted over
as many tasks as they fill; each task counts its rows of a key, the sums of the tasks before
it give its first number, and rows are numbered inside the task. Hot keys have HOT rows or
more and a thousandth of all, so there are a thousand at most and they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.storage import written

#: Bits of the filter of ``likely``, in rows of 2^15 (8 MiB in all).
FILTER_BITS = 1 << 26
HOT = 100_000


def numbered(rows: DataFrame, keys: list[str], order: str, to: str, hot: int = HOT, n: int | None = None) -> DataFrame:
    """rows with ``to``: 1, 2, ... in order of one column among the rows of equal keys (nulls are equal)."""
    window = F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long")
    total = rows.count() if n is None else n
    if total < hot:
        # no key can have that many
        return rows.withColumn(to, window)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__rows")).filter(F.col("__rows") >= max(hot, total // 1000))
    large = written(sizes.select(*[F.col(k).alias(f"__{k}") for k in keys]), "hot-keys")
    if not large.head(1):
        return rows.withColumn(to, window)
    meet = F.lit(True)
    for k in keys:
        meet &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    few = rows.join(F.broadcast(large), meet, "left_anti").withColumn(to, window)
    many = rows.join(F.broadcast(large), meet, "left_semi")
    return few.unionByName(spread(many, keys, order, to))


def spread(rows: DataFrame, keys: list[str], order: str, to: str) -> DataFrame:
    """The numbers by counts of tasks and their sums, for keys of any size."""
    ordered = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    placed = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    own = [*keys, "__part"]
    counts = placed.groupBy(*keys, part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a key has a row for each task that it fills
    starts = counts.select(*[F.col(c).alias(f"{c}_s") for c in own], before.alias("__before"), "__first")
    meet = F.lit(True)
    for c in own:
        meet &= F.col(c).eqNullSafe(F.col(f"{c}_s"))
    met = placed.withColumn("__part", part).join(starts, meet)
    return met.withColumn(to, (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long")).select(*rows.columns, to)


def likely(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are among those asked for, and a few others: a semi join after it has little to shuffle.

    A bitmap of the asked keys' hashes is broadcast; its size doesn't depend on how many there are. No asked row is missed.
    """
    at = lambda: F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1
    bits = asked.select(at().alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits"))
    met = rows.withColumn("__at", at()).withColumn("__bucket", F.bitmap_bucket_number("__at")).withColumn("__bit", F.bitmap_bit_position("__at").cast("int")).join(F.broadcast(bits), "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit / 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.filter(F.getbit(byte, F.col("__bit") % 8) == 1).select(*rows.columns)
