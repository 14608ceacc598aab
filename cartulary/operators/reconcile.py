"""Comparing stored copies by digests of buckets, so that what is equal isn't read.

A copy is stored in buckets by the hash of (table, id), a folder each, beside a table
of digests: the number of records of each bucket and, in four lanes, the sums of
60-bit pieces of SHA-256 over each record's hashes. Sums don't depend on order and are added
when buckets are merged, so copies stored in different numbers of buckets (always
powers of two) meet in the smaller number. Only buckets whose digests differ are read; with a share p of
records changed and m records a bucket, that is 1 - (1 - p)^m of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import differ
from cartulary.schemas import CONTRACT_TABLE
from cartulary.storage import written

RECORD = "table string, id string, byte_hash string, value_hash string"
MOST_BUCKETS = 1 << 14
LANES = 4


def bucket(buckets: int) -> Column:
    """The bucket of a record; the number of buckets is a power of two."""
    return F.pmod(F.xxhash64("table", "id"), F.lit(buckets)).cast("int")


def bucket_count(records: int, wanted: int = 4096) -> int:
    """A power of two such that a bucket has about so many records, at most MOST_BUCKETS."""
    return min(MOST_BUCKETS, 1 << max(0, -(-records // wanted) - 1).bit_length())


def lanes() -> list[Column]:
    """Sums that tell sets of records apart, whatever their order."""
    sha = F.sha2(F.concat_ws("|", "table", "id", "byte_hash", "value_hash"), 256)
    return [F.sum(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"lane{k}") for k in range(LANES)]


def store(records: DataFrame, folder: str, buckets: int | None = None) -> int:
    """Store a copy (table, id, byte_hash, value_hash) in buckets under a folder of its own; the number of buckets.

    Digests come last: a copy without them isn't complete. A store that is run again replaces itself.
    """
    n = buckets or bucket_count(records.count())
    if n & (n - 1):
        raise ValueError("the number of buckets has to be a power of two")
    rows = records.select("table", "id", "byte_hash", "value_hash").withColumn("bucket", bucket(n))
    rows.repartition("bucket").sortWithinPartitions("bucket", "table", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/records")
    held = records.sparkSession.read.schema(f"{RECORD}, bucket int").parquet(f"{folder}/records")
    # numbers are held per (buckets) so that readers know how the copy is cut
    held.groupBy("bucket").agg(F.count("*").alias("records"), *lanes()).withColumn("buckets", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/digests")
    return n


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """bucket, records, lanes, buckets: a row for each bucket that isn't empty."""
    sums = ", ".join(f"lane{k} decimal(38,0)" for k in range(LANES))
    return spark.read.schema(f"bucket int, records long, {sums}, buckets int").parquet(f"{folder}/digests")


def _merged(found: DataFrame, buckets: int) -> DataFrame:
    sums = [F.sum(f"lane{k}").cast("decimal(38,0)").alias(f"lane{k}") for k in range(LANES)]
    return found.groupBy(F.pmod("bucket", F.lit(buckets)).cast("int").alias("bucket")).agg(F.sum("records").alias("records"), *sums)


def differing(spark: SparkSession, before: str, after: str) -> tuple[list[int], int]:
    """Buckets of two stored copies whose digests differ, and the number of buckets in which the copies meet."""
    one, two = digests(spark, before), digests(spark, after)
    sizes = [r[0] for d in (one, two) if (r := d.agg(F.min("buckets")).first())[0]]
    n = min(sizes, default=1)
    columns = ["records", *(f"lane{k}" for k in range(LANES))]
    a, b = _merged(one, n).alias("a"), _merged(two, n).alias("b")
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full_outer").filter(~same)
    # MOST_BUCKETS numbers at most
    return sorted(r[0] for r in met.select(F.coalesce("a.bucket", "b.bucket")).collect()), n


def read(spark: SparkSession, folder: str, chosen: list[int] | None = None, buckets: int = 1) -> DataFrame:
    """Records of a stored copy; with ``chosen`` only those buckets (modulo ``buckets``), as folders."""
    held = spark.read.schema(f"{RECORD}, bucket int").parquet(f"{folder}/records")
    if chosen is not None:
        held = held.filter(F.pmod("bucket", F.lit(buckets)).isin(chosen))
    return held.select("table", "id", "byte_hash", "value_hash")


def diff(spark: SparkSession, before: str, after: str, contract_table: str = CONTRACT_TABLE) -> DataFrame:
    """Changes between two stored copies as ``differ.diff`` gives them, from the buckets that differ.

    Whether an added contract amends one depends on contracts in other buckets; those are
    looked up by number, and only if there are added contracts.
    """
    chosen, n = differing(spark, before, after)
    a, b = read(spark, before, chosen, n), read(spark, after, chosen, n)
    made = written(differ.diff(a, b, contract_table), "changes")
    number = F.split("id", r"\|")[0]
    is_new = (F.col("table") == contract_table) & F.col("kind").isin("added", "recordedAmendment")
    fresh = made.filter(is_new).select(number.alias("number")).filter("number <> ''").distinct()
    if not fresh.head(1):
        return made
    known = read(spark, before).filter(F.col("table") == contract_table).select(number.alias("number")).join(fresh, "number", "left_semi").distinct().withColumn("amends", F.lit(True))
    marked = made.withColumn("number", F.when(is_new, number)).join(known, "number", "left")
    kind = F.when(is_new, F.when(F.col("amends"), "recordedAmendment").otherwise("added")).otherwise(F.col("kind"))
    return marked.select(kind.alias("kind"), "table", "id", "before", "after")
