"""Watching for new copies with Structured Streaming: file source, available-now trigger, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from cartulary.functions import exprs as E
from cartulary.operators import differ, state
from cartulary.schemas import CHANGE_KINDS, DETAIL_ORDER
from cartulary.storage import freed

RECORD = "source string, period string, stamp string, table string, id string, byte_hash string, value_hash string"


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Landed record files as a stream."""
    return spark.readStream.schema(RECORD).parquet(folder)


def watch(spark: SparkSession, folder: str, copies_folder: str, feed: str, checkpoint: str, on_diff: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Process what has landed since the last run: compare each new copy with the newest before it.

    The first copy of a period is its baseline. Changes go to ``feed`` as Parquet,
    copies to ``copies_folder`` partitioned by period and stamp; both are written per
    batch under the batch's own name, so a batch that is run again replaces itself.
    Late copies are findings, not late data: nothing is dropped.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        with freed(session):
            compared(session, rows)

    def compared(session: SparkSession, rows: DataFrame) -> None:
        # the landed files are read again for each use: held in memory they would spill to every disk
        copies = rows.select("source", "period", "stamp").distinct().orderBy("period", "stamp").collect()  # one row per copy
        for c in copies:
            mine = rows.filter((F.col("source") == c["source"]) & (F.col("period") == c["period"]) & (F.col("stamp") == c["stamp"]))
            prior = _newest_before(session, copies_folder, c["source"], c["period"], c["stamp"])
            where = f"source={c['source']}/period={c['period']}/stamp={c['stamp']}"
            mine.drop("source", "period", "stamp").write.mode("overwrite").option("compression", "zstd").parquet(f"{copies_folder}/{where}")
            if prior is not None:
                made = differ.diff(prior, mine).withColumn("period", F.lit(c["period"])).withColumn("detected", F.lit(c["stamp"]))
                made.write.mode("overwrite").option("compression", "zstd").parquet(f"{feed}/{where}")
                if on_diff:
                    # copies were compared once: what follows reads the changes that were written
                    on_diff(session.read.schema(made.schema).parquet(f"{feed}/{where}"))

    return snapshots(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Changes that a report lists; its counts cover all of them.
MOST_LISTED = 200


def reporter(spark: SparkSession, folder: str, source: str, grace_days: int = 2, limit: int = MOST_LISTED, bundles: str | None = None) -> Callable[[DataFrame], None]:
    """A function for watch's on_diff that writes each comparison as a watch report: JSON, one file, named by the copy's stamp.

    A report counts every change by kind and lists the first ``limit`` in the order in which kinds
    matter, then by table and id; the limit works in each task before the rows meet. With
    ``bundles`` the comparison is written there whole, a line for each change, and the report says where.
    """

    def report(changes: DataFrame) -> None:
        rank = F.array_position(F.array(*map(F.lit, DETAIL_ORDER)), F.col("kind"))
        order = Window.partitionBy("period", "detected").orderBy(rank, "table", "id")
        first = changes.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
        one = F.struct("n", "kind", "table", "id", F.col("before.byte_hash").alias("beforeHash"), F.col("after.byte_hash").alias("afterHash"))
        listed = first.groupBy("period", "detected").agg(F.array_sort(F.collect_list(one)).alias("l"))
        kinds = [F.count_if(F.col("kind") == k).cast("long").alias(k) for k in CHANGE_KINDS]
        counts = changes.groupBy("period", "detected").agg(F.count("*").alias("total"), *kinds)
        where = F.lit(None).cast("string")
        if bundles:
            for c in changes.select("period", "detected").distinct().collect():  # one row per copy
                target = f"{bundles}/{source}/{c['period']}/{c['detected']}"
                mine = changes.filter((F.col("period") == c["period"]) & (F.col("detected") == c["detected"]))
                mine.select("kind", "table", "id", "before", "after").repartitionByRange("table", "id").sortWithinPartitions("table", "id").write.mode("overwrite").json(target)
            where = F.concat_ws("/", F.lit(bundles), F.lit(source), "period", "detected")
        closed = E.after_close("period", "detected", grace_days)
        shown = F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "table", "id", "beforeHash", "afterHash")]))
        finding = F.struct(F.col("period").alias("month"), closed.alias("closed_month"), F.struct(*CHANGE_KINDS).alias("counts"), (F.col("total") > limit).alias("truncated"), where.alias("bundle"), shown.alias("changes"))
        made = counts.join(listed, ["period", "detected"]).select(F.col("detected").alias("ran_at"), F.lit(source).alias("source"), F.array(finding).alias("findings"))
        made.coalesce(1).write.mode("append").json(folder)

    return report


def fold(spark: SparkSession, landed: str, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keep an index table current from landed rows (the table's columns with source_month, archive_stamp and row_pos).

    Each batch rewrites the buckets of its keys only (see ``state``). Rows that tie in month and
    stamp go by their place in the archive, then by content, so neither the files in which rows
    land nor a batch that is run again change the result.
    """

    def batch(rows: DataFrame, _: int) -> None:
        state.fold(rows.sparkSession, folder, table, rows)

    schema = spark.read.parquet(landed).schema
    return spark.readStream.schema(schema).parquet(landed).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest_before(spark: SparkSession, held: str, source: str, period: str, stamp: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{held}/source={source}/period={period}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    stamps = sorted(s for f in fs.listStatus(folder) if (s := f.getPath().getName().removeprefix("stamp=")) < stamp)
    return spark.read.parquet(f"{held}/source={source}/period={period}/stamp={stamps[-1]}") if stamps else None


def activity(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Event counts and sums per window and type, on a batch or (with a watermark) a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
