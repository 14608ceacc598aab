"""What a task holds and what stays on disk, where tables are large."""

from __future__ import annotations

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cartulary import storage
from cartulary.operators import delivery, history, merkle, occurrences, state
from cartulary.plans import catalog
from cartulary.sources import archive, chunks
from cartulary.streaming import watch

ROWS = "period string, stamp string, table string, row_pos long, header array<string>, cells array<string>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def here(spark) -> set[str]:
    """Tables in the shared folder."""
    return set(glob.glob(f"{storage.shared_folder(spark).removeprefix('file://')}/cartulary/*"))


def test_archives_stream_through_their_tasks(spark, tmp_path, monkeypatch):
    """Rows of an archive arrive in many batches, some of them with two tables or two archives, and no group is held whole."""
    made = []
    monkeypatch.setattr(archive, "written", lambda df, what, *more: made.append(plan(df)) or storage.written(df, what, *more))
    rows = [(p, f"{p}28T120000Z", t, n, ["ID", "X"], [str(n), f'"{n};\n{t}é']) for p in ("202401", "202402", "202403") for t in ("Carteles", "Lineas") for n in range(250)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        said = archive.write_archives(spark.createDataFrame(rows, ROWS).orderBy(F.rand(1)), f"file://{tmp_path}/m").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in made[0] and "InPandas" not in made[0]
    back = archive.read_archives(spark, f"file://{tmp_path}/m").select("path", "table", "row_pos", "cells").collect()
    assert sorted((r["path"].split("/")[-2], r["table"], r["row_pos"], r["cells"]) for r in back) == sorted((p, t, n, c) for p, _, t, n, _, c in rows)
    # names carry digests of the bytes, and nothing half written is left
    sums = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in archive.archive_sums(spark, f"file://{tmp_path}/m").collect()}
    assert sums == {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in said} and all(s[:12] in n for n, s in sums.items())
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/m/*/*")) == sorted(sums)


def test_stored_chunks_are_read_a_few_at_a_time(spark):
    """Row groups hold some 16 MiB of chunks; else a hundred chunks of 4 MiB are in memory before their sizes are looked at."""
    rows = spark.range(40, numPartitions=1).select(F.lit("p").alias("path"), F.lit(0).alias("entry"), F.col("id").cast("int").alias("chunk"), F.lit("t").alias("table"), F.lit(";").alias("sep"), F.array(F.lit("a")).alias("header"), F.expr("cast(array_join(transform(sequence(1, 16384), i -> sha2(cast(id * 16384 + i as string), 256)), '') as binary)").alias("content"))
    before = here(spark)
    storage.written(rows, "chunks", chunks.STORED)
    found = pq.ParquetFile(glob.glob(f"{next(iter(here(spark) - before))}/*.parquet")[0]).metadata
    assert found.num_rows == 40 and max(found.row_group(k).num_rows for k in range(found.num_row_groups)) <= 20


def test_tables_on_the_way_are_removed(spark):
    before = here(spark)

    def make():
        one = storage.written(spark.range(10), "one")
        two = storage.alone(spark, lambda: storage.written(one.filter("id > 2"), "inner").select("id"), "two")
        return one.join(two, "id")

    made = storage.alone(spark, make, "whole")
    assert sorted(r["id"] for r in made.collect()) == list(range(3, 10))
    assert [os.path.basename(f).rsplit("-", 1)[0] for f in here(spark) - before] == ["whole"]
    assert spark.conf.get(storage.FREED, "false") == "false"


def test_first_batch_of_a_state_is_written_once(spark, tmp_path):
    """Buckets come from one pass, nothing is left beside them, and an empty batch leaves no place."""
    before, folder = here(spark), f"file://{tmp_path}/s"
    rows = spark.range(300).select((F.col("id") % 100).cast("string").alias("nro_sicop"), F.lit("1").alias("nro_oferta"), F.lit("1").alias("nro_linea"), F.lit("202401").alias("source_month"), F.lit("1").alias("archive_stamp"), F.col("id").alias("row_pos"))
    assert state.fold(spark, folder, "bid_line", rows.limit(0), 4) == [] and state.read(spark, folder, "bid_line") is None
    assert state.fold(spark, folder, "bid_line", rows, 4) == [0, 1, 2, 3]
    assert state.fold(spark, folder, "bid_line", rows.withColumn("source_month", F.lit("202402")).filter("nro_sicop = '7'"), 4) != []
    assert sorted((int(r["nro_sicop"]), r["source_month"]) for r in state.read(spark, folder, "bid_line").collect()) == [(n, "202402" if n == 7 else "202401") for n in range(100)]
    assert not here(spark) - before


def test_filter_keeps_all_that_is_asked_for(spark):
    rows = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("a"), (F.col("id") % 7).alias("b"), "id")
    asked = rows.filter("id % 401 = 3").select("a", "b").unionByName(spark.createDataFrame([("none", 5)], "a string, b long"))
    found = [r["id"] for r in occurrences.likely(rows, asked, ["a", "b"]).collect()]
    assert set(found) >= set(range(3, 20000, 401)) and len(found) < 70 and len(found) == len(set(found))
    assert not occurrences.likely(rows, asked.limit(0), ["a", "b"]).count()


def test_history_deals_leaves_out_once(spark):
    """Leaves of chosen proofs meet their blocks in one exchange, and rows that aren't asked for aren't exchanged before their interval."""
    hashes = [F.sha2(F.concat_ws("|", "stamp", "id"), 256).alias(c) for c in ("byte_hash", "value_hash")]
    rows = spark.range(6000).select(F.explode(F.array(F.lit("1"), F.lit("2"))).alias("stamp"), F.lit("t").alias("table"), F.col("id").cast("string").alias("id")).select("stamp", "table", "id", *hashes)
    numbered = merkle.leaves(rows, "stamp")
    tree = merkle.levels(numbered, "stamp")
    bottom = merkle._asked(tree, numbered.filter("id like '%7'").select("stamp", "idx"), "stamp")[0]
    leaves = plan(bottom.select("stamp", "block", "idx", "hash", "wanted"))
    assert leaves.count("Join") - leaves.count("BroadcastHashJoin") <= 1 and bottom.filter("wanted").count() == 1200
    before = here(spark)
    made = storage.alone(spark, lambda: history.proven(rows, rows.filter("id like '%77'").select("table", "id")), "history")
    assert len(here(spark) - before) == 1
    assert {(r["stamp"], r["step"], r["ok"], r["n"]) for r in made.groupBy("stamp", "step", "ok").agg(F.count("*").alias("n")).collect()} == {("1", "present", True, 60), ("2", "silentRevision", True, 60)}


def landed(spark, folder, stamp, rows):
    """Records (id and hash) of a copy, landed for the stream."""
    key = [F.lit("cr").alias("source"), F.lit("202401").alias("period"), F.lit(stamp).alias("stamp"), F.lit("t").alias("table")]
    rows.select(*key, "id", F.col("h").alias("byte_hash"), F.col("h").alias("value_hash")).write.mode("append").parquet(folder)


def test_watched_copies_are_compared_once(spark, tmp_path):
    """What follows a comparison reads the changes that were written, and nothing is kept in memory or on executors' disks meanwhile."""
    base, seen = f"file://{tmp_path}", []
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("h"))
    for stamp, df in (("20240201T000000Z", rows), ("20240301T000000Z", rows.withColumn("h", F.when(F.col("id") == "7", "b").otherwise("a")))):
        landed(spark, f"{base}/landed", stamp, df)
        watch.watch(spark, f"{base}/landed", f"{base}/copies", f"{base}/feed", f"{base}/checkpoint", lambda df: seen.append((plan(df), df.select("kind", "id", "detected").collect(), spark.sparkContext._jsc.sc().getPersistentRDDs().size()))).awaitTermination()
    assert len(seen) == 1 and "Join" not in seen[0][0] and "FileScan parquet" in seen[0][0]
    assert [tuple(r) for r in seen[0][1]] == [("silentRevision", "7", "20240301T000000Z")] and seen[0][2] == 0


def test_releases_slice_by_slice(spark, monkeypatch):
    """Slices hold every release once, packages are the same however many slices there are, and nothing is left beside the result."""
    calls = []
    monkeypatch.setattr(delivery, "releases", lambda tender, *_, prefix="ocds-x-", keep=(): tender.select(F.concat(F.lit(prefix), "nro_sicop").alias("ocid"), "source_month", F.concat(F.lit('{"id":"'), "nro_sicop", F.lit('"}')).alias("release"), *keep))
    monkeypatch.setattr(delivery, "together", lambda spark, makes, what, by=None: calls.append(what) or storage.together(spark, makes, what, by))
    tender = spark.range(90).select(F.col("id").cast("string").alias("nro_sicop"), F.when(F.col("id") % 3 == 0, "202401").otherwise("202402").alias("source_month"))
    tables, before = [tender, *[tender] * 6], here(spark)
    made = delivery.releases_in_slices(*tables, most=40)
    assert sorted(r["ocid"] for r in made.collect()) == sorted(f"ocds-x-{n}" for n in range(90)) and len(here(spark) - before) == 1
    whole = sorted(map(tuple, delivery.release_packages(delivery.releases(tender), tender, "2024-01-01T00:00:00Z", "cartulary", size=7).collect()))
    for most, steps in ((40, ["paged-releases", "packages"]), (1000, ["packages"])):
        calls.clear()
        cut = delivery.packages_in_slices(*tables, "2024-01-01T00:00:00Z", "cartulary", size=7, most=most)
        assert sorted(map(tuple, cut.collect())) == whole and calls == steps


def test_profiles_leave_one_table(spark):
    """Sections are written one by one and go when the profiles are whole."""
    before = here(spark)
    made = catalog.queries()["supplier_profiles"](spark, "/root/testdata/sf0.001")
    assert [os.path.basename(f).rsplit("-", 1)[0] for f in here(spark) - before] == ["profiles"] and "Exchange" not in plan(made)


def test_watch_report_leaves_only_its_feed_and_reports(spark):
    """Copies of the stream go when the query has its report; it reads no record again for it."""
    before = here(spark)
    made = catalog.queries()["watch_report"](spark, "/root/testdata/sf0.001")
    left = here(spark) - before
    assert len(left) == 1 and not {"landed", "copies"} & set(os.listdir(left.pop())) and made.count() == 5
