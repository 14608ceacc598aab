"""Mechanisms for large tables against plain versions, on small ones."""

from __future__ import annotations

import json
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartulary import cli
from cartulary.functions import quantiles
from cartulary.functions import stats as S
from cartulary.operators import bundle, delivery, differ, history, index, institutions, loading, merkle, occurrences, paging, prices, reconcile, snapshots, state
from cartulary.sources import archive, chunks
from cartulary.storage import written
from cartulary.streaming import watch


def read_in_chunks(data: bytes, size: int) -> tuple[list[tuple[int, list[str]]], list[str]]:
    """Rows with their numbers, and the header, from chunks that know nothing of each other but their tables."""
    held = list(chunks.cut_up((data[i : i + size] for i in range(0, len(data), size)), archive.delimiter, archive.parse_csv))
    if not held:
        return [], []
    tables = [{"path": "p", "entry": 0, "chunk": k, "moves": [n for row in chunks.transitions(c, sep.encode()) for n in row]} for k, (sep, _, c) in enumerate(held)]
    places = chunks._numbered(pd.DataFrame(tables))
    tails: dict[int, list[bytes]] = {}
    for k, cut, owner in zip(places["chunk"], places["cut"], places["owner"], strict=True):
        if k:
            tails.setdefault(owner, []).append(held[k][2] if cut < 0 else held[k][2][:cut])
    out = []
    for k, cut, first in zip(places["chunk"], places["cut"], places["first_row"], strict=True):
        if cut >= 0:
            text = (held[k][2][cut:] + b"".join(tails.get(k, ()))).decode("utf-8", "replace")
            out += enumerate(archive.parse_csv(text, held[k][0]), first)
    return out, held[0][1]


def test_chunks_equal_one_reading_across_every_cut():
    rnd = random.Random(3)
    for _ in range(300):
        data = "".join(rnd.choice(['"', '"', ";", ";", "\n", "\r", "\r\n", "a", "é", '""', ","]) for _ in range(rnd.randint(0, 50))).encode()
        want = list(archive.parse_csv(data.decode(), archive.delimiter(data)))
        for size in range(1, 8):
            got, header = read_in_chunks(data, size)
            assert got == list(enumerate(want)) and header == (want[0] if want else [])


def test_an_entry_is_read_by_as_many_tasks_as_it_has_chunks(spark, tmp_path):
    rows = spark.range(400).select(F.lit("202401").alias("period"), F.lit("20240201T000000Z").alias("stamp"), F.lit("T").alias("table"), F.col("id").alias("row_pos"), F.array(F.lit("a"), F.lit("b")).alias("header"), F.array(F.col("id").cast("string"), F.concat(F.lit('x"\n;'), F.col("id").cast("string"))).alias("cells"))
    archive.write_archives(rows, f"file://{tmp_path}/m")
    got = archive.read_archives(spark, f"file://{tmp_path}/m", chunk_bytes=100)
    # chunks of a few bytes are merged into one task unless that is turned off
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["row_pos"], tuple(r["cells"])) for r in got.collect()} == {(k, (str(k), f'x"\n;{k}')) for k in range(400)}


def test_chosen_proofs_and_proofs_together(spark):
    rows = [(t, "x", f"{i:05d}", f"h{i}") for t, n in (("a", 1), ("b", 2), ("c", 7), ("d", 1024), ("e", 2437)) for i in range(n)]
    records = spark.createDataFrame(rows, "tree string, table string, id string, byte_hash string")
    numbered = written(merkle.leaves(records, "tree"), "n")
    tree = merkle.levels(numbered, "tree")
    every = {(r["tree"], r["idx"]): (r["hash"], r["steps"], r["root"]) for r in merkle.proofs(tree, "tree").collect()}
    wanted = written(numbered.filter("tree in ('a', 'b') or idx % 50 = 1 or idx in (2436, 6)").select("tree", "idx", "hash"), "w")
    keys = {(r["tree"], r["idx"]) for r in wanted.collect()}
    chosen = {(r["tree"], r["idx"]): (r["hash"], r["steps"], r["root"]) for r in merkle.proofs(tree, "tree", wanted=wanted).collect()}
    assert chosen == {k: every[k] for k in keys}
    siblings = written(merkle.frontier(tree, wanted, "tree"), "f")
    assert siblings.count() < sum(len(v[1]) for v in chosen.values()) / 2
    sizes = written(merkle.roots(records, "tree"), "s")
    ok = lambda leaves, nodes: {r["tree"]: r["ok"] for r in merkle.proven_together(leaves, nodes, sizes, "tree").collect()}
    good = dict.fromkeys("abcde", True)
    assert ok(wanted, siblings) == good
    last = (F.col("tree") == "e") & (F.col("idx") == 2436)
    assert ok(wanted.withColumn("hash", F.when(last, F.sha2("hash", 256)).otherwise(F.col("hash"))), siblings) == good | {"e": False}
    assert ok(wanted, siblings.filter("not (tree = 'c' and level = 0)")) == good | {"c": False}
    assert ok(wanted.withColumn("idx", F.when(last, 2435).otherwise(F.col("idx"))), siblings) == good | {"e": False}


def changed_copy(spark, n: int, share: int):
    one = spark.range(n).select(F.when(F.col("id") % 3 == 0, "Contratos").otherwise("T").alias("table"), F.concat((F.col("id") / 2).cast("int").cast("string"), F.lit("|"), (F.col("id") % 2).cast("string")).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("byte_hash"), F.sha2(F.lit("v"), 256).alias("value_hash"))
    k = F.crc32("byte_hash") % (4 * share)
    two = one.filter(k != 1).withColumn("byte_hash", F.when(k == 2, F.sha2("byte_hash", 256)).otherwise(F.col("byte_hash"))).withColumn("value_hash", F.when(F.col("byte_hash").startswith("1") & (k == 2), F.sha2("byte_hash", 256)).otherwise(F.col("value_hash")))
    # the contract numbered 0 is there before, so its second sequence is an amendment
    added = one.filter((k == 3) | (F.col("id") == "0|0")).withColumn("id", F.concat("id", F.lit("|new")))
    return one, two.unionByName(added)


def test_bucket_digests_find_what_a_full_join_finds_and_read_little(spark, tmp_path):
    one, two = (written(df, "copy") for df in changed_copy(spark, 4_000, 300))
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    reconcile.store(one, a, 64)
    reconcile.store(two, b, 32)
    plain = {tuple(map(str, r)) for r in differ.diff(one, two, "Contratos").collect()}
    assert {tuple(map(str, r)) for r in reconcile.diff(spark, a, b, "Contratos").collect()} == plain and plain
    assert {k for k, *_ in plain} >= {"removed", "added", "recordedAmendment"}
    chosen, n = reconcile.differing(spark, a, b)
    assert n == 32 and 0 < len(chosen) < 20
    assert reconcile.read(spark, a, chosen, n).count() < 0.7 * 4_000
    reconcile.store(one.orderBy("byte_hash"), b, 128)
    assert reconcile.differing(spark, a, b) == ([], 64)
    # 1 % of the records of 64 buckets of some 6 records each: 1 - 0.99^6 of them differ
    small = written(one.limit(400), "small")
    reconcile.store(small, a, 64)
    reconcile.store(small.withColumn("byte_hash", F.when(F.crc32("id") % 100 == 0, F.lit("x")).otherwise(F.col("byte_hash"))), b, 64)
    assert len(reconcile.differing(spark, a, b)[0]) <= 12
    reconcile.store(one.limit(0), b, 1)
    assert reconcile.diff(spark, a, b).count() == 400


def test_keyed_state_doesn_t_depend_on_files_batches_or_replays(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(str(rnd.randrange(12)), str(k), f"2024{rnd.randrange(1, 4):02d}", rnd.choice("ab"), rnd.randrange(3)) for k in range(120)]
    df = spark.createDataFrame(rows, "nro_sicop string, cartel_nm string, source_month string, archive_stamp string, row_pos long")
    want = {(r["nro_sicop"], r["cartel_nm"]) for r in index.load(df.withColumn("load_seq", F.col("archive_stamp")), "tender").collect()}
    for n, order in ((1, [0]), (3, [2, 0, 1, 0]), (4, [3, 3, 1, 0, 2])):
        folder = f"file://{tmp_path}/s{n}"
        for k in order:
            state.fold(spark, folder, "tender", df.filter(F.crc32("cartel_nm") % n == k).repartition(n), buckets=8)
        assert {(r["nro_sicop"], r["cartel_nm"]) for r in state.read(spark, folder, "tender").collect()} == want
    before = state.current(spark, folder, "tender")
    touched = state.fold(spark, folder, "tender", df.filter("nro_sicop = '3'"), buckets=8)
    after = state.current(spark, folder, "tender")
    assert len(touched) == 1 and sum(before["places"][b] != after["places"][b] for b in before["places"]) == 1
    assert state.tidy(spark, folder, "tender") > 0 and state.read(spark, folder, "tender").count() == len(want)
    assert state.fold(spark, folder, "tender", df.limit(0)) == [] and state.read(spark, f"file://{tmp_path}/none", "tender") is None


def test_history_of_records_with_proofs(spark):
    rows = [("1", "t", "a", "x"), ("2", "t", "a", "x"), ("4", "t", "a", "y"), ("1", "t", "b", "x"), ("3", "t", "b", "z"), ("4", "t", "b", "z"), ("2", "t", "c", "q")]
    records = spark.createDataFrame([(s, t, i, h, "v" + h) for s, t, i, h in rows], "stamp string, table string, id string, byte_hash string, value_hash string")
    copies = history.copies_of(records)
    held = {(r["id"], r["byte_hash"], r["first_seq"], r["last_seq"]) for r in history.intervals(records, copies).collect()}
    assert held == {("a", "x", 1, 2), ("a", "y", 4, 4), ("b", "x", 1, 1), ("b", "z", 3, 4), ("c", "q", 2, 2)}
    wanted = records.select("table", "id").filter("id in ('a', 'b')")
    got = {(r["id"], r["stamp"]): (r["step"], r["ok"], r["leaf_index"]) for r in history.proven(records, wanted).collect()}
    assert got == {
        ("a", "1"): ("present", True, 0), ("a", "2"): ("unchanged", True, 0), ("a", "3"): ("removed", None, None), ("a", "4"): ("added", True, 0),
        ("b", "1"): ("present", True, 1), ("b", "2"): ("removed", None, None), ("b", "3"): ("added", True, 0), ("b", "4"): ("unchanged", True, 1),
    }
    with pytest.raises(ValueError, match="t nowhere"):
        history.proven(records, spark.createDataFrame([("t", "a"), ("t", "nowhere")], "table string, id string"))


def test_numbers_within_a_key_that_holds_nearly_all_rows(spark):
    rows = spark.range(6_000).select(F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 0, F.lit(None)).otherwise("hot").alias("k"), (F.col("id") * 7919 % 6_000).alias("pos")).repartition(4)
    want: dict = {}
    for k, pos in sorted(((r["k"], r["pos"]) for r in rows.collect()), key=lambda r: r[1]):
        want[pos] = (k, sum(1 for v in want.values() if v[0] == k) + 1) if k != "hot" and k is not None else (k, None)
    got = {r["pos"]: (r["k"], r["n"]) for r in occurrences.numbered(rows, ["k"], "pos", "n", hot=500).collect()}
    for key in ("hot", None):
        ordered = sorted(p for p, (k, _) in got.items() if k == key)
        assert [got[p][1] for p in ordered] == list(range(1, len(ordered) + 1))
    assert all(got[p][1] == n for p, (k, n) in want.items() if n is not None)
    spread = occurrences.spread(rows, ["k"], "pos", "n")
    assert {r["pos"]: (r["k"], r["n"]) for r in spread.collect()} == got


def test_quantiles_of_hot_groups_are_exact(spark):
    rng = np.random.default_rng(2)
    groups = {"wide": np.concatenate([rng.normal(size=1_500) * 1e300, [1.7e308, -1.7e308]]), "ties": rng.integers(0, 3, 2_000).astype(float), "one": np.full(1_200, 5.0), "tiny": 10.0 ** rng.integers(-25, 0, 1_100), "few": rng.normal(size=7)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("few", float("nan")), ("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = (0.0, 0.01, 0.333, 0.5, 0.9, 1.0)
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.quantiles(df.withColumnRenamed("g", "grp").select(F.col("grp").alias("k"), "v").withColumnRenamed("k", "g0"), ["g0"], "v", shares, hot=1_000).withColumnRenamed("g0", "g").collect()}
    for g, values in groups.items():
        assert got[g][0] == len(values)
        np.testing.assert_allclose(got[g][1], np.quantile(values / 2, shares) * 2, rtol=1e-12)
    assert got["none"][0] == 0 and not got["none"][1]


def test_peers_by_bins_equal_peers_by_all_pairs(spark):
    rnd = random.Random(8)
    rows = [(f"i{k}", "n", rnd.choice([0, 1, 2, 3, 5, 8, 40, 41, 79, 80, 500]), m, rnd.choice([None, 0.1, 0.2, rnd.random()]), rnd.choice([5, 20, 60])) for k in range(60) for m in ("x", "y")]
    volume: dict[str, int] = {}
    rows = [(i, n, volume.setdefault(i, v), m, x, s) for i, n, v, m, x, s in rows]
    long = spark.createDataFrame(rows, "cedula_institucion string, nombre string, tenders_published long, metric string, value double, n long")
    for everyone in (False, True):
        got = {(r["cedula_institucion"], r["metric"]): r for r in institutions.benchmark(long, all_peers=everyone).collect()}
        assert len(got) == len(rows)
        for i, _, v, m, x, s in rows:
            near = [j for j, w in volume.items() if j != i and max(1, v // 2) <= w <= math.ceil(v * 2)]
            peers = near if len(near) >= 5 and not everyone else [j for j in volume if j != i]
            values = [y for j, _, _, mm, y, t in rows if j in peers and mm == m and t >= 20 and y is not None]
            r = got[i, m]
            assert r["peer_n"] == len(values)
            if values:
                np.testing.assert_allclose([r["peer_p25"], r["peer_median"], r["peer_p75"]], np.quantile(values, (0.25, 0.5, 0.75)))
            if r["suppressed"] is None:
                assert r["percentile"] == pytest.approx((sum(y < x for y in values) + sum(y == x for y in values) / 2) / len(values))


def test_tails_of_fair_tosses_equal_fractions(spark):
    pairs = [(k, n) for n in (1, 2, 3, 7, 17, 40, 97, 130, 1_000) for k in sorted({0, 1, n // 3, n // 2, n // 2 + 1, 3 * n // 4, n - 1, n})] + [(10_050, 20_000), (10_400, 20_000), (9_990, 20_000)]
    rows = spark.createDataFrame(pairs, "k long, n long").withColumn("p", S.binomial_tail(F.col("k"), F.col("n"))).collect()
    for k, n, p in rows:
        term, total = math.comb(n, k), 0
        for i in range(k, n + 1):
            total += term
            term = term * (n - i) // (i + 1)
        assert p == pytest.approx(float(Fraction(total, 2**n)), rel=1e-12), (k, n)
    # far beyond fractions: the normal law with its corrections, and symmetry
    n = 10**9
    big = spark.createDataFrame([(n // 2, n), (n // 2 + 1, n), (n // 2 + 50_000, n), (n // 2 - 49_999, n)], "k long, n long").withColumn("p", S.binomial_tail(F.col("k"), F.col("n"))).collect()
    middle = 1 / math.sqrt(math.pi * n / 2) * (1 - 1 / (4 * n))
    assert big[0][2] - big[1][2] == pytest.approx(middle, rel=1e-6) and big[0][2] + big[1][2] == pytest.approx(1, abs=1e-12)
    assert big[2][2] + big[3][2] == pytest.approx(1, abs=1e-12) and big[2][2] == pytest.approx(0.5 * math.erfc((50_000 - 0.5) / math.sqrt(n / 4) / math.sqrt(2)), rel=1e-5)


def test_deep_pages_read_their_own_files(spark, tmp_path):
    rows = spark.range(5_000).select((F.col("id") % 7).alias("a"), (F.col("id") * 31 % 5_000).alias("b"))
    order, folder = ["a", "b"], f"file://{tmp_path}/index"
    paging.store(rows, order, folder, file_rows=200)
    want = sorted((r["a"], r["b"]) for r in rows.collect())
    files = spark.read.parquet(folder).count()
    assert files >= 25
    for number in (1, 2, 49, 50, 51):
        got = paging.page(spark, folder, rows.schema, order, number, 100)
        assert [tuple(r) for r in got.collect()] == want[100 * (number - 1) : 100 * number]
        assert len(got.inputFiles()) <= 2
    for at in (0, 199, 200, 2_345, 4_990, 4_999):
        got = paging.following(spark, folder, rows.schema, order, want[at], 60)
        assert [tuple(r) for r in got.collect()] == want[at + 1 : at + 61] and len(got.inputFiles()) <= 3
    assert [tuple(r) for r in paging.following(spark, folder, rows.schema, order, None, 5).collect()] == want[:5]


def test_a_snapshot_stored_again_is_there_once(spark, tmp_path):
    records = spark.createDataFrame([("p", "t", str(k), f"b{k}", f"v{k}") for k in range(3)], "path string, table string, id string, byte_hash string, value_hash string")
    heads = spark.createDataFrame([("p", "c", "cr", "202401", "20240201T000000Z", "s", "r", 3)], "path string, canon_version string, source string, period string, stamp string, archive_sha256 string, root string, records long").withColumn("tables", F.array().cast("array<struct<table:string,rows:long,schema:string,content_addressed:boolean,duplicate_keys:long>>"))
    other = heads.withColumn("path", F.lit("q")).withColumn("stamp", F.lit("20240301T000000Z"))
    folder = f"file://{tmp_path}/s"
    snapshots.store(folder, records.withColumn("path", F.lit("q")), other)
    # the first attempt fails between records and headers
    snapshots.store(folder, records.limit(2), heads.limit(1))
    snapshots.store(folder, records, heads)
    for stamp in ("20240201T000000Z", "20240301T000000Z"):
        assert snapshots.read(spark, folder, "cr", "202401", stamp, "c").count() == 3
    assert snapshots.headers(spark, folder).count() == 2


def published(spark, folder: str) -> None:
    """Two copies of a month and one of the next, with two tables."""
    tender, line = ["NRO_SICOP", "Cartel_Nm", "MONTO_EST", "FECHA_PUBLICACION", "CEDULA_INSTITUCION"], ["NRO_SICOP", "NRO_OFERTA", "NRO_LINEA", "CODIGO_PRODUCTO", "CANTIDAD_OFERTADA", "PRECIO_UNITARIO_OFERTADO", "TIPO_MONEDA"]
    rows = []
    for period, stamp, amount in (("202401", "20240201T000000Z", "1,5"), ("202401", "20240301T000000Z", "2,5"), ("202402", "20240301T000000Z", "9")):
        keep = 6 if amount == "2,5" else 8
        rows += [(period, stamp, "DetalleCarteles", k, tender, [f"{period[-1]}{k}", 'the "one"', amount, "05/01/2024 10:00", "I1"]) for k in range(keep)]
        rows += [(period, stamp, "LineasOfertadas", k, line, [f"{period[-1]}{k}", "1", "1", "C", "2", "" if k == 3 else "7,25", "CRC"]) for k in range(4)]
        rows += [(period, stamp, "Otra", 0, ["x"], ["y"])]
    archive.write_archives(spark.createDataFrame(rows, "period string, stamp string, table string, row_pos long, header array<string>, cells array<string>"), folder)


def test_all_tables_of_archives_are_loaded_once(spark, tmp_path):
    mirror, held = f"file://{tmp_path}/m", f"file://{tmp_path}/i"
    published(spark, mirror)
    new = loading.load_archives(spark, mirror, held, buckets=4).collect()
    assert len(new) == 3 and {r["source_month"]: r["row_counts"] for r in new}["202402"] == '{"bid_line":4,"tender":8}'
    assert loading.load_archives(spark, mirror, held).count() == 0 and loading.ledger(spark, held).count() == 3
    tender = {r["nro_sicop"]: (r["monto_est"], r["fecha_publicacion"], r["source_month"], r["archive_stamp"]) for r in loading.table(spark, held, "tender").collect()}
    assert len(tender) == 16 and tender["10"] == (2.5, "2024-01-05", "202401", "20240301T000000Z") and tender["17"][0] == 1.5 and tender["20"][0] == 9.0
    line = {r["nro_sicop"]: (r["cantidad"], r["precio_unitario"], r["moneda"]) for r in loading.table(spark, held, "bid_line").collect()}
    assert line["10"] == (2.0, 7.25, "CRC") and line["13"][1] is None and loading.table(spark, held, "contract").count() == 0
    loading.load_archives(spark, mirror, held, force=True)
    assert {r["nro_sicop"]: (r["monto_est"], r["fecha_publicacion"], r["source_month"], r["archive_stamp"]) for r in loading.table(spark, held, "tender").collect()} == tender


def test_verbs_of_archives(spark, tmp_path, capsys):
    mirror, out = f"file://{tmp_path}/m", f"file://{tmp_path}/b"
    published(spark, mirror)
    assert cli.main(["bundle", "--archives", mirror, "--source", "cr", "--period", "202401", "--out", out]) == 0
    folder = capsys.readouterr().out.strip().splitlines()[-1]
    assert cli.main(["verify-bundle", "--archives", mirror, "--bundle", folder]) == 0 and "later root" in capsys.readouterr().out
    m, lines = bundle.read(spark, folder)
    bundle.write(lines, m | {"digest": "0" * 64, "to_stamp": "20240401T000000Z"}, f"{out}/false")
    assert cli.main(["verify-bundle", "--archives", mirror, "--bundle", f"{out}/false"]) == 1 and "FAIL  later archive" in capsys.readouterr().out
    assert cli.main(["bundle", "--archives", mirror, "--source", "cr", "--period", "202402", "--out", out]) == 1 and "202402" in capsys.readouterr().err
    got = cli.history_of(spark, mirror, "cr", "202401", "DetalleCarteles", "16").select("stamp", "step", "ok").collect()
    assert [tuple(r) for r in got] == [("20240201T000000Z", "present", True), ("20240301T000000Z", "removed", None)]
    assert cli.main(["history", "--archives", mirror, "--source", "cr", "--period", "202401", "--table", "DetalleCarteles", "--id", "none"]) == 1
    held = {(r["period"], r["stamp"]): (r["copies"], r["newest"]) for r in cli.held_copies(spark, mirror, "cr").collect()}
    assert held == {("202401", "20240201T000000Z"): (2, False), ("202401", "20240301T000000Z"): (2, True), ("202402", "20240301T000000Z"): (1, True)}
    store = f"file://{tmp_path}/s"
    assert cli.take_snapshots(spark, mirror, store, "cr").count() == 3
    plan = cli.anchor_plan(spark, store, "cr", "2024-03-02", 5)
    assert plan.count() == 5 and cli.recoverable(spark, store, "cr").count() >= 1


def test_analyses_of_a_loaded_index_take_filters(spark, tmp_path):
    mirror, held = f"file://{tmp_path}/m", f"file://{tmp_path}/i"
    published(spark, mirror)
    loading.load_archives(spark, mirror, held, buckets=4)
    run = lambda *words: cli.analyse(spark, words[0], held, cli.parser().parse_args(["analyse", *words, "--index", held]))
    figures = {(r["section"], r["name"]): r["value"] for r in run("competition").collect()}
    assert figures["deserted", "published"] == 16
    assert {(r["section"], r["name"]): r["value"] for r in run("competition", "--month", "202402").collect()}["deserted", "published"] == 8
    assert {(r["section"], r["name"]): r["value"] for r in run("competition", "--institution", "I2").collect()}["deserted", "published"] == 0
    for words in (("screens",), ("screens", "--screen", "bid-rotation", "--limit", "3"), ("prices", "--lines", "bid", "--code", "C", "--supplier", "S"), ("concentration",), ("institutions", "--min-tenders", "1"), ("suppliers", "--supplier", "S"), ("durations", "--as-of", "2024-05-01", "--stage", "award"), ("ranking", "--as-of", "2024-05-01"), ("peers", "--as-of", "2024-05-01", "--all-peers")):
        run(*words).collect()


def test_a_report_lists_the_first_changes_and_counts_all(spark, tmp_path):
    changes = spark.range(500).select(F.when(F.col("id") % 5 == 0, "silentRevision").otherwise("added").alias("kind"), F.lit("T").alias("table"), F.lpad(F.col("id").cast("string"), 3, "0").alias("id"), F.struct(F.lit("a").alias("byte_hash"), F.lit("b").alias("value_hash")).alias("before"), F.struct(F.lit("c").alias("byte_hash"), F.lit("d").alias("value_hash")).alias("after"), F.lit("202401").alias("period"), F.lit("20240401T000000Z").alias("detected"))
    watch.reporter(spark, f"file://{tmp_path}/r", "cr", limit=120, bundles=f"file://{tmp_path}/b")(changes)
    found = spark.read.json(f"file://{tmp_path}/r").first()["findings"][0]
    assert found["truncated"] and len(found["changes"]) == 120 and found["counts"]["added"] == 400 and found["counts"]["silentRevision"] == 100
    assert [c["kind"] for c in found["changes"]] == ["silentRevision"] * 100 + ["added"] * 20 and found["changes"][0]["id"] == "000"
    assert spark.read.json(found["bundle"]).count() == 500


def test_suppliers_of_prices_come_from_offers(spark):
    rows = spark.createDataFrame([("1", "a", "P", 5.0), ("1", "b", "P", 6.0), ("2", "a", "P", 7.0)], "nro_sicop string, nro_oferta string, codigo_producto string, precio_unitario double")
    bid = spark.createDataFrame([("1", "a", "S1"), ("1", "b", "S2")], "nro_sicop string, nro_oferta string, cedula_proveedor string")
    assert {(r["nro_sicop"], r["nro_oferta"]): r["cedula_proveedor"] for r in prices.with_supplier(rows, bid).collect()} == {("1", "a"): "S1", ("1", "b"): "S2", ("2", "a"): None}


def test_release_members(spark):
    empty = lambda names: spark.createDataFrame([], ", ".join(f"{n} {'double' if n in ('cantidad', 'precio_unitario', 'monto_est') else 'string'}" for n in names.split()))
    tender = spark.createDataFrame([("T1", "P1", "I1", "2024-01-02", None, "LICITACION", " m ", "Contrato", "name", 10.0, "BIENES", None, "202401", "s1"), ("T2", None, None, None, None, None, None, None, None, None, None, None, "202402", "s2")], "nro_sicop string, nro_procedimiento string, cedula_institucion string, fecha_publicacion string, fechah_apertura string, tipo_procedimiento string, modalidad string, cartel_stat string, cartel_nm string, monto_est double, clas_obj string, des_excepcion string, source_month string, archive_stamp string")
    bid = spark.createDataFrame([("T1", "1", "S1"), ("T1", "2", "S1"), ("T1", "3", "S2")], "nro_sicop string, nro_oferta string, cedula_proveedor string")
    award = spark.createDataFrame([("T1", "1", "1", "A", "S1", "12345678", 2.0, 3.0, "USD", "202401"), ("T1", "1", "2", "A", "S1", "x", 1.0, 4.0, "USD", "202401")], "nro_sicop string, nro_oferta string, nro_linea string, nro_acto string, cedula_proveedor string, codigo_producto string, cantidad double, precio_unitario double, moneda string, source_month string")
    contract = spark.createDataFrame([("C1", "2", "T1", "S1", None, "2024-03-01", "EUR", None, "2024-04-01", "more"), ("C1", "1", "T1", "S1", "2024-02-02", "2024-02-01", None, "1 year", None, None)], "nro_contrato string, secuencia string, nro_sicop string, cedula_proveedor string, fecha_notificacion string, fecha_elaboracion string, moneda string, vigencia string, fecha_modificacion string, tipo_modificacion string")
    supplier = spark.createDataFrame([("S1", " One "), ("S2", "Two")], "cedula_proveedor string, nombre string")
    made = delivery.releases(tender, bid, empty("nro_sicop nro_oferta nro_linea codigo_producto cantidad precio_unitario moneda"), award, contract, supplier, spark.createDataFrame([("I1", "Inst")], "cedula string, nombre string"))
    one, two = (json.loads(r["release"]) for r in made.orderBy("ocid").collect())
    assert one["id"] == "T1-202401-s1" and one["tag"] == ["planning", "tender", "award", "contract"] and one["date"] == "2024-01-02T00:00:00Z" and one["language"] == "es"
    assert one["buyer"] == one["tender"]["procuringEntity"] == {"id": "X-ID-I1", "name": "Inst"}
    assert one["planning"] == {"budget": {"id": "P1", "amount": {"amount": 10.0, "currency": "EUR"}}} and one["tender"]["value"]["currency"] == "EUR"
    assert one["tender"]["tenderers"] == [{"id": "X-ID-S1", "name": "One"}, {"id": "X-ID-S2", "name": "Two"}] and one["tender"]["numberOfTenderers"] == 3
    assert one["tender"]["submissionMethodDetails"] == "m" and one["tender"]["tenderPeriod"] == {"startDate": "2024-01-02T00:00:00Z"}
    assert [i["id"] for i in one["awards"][0]["items"]] == ["T1-A-item-1", "T1-A-item-2"] and one["awards"][0]["suppliers"][0]["name"] == "One" and one["awards"][0]["value"] == {"amount": 10.0, "currency": "USD"}
    assert one["contracts"] == [{"id": "C1", "awardID": "A-S1", "status": "active", "dateSigned": "2024-02-01T00:00:00Z", "period": {"startDate": "2024-02-02T00:00:00Z"}, "description": "1 year", "amendments": [{"id": "C1-2", "date": "2024-04-01T00:00:00Z", "rationale": "more"}]}]
    assert two == {"ocid": "ocds-x-T2", "id": "T2-202402-s2", "date": "2024-02-01T00:00:00Z", "tag": ["tender"], "initiationType": "tender", "language": "es", "tender": {"id": "T2"}}
