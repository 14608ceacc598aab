"""Archives to snapshots, bundles, reports, loads, anchors and the command line on small tables."""

from __future__ import annotations

import json
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cartulary import cli
from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.operators import bundle, canonical, collusion, delivery, index, merkle, reports, snapshots, versions
from cartulary.operators import state as keyed
from cartulary.schemas import CHANGE_KINDS, CR_TABLES, PA_TABLES, TableDef, source
from cartulary.sources import archive
from cartulary.storage import written
from cartulary.streaming.watch import RECORD, fold, reporter, watch

ROWS = "period string, stamp string, table string, row_pos long, header array<string>, cells array<string>"


def published(spark, stamp, values):
    rows = [("202401", stamp, "Ofertas", k, ["NRO_SICOP", "NRO_OFERTA", "NOTA"], [str(k % 3), str(k), v]) for k, v in enumerate(values)]
    rows += [("202401", stamp, "Sistemas", 0, ["NRO_SICOP", "X"], ["", "no key"]), ("202401", stamp, "Sistemas", 1, ["NRO_SICOP", "X"], ["", "no key"])]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def mirror(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('mirror')}"
    archive.write_archives(published(spark, "20240201T000000Z", ['a "b"; c', "d\ne", "é", "2.50"]), folder)
    archive.write_archives(published(spark, "20240301T000000Z", ['a "b"; c', "changed", "é", "2.5"]), folder)
    return folder


def test_registries():
    assert len(CR_TABLES) == 25 and len(PA_TABLES) == 17 and source("cr").tables is CR_TABLES
    with pytest.raises(ValueError):
        source("xx")


def test_archive_to_stored_snapshot_and_back(spark, mirror, tmp_path):
    made = written(snapshots.records_of(spark, mirror, "cr"), "records")
    heads = snapshots.headers_of(spark, mirror, made, "cr")
    store = f"file://{tmp_path}/store"
    snapshots.store(store, made, heads)
    for h in snapshots.headers(spark, store).collect():
        recs = snapshots.read(spark, store, "cr", "202401", h["stamp"])
        assert recs.count() == h["records"] == 6 and merkle.root(recs).first()["root"] == h["root"]
        sistemas = next(t for t in h["tables"] if t["table"] == "Sistemas")
        assert sistemas["content_addressed"] and sistemas["rows"] == 2
    ids = {r["id"] for r in recs.filter("table = 'Ofertas'").collect()}
    assert ids == {"0|0", "1|1", "2|2", "0|3"}
    assert snapshots.stored(spark, store, "cr", "202401", "20240201T000000Z") == ["cartulary-canon-2"]
    older = snapshots.load_or_build(spark, store, mirror, "cr", "202401", "20240201T000000Z", "cartulary-canon-1")
    assert older.count() == 6 and snapshots.stored(spark, store, "cr", "202401", "20240201T000000Z") == ["cartulary-canon-2", "cartulary-canon-1"]
    both = snapshots.headers(spark, store).filter("stamp = '20240201T000000Z'")
    assert snapshots.rules_differ(both.filter("canon_version like '%1'"), both.filter("canon_version like '%2'"))
    with pytest.raises(ValueError):
        snapshots.load_or_build(spark, store, mirror, "cr", "202401", "20250101T000000Z")


def test_command_line(spark, mirror, tmp_path, capsys):
    store = f"file://{tmp_path}/store"
    assert cli.main(["list"]) == 0 and "merkle_root" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", "x"]) == 2
    assert cli.main(["snapshot", "--archives", mirror, "--store", store, "--source", "cr"]) == 0
    assert cli.take_snapshots(spark, mirror, store, "cr").count() == 2
    text = cli.compare(spark, store, mirror, "cr", "202401")
    assert "SILENT REVISION    1" in text and "reformatted only   1" in text and "records 6 -> 6" in text
    doc = json.loads(cli.prove(spark, mirror, "cr", "202401", "Ofertas", "1|1"))
    leaf = merkle.leaf(F.lit("Ofertas"), F.lit("1|1"), F.lit(doc["byte_hash"]))
    got = spark.range(1).select(leaf.alias("h")).first()["h"]
    assert merkle.verify(got, [merkle.Step(**s) for s in doc["proof"]], doc["root"]) and doc["leaf_count"] == 6
    assert cli.prove(spark, mirror, "cr", "202401", "Ofertas", "none") is None and cli.prove(spark, mirror, "cr", "209901", "Ofertas", "1|1") is None


def test_bundles_written_read_and_checked_against_copies(spark, tmp_path):
    defs = {"T": TableDef(("id",))}
    make = lambda cells: written(canonical.records(spark.createDataFrame([("T", i, ["id", "v", "v"], list(c)) for i, c in enumerate(cells)], "table string, row_pos long, header array<string>, cells array<string>"), defs), "r")
    one, two = make([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z")]), make([("1", "a", "x"), ("2", "b", "9"), ("4", "d", "w")])
    assert {r["id"]: r["values"]["v"] for r in canonical.fields(one).collect()} == {"1": "x", "2": "y", "3": "z"}
    lines = written(bundle.build(one, two, canonical.fields(one), canonical.fields(two)), "lines")
    heads = [{"stamp": s, "sha256": s, "root": merkle.root(df).first()["root"]} for s, df in (("a", one), ("b", two))]
    counts = {"added": 1, "silentRevision": 1, "removed": 1}
    m = bundle.manifest(lines, counts, "cr", "202401", *heads, canon_version="c")
    folder = bundle.folder_of(f"file://{tmp_path}", "cr", "202401", "a", "b", "c")
    bundle.write(lines, m, folder)
    said, found = bundle.read(spark, folder)
    assert said == m and all(ok for _, ok, _ in bundle.verify(said, found) + bundle.verify_against(said, found, one, two, *heads))
    assert [ok for _, ok, _ in bundle.verify_against(said, found, one, two, heads[0], heads[1] | {"sha256": "other"})] == [True, False]
    wrong = dict((n, ok) for n, ok, _ in bundle.verify_against(said, found.filter("id <> '2'"), one, one, heads[0], heads[1]))
    assert not wrong["rebuilt changes"] and not wrong["published changes"]
    assert bundle.filtered(bundle.parsed(found), numeric=True).count() == 0
    first = m | {"bundle_version": bundle.FIRST_VERSION, "line_policy": ["added"]}
    assert bundle.digest(first) == bundle.digest(first | {"line_policy": list(CHANGE_KINDS)}) != bundle.digest(m)
    assert bundle.folder_of("r", "cr", "p", "a", "b", "c", bundle.FIRST_VERSION) == "r/cr/p/a-b-c"
    assert "isn't sound" in bundle.summary_text("202401", counts, (3, 3), [("T", "a", None)], True)


def test_lines_of_the_jvm_equal_the_plain_rule(spark):
    """Every control character, quotes, slashes, marks, letters beyond the basic plane, nulls and empty maps."""
    odd = ["".join(map(chr, range(32))), 'say "a\\"', "\\u0001 / \x7f \x85\u2028", "e\u0301 \U0001f600 ñ", "", "\n\\n", "plain"]
    sides = [None, {}, {"byteHash": "b", "valueHash": None}]
    rows = []
    for i, a in enumerate(odd):
        for side in sides:
            b = odd[i - 1]
            values = None if side is None else {} if not side else {a: b, "z": None, "B": a, "a": a, "é": b}
            fields = None if side is None else [] if not side else [{"field": a, "before": None, "after": b}, {"field": b, "before": a, "after": a}]
            rows.append((f"k{a}", a, b, side, side if i % 2 else None, values, None if i % 3 else values, fields, i % 2 == 0))
    names = ("kind", "table", "id", "before", "after", "old", "new", "fields", "omitted")
    text, pairs = "string", "map<string,string>"
    types = (text, text, text, pairs, pairs, pairs, pairs, "array<struct<field:string,before:string,after:string>>", "boolean")
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    got = [r["line"] for r in df.repartition(1).select("table", "id", bundle.line_text().alias("line")).collect()]
    assert sorted(got) == sorted(bundle.serialize(dict(zip(names, r, strict=True))) for r in rows)
    assert all(json.loads(line)["table"] in odd for line in got)


def test_reports_name_what_they_lack(spark):
    tender = spark.createDataFrame([("1", "i", "2024-01-01", "Contrato", None, None, "202401")], "nro_sicop string, cedula_institucion string, fecha_publicacion string, cartel_stat string, cod_excepcion string, des_excepcion string, source_month string")
    bid = spark.createDataFrame([], "nro_sicop string, nro_oferta string, cedula_proveedor string, source_month string")
    award = spark.createDataFrame([], "nro_sicop string, nro_oferta string, nro_linea string, nro_acto string, cedula_proveedor string, codigo_producto string, cantidad double, precio_unitario double, moneda string, source_month string")
    sections = {(r["section"], r["name"]) for r in reports.competition_report(bid, tender, award).collect()}
    assert ("missing", "bid") in sections and not any(s == "single_bidder" for s, _ in sections)
    line = award.select("nro_sicop", "nro_oferta", "nro_linea", "codigo_producto", "cantidad", "precio_unitario", "moneda")
    rows = collusion.report(bid, line, award, tender, spark.createDataFrame([], "cedula string, nombre string")).collect()
    assert len(rows) == 4 and all(r["missing"] == "bid" and r["hits"] == 0 for r in rows)


def test_spread_takes_the_product_of_the_latest_act(spark):
    """Two acts of one line: the later one's product decides which rival lines meet it."""
    award = spark.createDataFrame([("1", "a", "1", "1", "A", "p", 1.0, 50.0, "CRC", "m"), ("1", "a", "1", "2", "A", "q", 1.0, 100.0, "CRC", "m")], "nro_sicop string, nro_oferta string, nro_linea string, nro_acto string, cedula_proveedor string, codigo_producto string, cantidad double, precio_unitario double, moneda string, source_month string")
    bid = spark.createDataFrame([("1", "a", "A"), ("1", "b", "B")], "nro_sicop string, nro_oferta string, cedula_proveedor string")
    lines = spark.createDataFrame([("1", "b", "1", "p", 60.0, "CRC"), ("1", "b", "1", "q", 110.0, "CRC")], "nro_sicop string, nro_oferta string, nro_linea string, codigo_producto string, precio_unitario double, moneda string")
    tender = spark.createDataFrame([("1", "i")], "nro_sicop string, cedula_institucion string")
    assert [round(r["gap_pct"], 6) for r in collusion.spread_lines(bid, lines, award, tender).collect()] == [10.0]


def test_binomial_tails_of_any_size(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 1100) for k in (0, 1, n // 2, n, n + 1) for p in (0.5, 0.25)] + [(500_400, 1_000_000, 0.5)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    got = {(r["k"], r["n"], r["p"]): r["t"] for r in df.select("k", "n", "p", S.binomial_tail_at(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()}
    for k, n, p in cases[:-1]:
        q = Fraction(p)
        exact = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(max(0, k), n + 1))
        assert got[(k, n, p)] == pytest.approx(min(1.0, float(exact)), rel=1e-8, abs=1e-300)
    assert got[cases[-1]] == pytest.approx(0.2121, abs=2e-4)
    f = spark.range(0, 200).select("id", S.log_factorial(F.col("id")).alias("f")).collect()
    assert all(r["f"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-13, abs=1e-13) for r in f)


def test_subjects_of_all_tables(spark):
    rows = [("Garantias", "7|g|1"), ("SancionProveedores", "S|I|R|P"), ("Proveedores", "S2"), ("InstitucionesRegistradas", "I2"), ("Contratos", "C|1"), ("Ofertas", "sha256:abc#0"), ("FuncionariosInhibicion", "I3|f|d")]
    got = {(r["table"], r["id"]): (r["nro_sicop"], r["supplier"], r["institution"], r["product"]) for r in delivery.static_subject(spark.createDataFrame(rows, "table string, id string")).collect()}
    assert [got[k] for k in rows] == [("7", None, None, None), (None, "S", "I", "P"), (None, "S2", None, None), (None, None, "I2", None), (None,) * 4, (None,) * 4, (None, None, "I3", None)]


def test_periods_stamps_and_deltas(spark):
    row = spark.range(1).select(
        E.periods(F.lit("202311"), F.lit("202402")).alias("m"), E.periods(F.lit("202402"), F.lit("202311")).alias("none"), E.periods(F.lit("2022"), F.lit("2024"), True).alias("y"),
        E.compact_stamp(F.lit("Thu, 01 Jan 2026 12:00:05 GMT")).alias("s"), E.compact_stamp(F.lit("never")).alias("no"), E.http_date(F.lit("20260101T120005Z")).alias("h"),
        E.delta(F.lit("1,50"), F.lit("100000000000000000000.25")).alias("d"), E.delta(F.lit("2"), F.lit("2.0")).alias("zero"), E.delta(F.lit("x"), F.lit("2")).alias("text"),
    ).first()
    assert row["m"] == ["202311", "202312", "202401", "202402"] and row["none"] == [] and row["y"] == ["2022", "2023", "2024"]
    assert (row["s"], row["no"], row["h"]) == ("20260101T120005Z", None, "Thu, 01 Jan 2026 12:00:05 GMT")
    assert (row["d"], row["zero"], row["text"]) == ("+99999999999999999998.75", "0", None)


def test_anchor_keys_must_differ_and_pairs_be_there(spark):
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], "key string, value string")
    with pytest.raises(ValueError):
        versions.checked(twice)
    held = spark.createDataFrame([("202401", s) for s in ("s1", "s2", "s3")] + [("202402", "s1")], "period string, stamp string")
    assert versions.pair(held, "202401") == ("s2", "s3") and versions.pair(held, "202401", "s3", "s1") == ("s1", "s3") and versions.pair(held, "202401", "s1") == ("s1", "s3")
    for bad in (("202402",), ("202401", "s9"), ("202401", "s1", "s1x")):
        with pytest.raises(ValueError):
            versions.pair(held, *bad)


def test_loads_follow_the_ledger(spark, tmp_path):
    schema = "nro_sicop string, v string, source_month string, archive_stamp string, sha256 string, row_pos long"
    rows = spark.createDataFrame([("1", "old", "202401", "a", "x", 0), ("1", "again", "202401", "b", "y", 0), ("2", "two", "202402", "a", "z", 0), ("", "no key", "202402", "a", "z", 1)], schema)
    none = spark.createDataFrame([], "source_month string, archive_stamp string")
    first, entries = index.load_range(None, rows.filter("archive_stamp = 'a'"), "tender", none)
    assert {(r["nro_sicop"], r["v"]) for r in first.collect()} == {("1", "old"), ("2", "two")} and entries.count() == 2
    folder = f"file://{tmp_path}/index"
    index.save(spark, folder, "tender", first)
    second, more = index.load_range(spark.read.parquet(f"{folder}/tender"), rows, "tender", entries)
    assert {(r["nro_sicop"], r["v"]) for r in second.collect()} == {("1", "again"), ("2", "two")} and more.count() == 1
    index.save(spark, folder, "tender", written(second, "s"))
    assert index.ask(spark, folder, "SELECT source_month FROM tender WHERE nro_sicop = :n", {"n": "2"}).first()["source_month"] == "202402"
    assert index.ask(spark, folder, "SELECT count(*) AS n FROM bid").first()["n"] == 0


def test_stream_keeps_the_newest_rows_and_reports(spark, tmp_path):
    land, state, cp = (f"file://{tmp_path}/{x}" for x in ("land", "state", "cp"))
    put = lambda *rows: spark.createDataFrame(list(rows), "nro_sicop string, cartel_nm string, source_month string, archive_stamp string").coalesce(1).write.mode("append").parquet(land)
    put(("1", "a", "202401", "s1"), ("2", "b", "202401", "s1"))
    fold(spark, land, state, "tender", cp).awaitTermination(120)
    put(("1", "late", "202312", "s2"), ("2", "newer", "202402", "s2"))
    fold(spark, land, state, "tender", cp).awaitTermination(120)
    assert {(r["nro_sicop"], r["cartel_nm"]) for r in keyed.read(spark, state, "tender").collect()} == {("1", "a"), ("2", "newer")}
    drop = lambda stamp, b: spark.createDataFrame([("cr", "202401", stamp, "T", "1", b, b)], RECORD).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/copies")
    for stamp, b in (("20240201T000000Z", "x"), ("20240401T000000Z", "y")):
        drop(stamp, b)
        watch(spark, f"file://{tmp_path}/copies", f"{tmp_path}/st", f"{tmp_path}/feed", f"{tmp_path}/cp2", reporter(spark, f"file://{tmp_path}/reports", "cr")).awaitTermination(120)
    found = delivery.flatten(delivery.read_reports(spark, f"file://{tmp_path}/reports")).collect()
    assert [(r["kind"], r["id"], r["closed_month"]) for r in found] == [("silentRevision", "1", True)]
