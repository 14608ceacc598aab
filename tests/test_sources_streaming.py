"""Tolerant CSV, archives, manifests, and the watching stream."""

from __future__ import annotations

import io
import json
import zipfile

import pytest

from cartulary.operators import index
from cartulary.sources import archive
from cartulary.streaming.watch import RECORD, watch


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('a;b\r\n1;2\n3;4\r5;6', [["a", "b"], ["1", "2"], ["3", "4"], ["5", "6"]]),
        ('"x;y";"he said ""hi"""\n', [["x;y", 'he said "hi"']]),
        ('"3" tube";ok\n"next";row\n', [['3" tube', "ok"], ["next", "row"]]),
        ('"a 1/2" pipe";z\n', [['a 1/2" pipe', "z"]]),
        ("\n\na\n\n", [["a"]]),
        ("a;;\n", [["a", "", ""]]),
        ("", []),
        ('"line\nbreak";x', [["line\nbreak", "x"]]),
    ],
)
def test_tolerant_csv(text, want):
    assert list(archive.parse_csv(text, ";")) == want


def test_delimiter():
    assert archive.delimiter(b"a,b,c;d\n1;2;3;4;5") == "," and archive.delimiter(b"a;b,c") == ";" and archive.delimiter(b"") == ";"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_and_named_columns(spark, tmp_path):
    inner = zipped({"Ofertas.csv": "﻿NRO_SICOP;Nro_Oferta\n1;2\n"})
    (tmp_path / "202401").mkdir()
    (tmp_path / "202401" / "20240201T000000Z-0123456789ab.zip").write_bytes(zipped({"dir/Carteles.csv": "id,x\n7,é\n8,\n", "nested.zip": inner, "readme.txt": "no"}))
    rows = archive.read_archives(spark, str(tmp_path))
    assert {(r["table"], r["row_pos"], tuple(r["cells"])) for r in rows.collect()} == {("Carteles", 0, ("7", "é")), ("Carteles", 1, ("8", "")), ("Ofertas", 0, ("1", "2"))}
    named = archive.named_columns(rows, "Ofertas", {"nro_sicop": ("NRO_SICOP",), "offer": ("missing", "nro_oferta"), "none": ("absent",)}).first()
    assert (named["nro_sicop"], named["offer"], named["none"]) == ("1", "2", None)
    listed = archive.archive_list(spark, str(tmp_path)).first()
    assert (listed["period"], listed["stamp"], listed["short"]) == ("202401", "20240201T000000Z", "0123456789ab")


def test_manifest_defaults(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"source": "cr", "month": "202401", "status": "stored"}) + "\n" + json.dumps({"source": "cr", "period": "202402", "tlsVerified": False}) + "\n")
    got = {r["period"]: r["tls_verified"] for r in archive.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert got == {"202401": True, "202402": False}


def test_missing_table_is_empty(spark, tmp_path):
    df = archive.table_or_empty(spark, str(tmp_path / "nothing"), "a string, b long")
    assert df.count() == 0 and df.columns == ["a", "b"]


def test_latest_wins(spark):
    rows = spark.createDataFrame([("1", "202401", 1, 0, "old"), ("1", "202402", 1, 0, "new"), ("1", "202402", 2, 0, "reloaded"), ("", "202402", 1, 1, "no key"), (None, "202402", 1, 2, "no key")], "nro_sicop string, source_month string, load_seq int, row_pos long, v string")
    assert [r["v"] for r in index.latest_wins(rows, ("nro_sicop",)).collect()] == ["reloaded"]
    assert {r["v"] for r in index.latest_wins(rows, ("nro_sicop",), coalesce=True).collect()} == {"reloaded", "no key"}


def test_merging_refuses_names_with_other_serials(spark):
    people = spark.createDataFrame([("3101000001", "Acme S.A."), ("3102000001", "ACME Sociedad Anónima"), ("3101000002", "Acme Ltda"), ("104440555", "Acme"), ("3101000009", None)], "cedula string, nombre string")
    named = index.with_names(people)
    g = index.supplier_groups(named).collect()
    assert [(r["group_id"], r["members"], r["group_name"]) for r in g] == [("group:3101000001", ["3101000001", "3102000001"], "ACME Sociedad Anónima")]
    assert index.rejected_names(named).first()["norm_name"] == "ACME"
    bid = spark.createDataFrame([("3101000001", "c1")], "cedula_proveedor string, id_consorcio string")
    entity, member = index.resolve(named, bid)
    assert index.owning_entity(entity, member).groupBy("cedula_proveedor").count().filter("count > 1").count() == 0
    assert entity.filter("kind = 'consortium'").count() == 1


def test_watch_compares_each_new_copy(spark, tmp_path):
    land, state, feed, cp = (str(tmp_path / x) for x in ("land", "state", "feed", "cp"))

    def drop(stamp, *items):
        spark.createDataFrame([("cr", "202401", stamp, "T", i, b, v) for i, b, v in items], RECORD).coalesce(1).write.mode("append").parquet(land)

    drop("20240201T000000Z", ("1", "b1", "v1"), ("2", "b2", "v2"))
    watch(spark, land, state, feed, cp).awaitTermination(120)
    assert not (tmp_path / "feed").exists()
    drop("20240301T000000Z", ("1", "b1", "v1"), ("2", "x", "y"), ("3", "b", "v"))
    watch(spark, land, state, feed, cp).awaitTermination(120)
    got = {(r["id"], r["kind"]) for r in spark.read.parquet(feed).collect()}
    assert got == {("2", "silentRevision"), ("3", "added")}
    watch(spark, land, state, feed, cp).awaitTermination(120)
    assert spark.read.parquet(feed).count() == 2
