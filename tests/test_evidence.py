"""Canonical records, Merkle trees, differences, bundles, versions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from cartulary.operators import bundle, canonical, differ, merkle, versions
from cartulary.schemas import CANON_VERSION, TableDef

ROWS = "table string, row_pos long, header array<string>, cells array<string>"


def rows(spark, cells, header=("id", "v"), table="T"):
    return spark.createDataFrame([(table, i, list(header), list(c)) for i, c in enumerate(cells)], ROWS)


def test_identity_and_hashes(spark):
    defs = {"T": TableDef(("id",), ())}
    recs = canonical.records(rows(spark, [("1", "a"), ("1", "b"), (" ", "c"), ("", "c"), ("2",)]), defs).orderBy("row_pos").collect()
    assert recs[0]["id"] == "1" and recs[4]["id"] == "2"
    assert recs[1]["id"].startswith("sha256:") and recs[1]["id"].endswith("#0") and recs[1]["duplicate_key"]
    assert not recs[2]["duplicate_key"] and recs[2]["id"] != recs[3]["id"]
    text = f"{CANON_VERSION}\0T\0" + "1\0id\x1f1\x1ev\x1fa"
    assert recs[0]["byte_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_literal_duplicates_are_numbered(spark):
    ids = [r["id"] for r in canonical.identified(rows(spark, [("x", "y")] * 3), {}).orderBy("row_pos").collect()]
    assert [i.split("#")[1] for i in ids] == ["0", "1", "2"] and len({i.split("#")[0] for i in ids}) == 1


def test_reprint_keeps_the_value_hash(spark):
    defs = {"T": TableDef(("id",), ("seen",))}
    a = canonical.records(rows(spark, [("1", "2.50", "x")], ("id", "v", "seen")), defs)
    b = canonical.records(rows(spark, [("1", "2.5", "y")], ("id", "v", "seen")), defs)
    assert a.first()["value_hash"] == b.first()["value_hash"] and a.first()["byte_hash"] != b.first()["byte_hash"]


def test_key_needs_all_columns(spark):
    assert canonical.identified(rows(spark, [("1", "a")]), {"T": TableDef(("id", "other"))}).first()["content_addressed"]


def flat_root(hashes):
    row = [bytes.fromhex(h) for h in hashes]
    if not row:
        return hashlib.sha256(b"").hexdigest()
    while len(row) > 1:
        row = [hashlib.sha256(b"\1" + row[i] + row[i + 1]).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 33])
def test_proofs_of_every_leaf(n):
    nodes = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n)]
    root = flat_root(nodes)
    for i, leaf in enumerate(nodes):
        steps = merkle.path(nodes, i)
        assert merkle.verify(leaf, steps, root)
        assert n == 1 or not merkle.verify(hashlib.sha256(b"other").hexdigest(), steps, root)


def test_distributed_root_equals_a_flat_tree(spark):
    recs = spark.range(2500).select(F.lit("T").alias("table"), F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("byte_hash"))
    numbered = merkle.leaves(recs)
    assert [r["idx"] for r in numbered.orderBy("table", "id").select("idx").collect()] == list(range(2500))
    tree = merkle.levels(numbered)
    want = flat_root([r["hash"] for r in numbered.orderBy("idx").collect()])
    assert tree[-1].first()["hash"] == want == merkle.root(recs).first()["root"]
    leaf = numbered.filter("idx = 2049").first()["hash"]
    assert merkle.verify(leaf, merkle.proof(tree, 2049), want)
    with pytest.raises(IndexError):
        merkle.proof(tree, 2500)
    assert merkle.root(recs.limit(0)).first()["root"] == merkle.EMPTY_ROOT


def test_proofs_lead_through_all_levels_to_the_root(spark):
    recs = spark.range(2500).select(F.lit("T").alias("table"), F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("byte_hash"))
    tree = merkle.levels(merkle.leaves(recs))
    want = flat_root([r["hash"] for r in tree[0].orderBy("idx").collect()])
    rows = merkle.verified(merkle.proofs(tree)).collect()
    assert len(rows) == 2500 and all(r["ok"] and r["root"] == want for r in rows)
    assert {r["idx"]: len(r["steps"]) for r in rows}[0] == 12
    some = next(r for r in rows if r["idx"] == 2049)
    assert [(s["hash"], s["side"]) for s in some["steps"]] == [(s.hash, s.side) for s in merkle.proof(tree, 2049)]
    # a wrong node above the blocks, a wrong root, a missing node
    wrong = F.when(F.col("idx") == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")).alias("hash")
    count = lambda t: merkle.verified(merkle.proofs(t)).filter("ok").count()
    assert count([tree[0], tree[1].select("idx", wrong), tree[2]]) == 1024
    assert count([*tree[:2], tree[2].withColumn("hash", F.sha2(F.lit("x"), 256))]) == 0
    assert count([tree[0], tree[1].filter("idx < 2"), tree[2]]) < 2500
    alone = merkle.verified(merkle.proofs(merkle.levels(merkle.leaves(recs.limit(1))))).collect()
    assert [(r["ok"], r["steps"]) for r in alone] == [(True, [])]
    assert merkle.proofs(merkle.levels(merkle.leaves(recs.limit(0)))).count() == 0


def recs(spark, *items):
    return spark.createDataFrame([(t, i, b, v) for t, i, b, v in items], "table string, id string, byte_hash string, value_hash string")


def test_five_kinds(spark):
    before = recs(spark, ("A", "1", "b1", "v1"), ("A", "2", "b2", "v2"), ("A", "3", "b3", "v3"), ("Contratos", "9|0", "b", "v"), ("B", "1", "same", "same"))
    after = recs(spark, ("A", "1", "x1", "v1"), ("A", "2", "x2", "w2"), ("A", "4", "b4", "v4"), ("Contratos", "9|0", "b", "v"), ("Contratos", "9|1", "n", "n"), ("Contratos", "8|1", "n", "n"), ("B", "1", "same", "same"))
    got = {(r["table"], r["id"]): r["kind"] for r in differ.diff(before, after).collect()}
    assert got == {("A", "1"): "reformatted", ("A", "2"): "silentRevision", ("A", "3"): "removed", ("A", "4"): "added", ("Contratos", "9|1"): "recordedAmendment", ("Contratos", "8|1"): "added"}
    counts = {r["kind"]: r["changes"] for r in differ.kind_counts(differ.diff(before, before)).collect()}
    assert counts == {k: 0 for k in ("added", "recordedAmendment", "silentRevision", "reformatted", "removed")}


def test_field_diff_tells_missing_from_empty(spark):
    df = spark.createDataFrame([({"a": "1", "b": "", "c": "x"}, {"a": "1", "c": "", "d": ""})], "old map<string,string>, new map<string,string>")
    got = [tuple(f) for f in df.select(differ.field_diff(F.col("old"), F.col("new")).alias("f")).first()["f"]]
    assert got == [("b", "", None), ("c", "x", ""), ("d", None, "")]


def test_bundle_is_deterministic_and_detects_tampering(spark):
    defs = {"T": TableDef(("id",))}
    one, two = canonical.records(rows(spark, [("1", "a"), ("2", "b"), ("3", "ñ")]), defs), canonical.records(rows(spark, [("1", "a"), ("2", "c"), ("4", "d")]), defs)
    lines = bundle.build(one, two, canonical.fields(one), canonical.fields(two)).persist()
    counts = {r["kind"]: r["changes"] for r in differ.kind_counts(differ.diff(one, two)).collect()}
    side = lambda x: {"stamp": x, "sha256": x, "root": x}
    m = bundle.manifest(lines, counts, "cr", "202401", side("a"), side("b"), canon_version=CANON_VERSION)
    again = bundle.manifest(lines.repartition(3), counts, "cr", "202401", side("a"), side("b"), canon_version=CANON_VERSION)
    assert m == again and all(ok for _, ok, _ in bundle.verify(m, lines))
    bad = lines.withColumn("line", F.regexp_replace("line", "ñ", "n"))
    assert not dict((n, ok) for n, ok, _ in bundle.verify(m, bad))["changes"]
    parsed = bundle.parsed(lines)
    assert bundle.filtered(parsed, kind="silentRevision", field="v").count() == 1
    short = bundle.build(one, two, canonical.fields(one), canonical.fields(two), max_detail=1)
    assert bundle.filtered(bundle.parsed(short), readable=True).count() == 1


def test_budget_takes_kinds_in_order(spark):
    c = spark.createDataFrame([("added", "T", str(i), None, None) for i in range(5)] + [("silentRevision", "T", "x", None, None)], "kind string, table string, id string, before string, after string")
    got = {(r["kind"], r["id"]) for r in differ.detail_budget(c, 3).filter("detailed").collect()}
    assert got == {("silentRevision", "x"), ("added", "0"), ("added", "1")}
    assert differ.detail_budget(c, 0).filter("detailed").count() == 0
    with pytest.raises(ValueError):
        differ.detail_budget(c, -1)


def test_anchor_entries_round_trip(spark):
    caps = spark.createDataFrame([("202401", "s1", "a" * 64, "root1", "x-canon-1", 10), ("202401", "s2", "b" * 64, "root2", "x-canon-2", 11)], "period string, stamp string, sha256 string, root string, canon_version string, records long")
    entries = versions.version_entries(caps, "pa")
    got = {r["root"]: r for r in versions.parse_versions(entries).collect()}
    assert got["root1"]["canon"] == 1 and got["root2"]["canon"] == 2 and got["root2"]["ns"] == "pa" and got["root1"]["records"] == 10
    d = spark.createDataFrame([("202401", "a" * 64, "b" * 64, "x-canon-2", "x-bundle-2", "dig", "chg", 1, 2, 3, 4, 5)], "period string, from_sha256 string, to_sha256 string, canon_version string, bundle_version string, digest string, changes_sha256 string, added int, recorded_amendment int, silent_revision int, reformatted int, removed int")
    row = versions.parse_diffs(versions.diff_entries(d)).first()
    assert (row["ns"], row["canon"], row["bundle"], row["counts"], row["changes_sha256"]) == (None, 2, 2, [1, 2, 3, 4, 5], "chg")
    plan = versions.plan(entries, 3).collect()
    assert max(r["batch"] for r in plan) == 1


def test_candidate(spark):
    caps = spark.createDataFrame([("202401", "r1")], "period string, root string")
    anchored = spark.createDataFrame([("202401", "r1"), ("202401", "r2")], "period string, root string")
    assert [versions.candidate(x, caps, anchored, "202401") for x in ("r1", "r2", "r3")] == ["copyOfHeldVersion", "exactHistoricalVersion", "unattestedExternalCopy"]
