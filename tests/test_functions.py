"""Scalar expressions and statistics by hand-computed values."""

from __future__ import annotations

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.functions.names import initials_joined, normalised_name
from cartulary.operators import collusion


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_canonical_number(spark):
    raw = ["1.000", "007", "-0.0", "+3,50", " 12 ", "6780000", ".5", "5.", "-007.10", "1e3", "", "abc", None, "1,2,3"]
    assert values(spark, E.canonical_number("x"), raw) == ["1", "7", "0", "3.5", "12", "6780000", "0.5", "5", "-7.1", None, None, None, None, None]


def test_dates(spark):
    raw = ["2025-12-01 10:00", "01/12/2025", "31-01-2024", "2025-13-45", "x", None, ""]
    assert values(spark, E.iso_date("x"), raw) == ["2025-12-01", "2025-12-01", "2024-01-31", "2025-13-45", None, None, None]
    assert values(spark, E.compact_date("x"), ["01122025", "32122025", "01132025", "2025-01-02"]) == ["2025-12-01", None, None, "2025-01-02"]


def test_number_and_leading_int(spark):
    assert values(spark, E.number("x"), ["1,5", "2.25", "x", None, "1e2"]) == [1.5, 2.25, None, None, 100.0]
    assert values(spark, E.leading_int("x"), ["12abc", " -3", "x", None, "+4"]) == [12, -3, 0, 0, 4]


def test_classes(spark):
    raw = ["Contrato", " Desierto ", "Declarado DESIERTO parcial", "Sin efecto", "En apertura", "Nuevo", None]
    assert values(spark, E.status_class("x"), raw) == ["awarded", "noAward", "noAward", "annulled", "inProgress", "unclassified", "unclassified"]
    assert values(spark, E.exception_family("x"), ["Escasa  cuantía", "otro", None]) == ["low-value-threshold", "substantive", "substantive"]
    assert values(spark, E.dispersion("x"), [1.5, 3.0, 10.0, 10.1, None], "double") == ["tight", "moderate", "wide", "extreme", None]


def test_movement_and_direction(spark):
    df = spark.createDataFrame([("1", "1.0"), ("", "a"), ("a", ""), ("a", "b"), ("9", "10"), ("-9", "-10"), ("0.10", "0.2"), ("-1", "1")], "b string, a string")
    got = [tuple(r) for r in df.select(E.movement("b", "a"), E.direction("b", "a")).collect()]
    assert got == [("reprint", None), ("filled", None), ("cleared", None), ("text", None), ("numeric", "up"), ("numeric", "down"), ("numeric", "up"), ("numeric", "up")]


def test_period_close(spark):
    df = spark.createDataFrame([("202401", "20240203T000000Z"), ("202401", "20240203T000001Z"), ("202401", "bad")], "p string, s string")
    assert [r[0] for r in df.select(E.after_close("p", "s")).collect()] == [False, True, False]


def test_window_drops_null_dates(spark):
    df = spark.createDataFrame([("2025-12-01 23:59",), ("2026-01-01",), (None,)], "fecha_publicacion string")
    w = E.Window("2025-12-01", "2025-12-31")
    assert df.filter(w.tender()).count() == 1
    assert df.filter(E.ALL.tender()).count() == 3


def test_wilson(spark):
    df = spark.createDataFrame([(5, 10), (0, 0), (10, 10)], "k long, n long")
    rows = df.select(S.wilson_low(F.col("k"), F.col("n")), S.wilson_high(F.col("k"), F.col("n"))).collect()
    assert rows[0][0] == pytest.approx(0.2366, abs=1e-4) and rows[0][1] == pytest.approx(0.7634, abs=1e-4)
    assert tuple(rows[1]) == (None, None) and rows[2][1] == pytest.approx(1.0)


def test_binomial_tail(spark):
    cases = [(5, 5), (3, 5), (0, 5), (6, 5), (27, 51)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = [r[0] for r in df.select(S.binomial_tail(F.col("k"), F.col("n"))).collect()]
    for (k, n), p in zip(cases, got, strict=True):
        want = 1.0 if k <= 0 else sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        assert p == pytest.approx(want, abs=1e-12)


def test_binomial_tail_of_many_tosses(spark):
    cases = [(550, 1100), (600, 1100), (2500, 5000), (2600, 5000), (5000, 5000), (1070, 1070), (1010, 1023), (4000, 6000)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = [r[0] for r in df.select(S.binomial_tail(F.col("k"), F.col("n"))).collect()]
    for (k, n), p in zip(cases, got, strict=True):
        assert p == pytest.approx(float(Fraction(sum(math.comb(n, i) for i in range(k, n + 1)), 2**n)), rel=1e-10, abs=5e-324)


def test_balanced_pair_of_many_encounters_is_not_significant(spark):
    tender = spark.range(1100).select(F.col("id").cast("string").alias("nro_sicop"), F.lit("i").alias("cedula_institucion"))
    bid = tender.select("nro_sicop", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("cedula_proveedor"))
    award = tender.select("nro_sicop", F.when(F.col("nro_sicop").cast("int") < 550, "a").otherwise("b").alias("cedula_proveedor"))
    assert collusion.consistent_losing(bid, award, tender).count() == 0
    row = collusion.consistent_losing(bid, award, tender, alpha=1.0).first()
    assert row["encounters"] == 1100 and row["p_value"] == pytest.approx(0.512, abs=1e-3)


def test_kaplan_meier_survival_reaches_zero(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 5, False), ("b", 5, False)], "g string, t int, done boolean")
    rows = {r["g"]: r for r in S.kaplan_meier(df, ["g"], "t", "done").collect()}
    assert rows["a"]["km_median"] == 1 and rows["a"]["reached"]
    assert rows["b"]["km_median"] is None and rows["b"]["censored"] == 2


def test_hhi_and_evenness(spark):
    df = spark.createDataFrame([(50.0,), (50.0,), (-1.0,), (None,)], "v double")
    row = S.hhi(df, "v").first()
    assert row["groups"] == 2 and row["hhi"] == pytest.approx(5000) and row["effective"] == pytest.approx(2)
    empty = S.hhi(df.filter("v > 99"), "v").first()
    assert empty["hhi"] is None and empty["total"] == 0


def test_percentile_rank_counts_ties_half(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    got = sorted((r["v"], r["rank_share"]) for r in S.percentile_rank(df, [], "v").collect())
    assert [round(x, 4) for _, x in got] == [0.0, 0.5, 0.5, 1.0]
    assert S.percentile_rank(df.limit(1), [], "v").first()["rank_share"] is None


def test_names(spark):
    raw = ["Tres Ríos Software LLC, Sociedad Anónima", "A. B. C. Ltda", None]
    flat = values(spark, normalised_name("x"), raw)
    assert [initials_joined(x) for x in flat] == ["TRES RIOS SOFTWARE", "ABC", ""]
