"""Award lines in their latest act, concentration of awarded value, orphan money."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.functions.exprs import ALL, Window


def latest_award_lines(award: DataFrame) -> DataFrame:
    """Of the acts that award a line of an offer, the one with the highest number counts; sums over all would count money twice.

    The number is the text's leading whole number; texts with equal numbers rank by the text itself.
    """
    order = W.partitionBy("nro_sicop", "nro_oferta", "nro_linea").orderBy(E.leading_int("nro_acto").desc(), F.desc("nro_acto"), F.desc("codigo_producto"), F.desc("precio_unitario"), F.desc("cantidad"), F.desc("source_month"))
    return award.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def double_counting(award: DataFrame) -> DataFrame:
    """One row: lines and value of all acts, of the latest acts, and the surplus."""
    value = F.col("cantidad") * F.col("precio_unitario")
    every = award.agg(F.count("*").alias("all_lines"), F.sum(value).alias("all_value"))
    last = latest_award_lines(award).agg(F.count("*").alias("latest_lines"), F.sum(value).alias("latest_value"))
    return every.crossJoin(F.broadcast(last)).select("*", (F.col("all_value") - F.col("latest_value")).alias("surplus"))


def scoped(award: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """Latest award lines; with a tender-side window only those whose tender row passes it."""
    last = latest_award_lines(award)
    if w.month:
        last = last.filter(F.col("source_month") == w.month)
    side = Window(w.from_, w.to, None, w.institution)
    return last.join(tender.filter(side.tender()).select("nro_sicop"), "nro_sicop", "left_semi") if side.filters() else last


def supplier_value(award: DataFrame, tender: DataFrame, currency: str = "CRC", w: Window = ALL) -> DataFrame:
    """cedula_proveedor, value, lines: awarded value in one currency."""
    rows = scoped(award, tender, w).filter((F.col("moneda") == currency) & (F.col("cantidad") > 0) & (F.col("precio_unitario") > 0) & E.filled("cedula_proveedor"))
    return rows.groupBy("cedula_proveedor").agg(F.sum(F.col("cantidad") * F.col("precio_unitario")).alias("value"), F.count("*").alias("lines"))


def concentration(award: DataFrame, tender: DataFrame, currency: str = "CRC", w: Window = ALL) -> DataFrame:
    """One row: the concentration index of awarded value and what was left out of it."""
    rows = scoped(award, tender, w)
    mine = F.col("moneda").eqNullSafe(currency)
    unpriced = F.col("cantidad").isNull() | F.col("precio_unitario").isNull() | (F.col("cantidad") <= 0) | (F.col("precio_unitario") <= 0)
    left_out = rows.agg(F.count_if(~mine).alias("other_currency"), F.count_if(mine & unpriced).alias("no_amount"))
    return S.hhi(supplier_value(award, tender, currency, w), "value").crossJoin(F.broadcast(left_out))


def top_suppliers(award: DataFrame, tender: DataFrame, currency: str = "CRC", k: int = 10, w: Window = ALL) -> DataFrame:
    """The k suppliers of most awarded value, with their share."""
    values = supplier_value(award, tender, currency, w)
    total = values.agg(F.sum("value").alias("total"))  # one row
    return values.orderBy(F.desc("value"), "cedula_proveedor").limit(k).crossJoin(F.broadcast(total)).select("cedula_proveedor", "value", "lines", E.ratio("value", "total").alias("share"))


def orphan_awards(award: DataFrame, tender: DataFrame) -> DataFrame:
    """One row: latest award lines and value, and those without a tender row, as counts and shares."""
    last = latest_award_lines(award).withColumn("v", F.coalesce(F.col("cantidad") * F.col("precio_unitario"), F.lit(0.0)))
    known = tender.select("nro_sicop").distinct().withColumn("known", F.lit(True))
    marked = last.join(known, "nro_sicop", "left")
    lost = F.col("known").isNull()
    sums = marked.agg(F.count("*").alias("lines"), F.sum("v").alias("value"), F.count_if(lost).alias("orphan_lines"), F.coalesce(F.sum(F.when(lost, F.col("v"))), F.lit(0.0)).alias("orphan_value"))
    return sums.select("*", E.ratio("orphan_lines", "lines").alias("line_share"), E.ratio("orphan_value", "value").alias("value_share"))
