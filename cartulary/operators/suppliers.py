"""Supplier profiles for all suppliers in one pass; filter the result for one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.functions.exprs import ALL, Window


def winner_sets(award: DataFrame) -> DataFrame:
    """nro_sicop, winner: distinct awarded suppliers."""
    return award.filter(E.filled("cedula_proveedor")).select("nro_sicop", F.col("cedula_proveedor").alias("winner")).distinct()


def appearances(bid: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """cedula_proveedor, nro_sicop, cedula_institucion, period, decided, won: a supplier and a tender it bid on, once."""
    t = (tender.filter(w.tender()) if w.filters() else tender).select("nro_sicop", "cedula_institucion", F.substring(E.iso_date("fecha_publicacion"), 1, 7).alias("period"))
    b = bid.filter(E.filled("cedula_proveedor")).select("nro_sicop", "cedula_proveedor").distinct().join(t, "nro_sicop")
    won = winner_sets(award)
    decided = won.select("nro_sicop").distinct().withColumn("decided", F.lit(True))
    mine = won.select("nro_sicop", F.col("winner").alias("cedula_proveedor"), F.lit(True).alias("won"))
    out = b.join(decided, "nro_sicop", "left").join(mine, ["nro_sicop", "cedula_proveedor"], "left")
    return out.withColumn("decided", F.coalesce("decided", F.lit(False))).withColumn("won", F.coalesce("won", F.lit(False)))


def win_rate(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: appearances, decided, won, undecided, rate and its Wilson interval."""
    n, k = F.count_if("decided"), F.count_if(F.col("decided") & F.col("won"))
    return rows.groupBy(*keys).agg(F.count("*").alias("appearances"), n.alias("decided"), k.alias("won"), F.count_if(~F.col("decided")).alias("undecided"), E.ratio(k, n).alias("rate"), S.wilson_low(k, n).alias("ci_low"), S.wilson_high(k, n).alias("ci_high"))


def defeats(rows: DataFrame, award: DataFrame) -> DataFrame:
    """nro_sicop, cedula_proveedor, rival: who won the decided tenders that a supplier lost."""
    lost = rows.filter("decided and not won").select("nro_sicop", "cedula_proveedor")
    return lost.join(winner_sets(award).withColumnRenamed("winner", "rival"), "nro_sicop")


def beaten_by(rows: DataFrame, award: DataFrame) -> DataFrame:
    """cedula_proveedor, rival, times, tenders (sorted): who won the decided tenders that a supplier lost."""
    return defeats(rows, award).groupBy("cedula_proveedor", "rival").agg(F.count("*").alias("times"), F.array_sort(F.collect_set("nro_sicop")).alias("tenders"))


def times_beaten(lost: DataFrame) -> DataFrame:
    """cedula_proveedor, rival, times: counts of ``defeats``, without gathering a pair's tenders."""
    return lost.groupBy("cedula_proveedor", "rival").agg(F.count("*").alias("times"))


def rival_gaps(bid: DataFrame, bid_line: DataFrame, rows: DataFrame, award: DataFrame) -> DataFrame:
    """cedula_proveedor, rival, gap_lines, median_gap: the supplier's price over the rival's on lines of tenders lost to it."""
    return gaps_of(defeats(rows, award), bid, bid_line)


def gaps_of(lost: DataFrame, bid: DataFrame, bid_line: DataFrame) -> DataFrame:
    """rival_gaps, from the rows of ``defeats``."""
    offers = bid.filter(E.filled("cedula_proveedor")).select("nro_sicop", "nro_oferta", "cedula_proveedor")
    priced = bid_line.filter(F.col("precio_unitario") > 0).select("nro_sicop", "nro_oferta", "nro_linea", "codigo_producto", "moneda", "precio_unitario").join(offers, ["nro_sicop", "nro_oferta"])
    mine = priced.select("nro_sicop", "nro_linea", "codigo_producto", "moneda", "cedula_proveedor", F.col("nro_oferta").alias("my_offer"), F.col("precio_unitario").alias("mine"))
    other = priced.select("nro_sicop", "nro_linea", "codigo_producto", "moneda", F.col("cedula_proveedor").alias("rival"), F.col("nro_oferta").alias("their_offer"), F.col("precio_unitario").alias("theirs"))
    # the lost pairs come first, so lines meet only rivals that won
    met = lost.join(mine, ["nro_sicop", "cedula_proveedor"]).join(other, ["nro_sicop", "nro_linea", "codigo_producto", "moneda", "rival"]).filter("my_offer <> their_offer")
    gap = (F.col("mine") - F.col("theirs")) / F.col("theirs") * 100
    return met.groupBy("cedula_proveedor", "rival").agg(F.count("*").alias("gap_lines"), F.percentile(gap, F.lit(0.5)).alias("median_gap"))


def product_performance(bid: DataFrame, bid_line: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """cedula_proveedor, codigo_producto, tenders_bid, tenders_won."""
    t = (tender.filter(w.tender()) if w.filters() else tender).select("nro_sicop")
    offers = bid.filter(E.filled("cedula_proveedor")).select("nro_sicop", "nro_oferta", "cedula_proveedor").join(t, "nro_sicop", "left_semi")
    tried = bid_line.filter(E.filled("codigo_producto")).select("nro_sicop", "nro_oferta", "codigo_producto").join(offers, ["nro_sicop", "nro_oferta"]).groupBy("cedula_proveedor", "codigo_producto").agg(F.countDistinct("nro_sicop").alias("tenders_bid"))
    won = award.filter(E.filled("codigo_producto") & E.filled("cedula_proveedor")).join(t, "nro_sicop", "left_semi").groupBy("cedula_proveedor", "codigo_producto").agg(F.countDistinct("nro_sicop").alias("tenders_won"))
    return tried.join(won, ["cedula_proveedor", "codigo_producto"], "left").withColumn("tenders_won", F.coalesce("tenders_won", F.lit(0)).cast("long"))


def institution_performance(rows: DataFrame, institution: DataFrame) -> DataFrame:
    """cedula_proveedor, cedula_institucion, nombre, tenders, decided, won, rate."""
    by = rows.groupBy("cedula_proveedor", "cedula_institucion").agg(F.count("*").alias("tenders"), F.count_if("decided").alias("decided"), F.count_if(F.col("decided") & F.col("won")).alias("won"))
    return by.join(institution.select(F.col("cedula").alias("cedula_institucion"), "nombre"), "cedula_institucion", "left").withColumn("rate", E.ratio("won", "decided"))


def appeals(appeal: DataFrame) -> DataFrame:
    """cedula_proveedor, result, appeals: grouped by the text as published, so differently spaced texts keep rows of their own."""
    by = appeal.groupBy("cedula_proveedor", "resultado").agg(F.countDistinct("nro_recurso").alias("appeals"))
    return by.select("cedula_proveedor", F.when(E.filled("resultado"), F.trim("resultado")).otherwise("(none)").alias("result"), "appeals")


def appeal_success(appeal: DataFrame) -> DataFrame:
    """cedula_proveedor, decided, upheld, success_rate: appeals with a result, and those upheld at least in part."""
    by = appeals(appeal)
    named = F.col("result") != "(none)"
    up = F.lower("result").contains("con lugar")
    out = by.groupBy("cedula_proveedor").agg(F.coalesce(F.sum(F.when(named, F.col("appeals"))), F.lit(0)).cast("long").alias("decided"), F.coalesce(F.sum(F.when(named & up, F.col("appeals"))), F.lit(0)).cast("long").alias("upheld"))
    return out.withColumn("success_rate", E.ratio("upheld", "decided"))


def sanctioned_rivals(beaten: DataFrame, sanction: DataFrame, supplier: DataFrame) -> DataFrame:
    """beaten with the rival's name, number of sanctions and whether it has any."""
    held = sanction.groupBy(F.col("cedula_proveedor").alias("rival")).agg(F.count("*").alias("sanctions"))
    names = supplier.select(F.col("cedula_proveedor").alias("rival"), F.col("nombre").alias("rival_name"))
    out = beaten.join(held, "rival", "left").join(names, "rival", "left")
    return out.withColumn("sanctions", F.coalesce("sanctions", F.lit(0)).cast("long")).withColumn("sanctioned", F.col("sanctions") > 0)


def profile(cedula: str, bid: DataFrame, bid_line: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL, limit: int = 15) -> DataFrame:
    """Rivals of one supplier, most frequent first: its rows are picked before anything is joined."""
    rows = appearances(bid, award, tender, w).filter(F.col("cedula_proveedor") == cedula)
    both = beaten_by(rows, award).join(rival_gaps(bid, bid_line, rows, award), ["cedula_proveedor", "rival"], "left")
    return both.withColumn("n", F.row_number().over(W.orderBy(F.desc("times"), "rival"))).filter(F.col("n") <= limit).drop("n")
