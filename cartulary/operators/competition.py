"""Competition: bidders per tender, exceptions, outcomes, orphans, institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.functions.exprs import ALL, Window
from cartulary.schemas import REGIME_DATE


def bids_in_scope(bid: DataFrame, tender: DataFrame, w: Window = ALL, bid_month: str | None = None) -> DataFrame:
    """Bids with a supplier, and their tender's institution and date.

    With a tender-side window bids without a tender row drop out, as they can't be tested; without one they stay.
    """
    b = bid.filter(E.filled("cedula_proveedor"))
    if bid_month:
        b = b.filter(F.col("source_month") == bid_month)
    t = tender.filter(w.tender()) if w.filters() else tender
    t = t.select(F.col("nro_sicop"), "cedula_institucion", E.iso_date("fecha_publicacion").alias("published"))
    return b.select("nro_sicop", "nro_oferta", "cedula_proveedor").join(t, "nro_sicop", "inner" if w.filters() else "left")


def bidder_counts(bid: DataFrame, tender: DataFrame, w: Window = ALL, bid_month: str | None = None) -> DataFrame:
    """nro_sicop, cedula_institucion, published, bidders, offers: distinct suppliers and offers per tender with bids."""
    return bids_in_scope(bid, tender, w, bid_month).groupBy("nro_sicop").agg(
        F.first("cedula_institucion", True).alias("cedula_institucion"), F.first("published", True).alias("published"),
        F.countDistinct("cedula_proveedor").alias("bidders"), F.countDistinct("nro_oferta").alias("offers"),
    )


def bidder_distribution(counts: DataFrame, most: int = 4) -> DataFrame:
    """bidders (1 to most, the last standing for more), label, tenders, share; empty buckets show 0."""
    spark = counts.sparkSession
    found = counts.groupBy(F.least("bidders", F.lit(most)).alias("bidders")).agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("all_tenders"))  # one row
    buckets = spark.range(1, most + 1).select(F.col("id").alias("bidders"))
    label = F.when(F.col("bidders") == most, F.concat(F.col("bidders").cast("string"), F.lit("+"))).otherwise(F.col("bidders").cast("string"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return buckets.join(found, "bidders", "left").crossJoin(F.broadcast(total)).select("bidders", label.alias("label"), n.alias("tenders"), E.ratio(n, "all_tenders").alias("share"))


def single_bidder(counts: DataFrame, *keys: Column | str) -> DataFrame:
    """Per key: tenders_with_bids, single_bidder, rate and its Wilson interval."""
    n, k = F.count("*"), F.count_if(F.col("bidders") == 1)
    return counts.groupBy(*keys).agg(n.alias("tenders_with_bids"), k.alias("single_bidder"), E.ratio(k, n).alias("rate"), S.wilson_low(k, n).alias("ci_low"), S.wilson_high(k, n).alias("ci_high"))


def orphan_bid_tenders(bid: DataFrame, tender: DataFrame, bid_month: str | None = None) -> DataFrame:
    """One row: tenders that have bids but no tender row."""
    b = bid.filter(F.col("source_month") == bid_month) if bid_month else bid
    return b.join(tender.select("nro_sicop"), "nro_sicop", "left_anti").agg(F.countDistinct("nro_sicop").alias("orphan_tenders"))


def exceptions_by_reason(tender: DataFrame, w: Window = ALL) -> DataFrame:
    """code, description, family, tenders, share of published tenders."""
    t = tender.filter(w.tender()) if w.filters() else tender
    total = t.agg(F.count("*").alias("published"))  # one row
    found = t.filter(E.filled("des_excepcion")).groupBy(F.col("cod_excepcion").alias("code"), F.trim("des_excepcion").alias("description")).agg(F.count("*").alias("tenders"))
    return found.crossJoin(F.broadcast(total)).select("code", "description", E.exception_family("description").alias("family"), "tenders", E.ratio("tenders", "published").alias("share"))


def exception_rates(tender: DataFrame, w: Window = ALL) -> DataFrame:
    """One row: published, with_exception, low_value, substantive, their rates, undescribed codes, tenders on either side of the change of law."""
    t = tender.filter(w.tender()) if w.filters() else tender
    has, low = E.filled("des_excepcion"), E.low_value("des_excepcion")
    day = E.iso_date("fecha_publicacion")
    sums = t.agg(
        F.count("*").alias("published"), F.count_if(has).alias("with_exception"), F.count_if(has & low).alias("low_value"), F.count_if(has & ~low).alias("substantive"),
        F.count_if(~has & E.filled("cod_excepcion")).alias("undescribed_codes"), F.count_if(day < REGIME_DATE).alias("before_regime"), F.count_if(day >= REGIME_DATE).alias("from_regime"),
    )
    return sums.select("*", E.ratio("with_exception", "published").alias("rate"), E.ratio("substantive", "published").alias("substantive_rate"), S.wilson_low(F.col("with_exception"), F.col("published")).alias("ci_low"), S.wilson_high(F.col("with_exception"), F.col("published")).alias("ci_high"))


def status_rollup(tender: DataFrame, w: Window = ALL) -> DataFrame:
    """status, status_class, tenders."""
    t = tender.filter(w.tender()) if w.filters() else tender
    return t.groupBy(F.trim(F.coalesce("cartel_stat", F.lit(""))).alias("status")).agg(F.count("*").alias("tenders")).withColumn("status_class", E.status_class("status"))


def deserted_rate(tender: DataFrame, w: Window = ALL) -> DataFrame:
    """One row: tenders of each class, and those without award over published and over resolved ones."""
    by = status_rollup(tender, w)

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status_class") == kind, F.col("tenders"))), F.lit(0)).cast("long")

    out = by.agg(F.coalesce(F.sum("tenders"), F.lit(0)).cast("long").alias("published"), of("awarded").alias("awarded"), of("noAward").alias("no_award"), of("annulled").alias("annulled"), of("inProgress").alias("in_progress"), of("unclassified").alias("unclassified"))
    return out.select("*", E.ratio("no_award", "published").alias("rate_of_published"), E.ratio("no_award", F.col("awarded") + F.col("no_award")).alias("rate_of_resolved"))


def tenders_without_bids(bid: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """One row: published, joined (tenders with bids and a tender row), without_bids (never below 0)."""
    t = tender.filter(w.tender()) if w.filters() else tender
    with_bids = bidder_counts(bid, t).select("nro_sicop")
    marked = t.select("nro_sicop").join(with_bids.withColumn("has", F.lit(True)), "nro_sicop", "left")
    return marked.agg(F.count("*").alias("published"), F.count_if("has").alias("joined")).withColumn("without_bids", F.greatest(F.lit(0), F.col("published") - F.col("joined")).cast("long"))


def by_institution(bid: DataFrame, tender: DataFrame, institution: DataFrame, w: Window = ALL, min_tenders: int = 20) -> DataFrame:
    """Nine measures per institution with at least min_tenders; tenders without institution form a group."""
    t = (tender.filter(w.tender()) if w.filters() else tender).select("nro_sicop", "cedula_institucion", "cartel_stat", "des_excepcion")
    b = bid.filter(E.filled("cedula_proveedor")).groupBy("nro_sicop").agg(F.countDistinct("cedula_proveedor").alias("bidders"))
    has, kind = E.filled("des_excepcion"), E.status_class("cartel_stat")
    no_award = (kind == "noAward") | F.lower(F.coalesce("cartel_stat", F.lit(""))).contains("desierto") | F.lower(F.coalesce("cartel_stat", F.lit(""))).contains("infructuoso")
    sums = t.join(b, "nro_sicop", "left").groupBy("cedula_institucion").agg(
        F.count("*").alias("tenders_published"), F.count_if(F.col("bidders").isNotNull()).alias("tenders_with_bids"), F.count_if(F.col("bidders") == 1).alias("single_bidder"),
        F.count_if(has).alias("exception_tenders"), F.count_if(has & ~E.low_value("des_excepcion")).alias("substantive_exceptions"),
        F.count_if(no_award).alias("no_award"), F.count_if((kind == "awarded") | no_award).alias("resolved"),
    ).filter(F.col("tenders_published") >= min_tenders)
    named = sums.join(institution.select(F.col("cedula").alias("cedula_institucion"), "nombre"), "cedula_institucion", "left")
    return named.select(
        "cedula_institucion", "nombre", "tenders_published", "tenders_with_bids", "single_bidder", E.ratio("single_bidder", "tenders_with_bids").alias("single_bidder_rate"),
        "exception_tenders", E.ratio("exception_tenders", "tenders_published").alias("exception_rate"), "substantive_exceptions", E.ratio("substantive_exceptions", "tenders_published").alias("substantive_rate"),
        "no_award", E.ratio("no_award", "resolved").alias("deserted_rate"),
    )
