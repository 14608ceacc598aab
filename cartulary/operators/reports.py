"""Whole reports: sections of several operators side by side, with the inputs that they lacked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.functions.exprs import ALL, Window
from cartulary.operators import awards, competition, suppliers
from cartulary.storage import written

FIGURE = "section string, name string, value double"


def missing_inputs(tables: dict[str, DataFrame]) -> list[str]:
    """Names of the tables without a row."""
    return [name for name, df in tables.items() if not df.limit(1).count()]


def as_of(loaded: DataFrame, stage_dates: DataFrame) -> DataFrame:
    """One row as_of, source: the day of the newest loaded archive, else of the newest stage date, else today."""
    stamp = F.regexp_extract(F.trim("archive_stamp"), r"^(\d{4})-?(\d{2})-?(\d{2})", 0)
    day = F.regexp_replace(stamp, r"^(\d{4})-?(\d{2})-?(\d{2})", "$1-$2-$3")
    # the day is read from the newest stamp alone, as published stamps sort as text
    a = loaded.agg(F.max("archive_stamp").alias("archive_stamp")).select(F.nullif(day, F.lit("")).alias("loaded"))
    b = stage_dates.agg(F.max(E.iso_date("publicacion")).alias("staged"))
    both = a.crossJoin(F.broadcast(b))  # one row each
    now = F.date_format(F.current_date(), "yyyy-MM-dd")
    source = F.when(F.col("loaded").isNotNull(), "loaded_archive").when(F.col("staged").isNotNull(), "stage_dates").otherwise("today")
    return both.select(F.coalesce("loaded", "staged", now).alias("as_of"), source.alias("source"))


def figures(section: str, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """section, name, value: the columns of a table of one row."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.explode(pairs).alias("p")).select(F.lit(section).alias("section"), "p.name", "p.value")


def competition_report(bid: DataFrame, tender: DataFrame, award: DataFrame, w: Window = ALL) -> DataFrame:
    """section, name, value: all figures of the competition report.

    Without tenders or bids the sections that need both have no rows; each empty input is a row of the section missing.
    """
    t = tender.filter(w.tender()) if w.filters() else tender
    lacking = missing_inputs({"tender": tender, "bid": bid})
    deserted = competition.deserted_rate(t)
    exceptions = competition.exception_rates(t)
    parts = [
        figures("deserted", deserted, ("published", "awarded", "no_award", "annulled", "in_progress", "unclassified", "rate_of_published", "rate_of_resolved")),
        figures("exceptions", exceptions, ("published", "with_exception", "low_value", "substantive", "undescribed_codes", "rate", "substantive_rate")),
        figures("concentration", awards.concentration(award, tender), ("groups", "total", "hhi", "top_share", "effective", "other_currency", "no_amount")),
    ]
    if not lacking:
        counts = competition.bidder_counts(bid, tender, w)
        parts.append(figures("single_bidder", competition.single_bidder(counts), ("tenders_with_bids", "single_bidder", "rate", "ci_low", "ci_high")))
        spread = competition.bidder_distribution(counts)
        parts.append(spread.select(F.lit("bidders").alias("section"), F.col("label").alias("name"), F.col("tenders").cast("double").alias("value")))
        orphans = competition.orphan_bid_tenders(bid, tender)
        parts.append(figures("orphans", orphans, ("orphan_tenders",)))
        # orphans are left out, else tenders with bids could outnumber the published ones
        joined = counts.agg(F.count("*").alias("n")) if w.filters() else counts.join(tender.select("nro_sicop"), "nro_sicop", "left_semi").agg(F.count("*").alias("n"))
        without = deserted.select("published").crossJoin(F.broadcast(joined)).select(F.greatest(F.lit(0), F.col("published") - F.col("n")).alias("without_bids"))  # one row each
        parts.append(figures("coverage", without, ("without_bids",)))
    parts.append(bid.sparkSession.createDataFrame([("missing", name, 0.0) for name in lacking], FIGURE))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unclassified_statuses(tender: DataFrame) -> DataFrame:
    """status, tenders: status texts that no class covers, most frequent first."""
    return competition.status_rollup(tender).filter("status_class = 'unclassified'").select("status", "tenders").orderBy(F.desc("tenders"), "status")


def _first(df: DataFrame, keys: str, order: Sequence[Column], most: int, columns: Sequence[str], name: str) -> DataFrame:
    """keys and an array of the first rows of each key."""
    n = F.row_number().over(W.partitionBy(keys).orderBy(*order))
    return df.withColumn("n", n).filter(F.col("n") <= most).groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("n", *columns))).alias(name))


def supplier_profiles(bid: DataFrame, bid_line: DataFrame, award: DataFrame, tender: DataFrame, institution: DataFrame, supplier: DataFrame, appeal: DataFrame, sanction: DataFrame, w: Window = ALL, limit: int = 15) -> DataFrame:
    """A row for each supplier that bids, is registered, appeals or is sanctioned.

    cedula_proveedor, nombre; overall (appearances, decided, won, undecided, rate,
    ends of its interval); by_period (in order of period); beaten_by, products and
    institutions (the ``limit`` most frequent); appeals by result; own sanctions.
    Appearances and defeats are written once; all sections read them.
    Filter the tables by cedula_proveedor before use to compute just one profile.
    """
    key = "cedula_proveedor"
    rows = written(suppliers.appearances(bid, award, tender, w), "appearances")
    lost = written(suppliers.defeats(rows, award), "defeats")
    rate = ("appearances", "decided", "won", "undecided", "rate", "ci_low", "ci_high")
    overall = suppliers.win_rate(rows, key).select(key, F.struct(*rate).alias("overall"))
    dated = rows.withColumn("period", F.coalesce("period", F.lit("unknown")))
    periods = suppliers.win_rate(dated, key, "period").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("period", *rate))).alias("by_period"))
    rivals = suppliers.sanctioned_rivals(suppliers.times_beaten(lost), sanction, supplier).join(suppliers.gaps_of(lost, bid, bid_line), [key, "rival"], "left")
    beaten = _first(rivals, key, (F.desc("times"), F.col("rival")), limit, ("rival", "rival_name", "times", "median_gap", "gap_lines", "sanctioned"), "beaten_by")
    goods = _first(suppliers.product_performance(bid, bid_line, award, tender, w), key, (F.desc("tenders_bid"), F.col("codigo_producto")), limit, ("codigo_producto", "tenders_bid", "tenders_won"), "products")
    places = _first(suppliers.institution_performance(rows, institution), key, (F.desc("tenders"), F.col("cedula_institucion")), limit, ("cedula_institucion", "nombre", "tenders", "decided", "won", "rate"), "institutions")
    raised = suppliers.appeals(appeal).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("result", "appeals"))).alias("appeals"))
    held = sanction.filter(E.filled(key)).groupBy(key).agg(F.count("*").alias("own_sanctions"))
    names = supplier.filter(E.filled(key)).groupBy(key).agg(F.max("nombre").alias("nombre"))
    out = written(overall, "overall")
    # sections have a row for each supplier: written one by one, no more than one has its shuffle files on disk
    for part in (periods, beaten, goods, places):
        out = out.join(written(part, "section"), key, "left")
    for part in (raised, held, names):
        out = out.join(part, key, "full_outer")
    return out.filter(E.filled(key)).withColumn("own_sanctions", F.coalesce("own_sanctions", F.lit(0)).cast("long"))
