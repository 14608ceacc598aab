"""Collusion screens: rotation, consistent losing, bid spread, sole bidders.

All are descriptive; none says that anything is unlawful.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Turn

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.functions.exprs import ALL, Window
from cartulary.operators.awards import latest_award_lines
from cartulary.storage import written


def bidders(bid: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """nro_sicop, cedula_institucion, cedula_proveedor: distinct bidders of tenders that have a row."""
    t = (tender.filter(w.tender()) if w.filters() else tender).select("nro_sicop", "cedula_institucion")
    return bid.filter(E.filled("cedula_proveedor")).select("nro_sicop", "cedula_proveedor").distinct().join(t, "nro_sicop")


def winners(award: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """nro_sicop, winner: distinct awarded suppliers of tenders that have a row."""
    t = (tender.filter(w.tender()) if w.filters() else tender).select("nro_sicop")
    return award.filter(E.filled("cedula_proveedor")).select("nro_sicop", F.col("cedula_proveedor").alias("winner")).distinct().join(t, "nro_sicop", "left_semi")


def bidder_sets(bid: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """nro_sicop, cedula_institucion, members (sorted array): exact bidder sets of tenders with two bidders or more."""
    return sets_of(bidders(bid, tender, w))


def sets_of(b: DataFrame) -> DataFrame:
    """bidder_sets, from the rows of ``bidders``."""
    sets = b.groupBy("nro_sicop").agg(F.first("cedula_institucion").alias("cedula_institucion"), F.array_sort(F.collect_set("cedula_proveedor")).alias("members"))
    return sets.filter(F.size("members") >= 2)


def rotation_groups(bid: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """members (sorted array), tenders: how often each exact bidder set occurs."""
    return groups_of(bidder_sets(bid, tender, w))


def groups_of(sets: DataFrame) -> DataFrame:
    """rotation_groups, from the rows of ``bidder_sets``."""
    return sets.groupBy("members").agg(F.count("*").alias("tenders"))


def rotation(bid: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL, min_tenders: int = 4, min_group: int = 3, min_exclusivity: float = 0.25) -> DataFrame:
    """group_key, group_size, co_bid_tenders, exclusivity, decided_tenders, distinct_winners, evenness, score, institutions.

    Sets are counted first and cut down to candidates; tenders and members are
    looked up for these only, so the work follows the repeated sets.
    """
    b = bidders(bid, tender, w)
    return rotation_of(b, sets_of(b), winners(award, tender, w), min_tenders, min_group, min_exclusivity)


def rotation_of(b: DataFrame, sets: DataFrame, won: DataFrame, min_tenders: int = 4, min_group: int = 3, min_exclusivity: float = 0.25) -> DataFrame:
    """rotation, from the rows of ``bidders``, ``bidder_sets`` and ``winners``."""
    seen = b.groupBy("cedula_proveedor").agg(F.count("*").alias("appearances"))
    groups = groups_of(sets).filter((F.col("tenders") >= min_tenders) & (F.size("members") >= min_group))
    groups = groups.withColumn("group_key", F.array_join("members", "|"))
    parts = groups.select("group_key", "tenders", F.explode("members").alias("cedula_proveedor"))
    exclusive = parts.join(seen, "cedula_proveedor").groupBy("group_key").agg(F.min(F.col("tenders") / F.col("appearances")).alias("exclusivity"))
    where = sets.join(groups.select("members", "group_key"), "members").select("group_key", "nro_sicop", "cedula_institucion")
    places = where.filter(E.filled("cedula_institucion")).groupBy("group_key").agg(F.array_sort(F.collect_set("cedula_institucion")).alias("institutions"))
    cases = where.select("group_key", "nro_sicop").join(won, "nro_sicop")
    decided = cases.groupBy("group_key").agg(F.countDistinct("nro_sicop").alias("decided_tenders"))
    wins = cases.groupBy("group_key", F.col("winner").alias("cedula_proveedor")).agg(F.count("*").alias("wins"))
    even = parts.join(wins, ["group_key", "cedula_proveedor"], "left").withColumn("wins", F.coalesce("wins", F.lit(0))).groupBy("group_key").agg(
        F.sum("wins").alias("total"), F.sum(F.col("wins") * F.col("wins")).alias("squares"), F.count_if(F.col("wins") > 0).alias("distinct_winners"), F.count("*").alias("group_size"))
    out = groups.select("group_key", F.col("tenders").alias("co_bid_tenders")).join(even, "group_key").join(exclusive, "group_key").join(decided, "group_key", "left").join(places, "group_key", "left")
    out = out.withColumn("evenness", S.evenness(F.col("squares"), F.col("total"), F.col("distinct_winners"), F.col("group_size")))
    filled = F.least(F.lit(1.0), F.col("co_bid_tenders") / (2 * min_tenders))
    kept = out.filter((F.col("exclusivity") >= min_exclusivity) & (F.col("distinct_winners") >= 2))
    return kept.select("group_key", F.col("group_size").cast("long").alias("group_size"), "co_bid_tenders", "exclusivity", F.coalesce("decided_tenders", F.lit(0)).alias("decided_tenders"), "distinct_winners", "evenness", (F.coalesce("evenness", F.lit(0.0)) * filled * F.col("exclusivity")).alias("score"), F.coalesce("institutions", F.array().cast("array<string>")).alias("institutions"))


def losing_pairs(bid: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL, min_tenders: int = 5) -> DataFrame:
    """a, b, encounters, a_wins, b_wins: pairs that met on decided tenders that just one of them won.

    Only a winner's encounters count, so each winner meets the tender's losers: the
    rows are winners times losers of a tender, not all pairs of its bidders.
    """
    return pairs_of(bidders(bid, tender, w), winners(award, tender, w), min_tenders)


def pairs_of(b: DataFrame, won: DataFrame, min_tenders: int = 5) -> DataFrame:
    """losing_pairs, from the rows of ``bidders`` and ``winners``."""
    here = b.join(won.select("nro_sicop").distinct(), "nro_sicop", "left_semi")
    marked = here.join(won.withColumnRenamed("winner", "cedula_proveedor").withColumn("won", F.lit(True)), ["nro_sicop", "cedula_proveedor"], "left")
    up = marked.filter("won").select("nro_sicop", F.col("cedula_proveedor").alias("winner"))
    down = marked.filter("won is null").select("nro_sicop", F.col("cedula_proveedor").alias("loser"))
    met = up.join(down, "nro_sicop").groupBy("winner", "loser").agg(F.count("*").alias("n"))
    first = F.col("winner") < F.col("loser")
    pairs = met.groupBy(F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).agg(
        F.sum("n").alias("encounters"), F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("a_wins"), F.coalesce(F.sum(F.when(~first, F.col("n"))), F.lit(0)).alias("b_wins"))
    return pairs.filter(F.col("encounters") >= min_tenders)


def consistent_losing(bid: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL, min_tenders: int = 5, alpha: float = 0.05) -> DataFrame:
    """loser, winner, encounters, winner_wins, p_value, p_adjusted: adjusted over all eligible pairs."""
    return losing_of(losing_pairs(bid, award, tender, w, min_tenders), alpha)


def losing_of(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """consistent_losing, from the rows of ``losing_pairs``."""
    tests = pairs.agg(F.count("*").alias("tests"))  # one row
    a_first = F.col("a_wins") >= F.col("b_wins")
    p = S.binomial_tail(F.greatest("a_wins", "b_wins"), F.col("encounters"))
    # chances depend on (wins, encounters) only: few distinct pairs, but the sum is cheap and stays in one stage
    rated = pairs.select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("loser"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("winner"), "encounters", F.greatest("a_wins", "b_wins").alias("winner_wins"), F.least("a_wins", "b_wins").alias("loser_wins"), p.alias("p_value"))
    out = rated.crossJoin(F.broadcast(tests)).withColumn("p_adjusted", S.bonferroni(F.col("p_value"), F.col("tests")))
    return out.filter(F.col("p_adjusted") <= alpha).select("loser", "winner", "encounters", "winner_wins", "loser_wins", E.ratio("winner_wins", "encounters").alias("loss_rate"), "p_value", "p_adjusted")


def head_to_head(bid: DataFrame, award: DataFrame, tender: DataFrame, pairs: DataFrame, w: Window = ALL) -> DataFrame:
    """a, b, nro_sicop, cedula_institucion: the tenders on which just one of two suppliers (pairs a < b) won."""
    won = winners(award, tender, w)
    b = bidders(bid, tender, w).join(won.select("nro_sicop").distinct(), "nro_sicop", "left_semi")
    marked = b.join(won.withColumnRenamed("winner", "cedula_proveedor").withColumn("won", F.lit(True)), ["nro_sicop", "cedula_proveedor"], "left")
    up = marked.filter("won").select("nro_sicop", "cedula_institucion", F.col("cedula_proveedor").alias("x"))
    down = marked.filter("won is null").select("nro_sicop", F.col("cedula_proveedor").alias("y"))
    met = up.join(down, "nro_sicop").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "nro_sicop", "cedula_institucion")
    return met.join(pairs.select("a", "b"), ["a", "b"], "left_semi")


def losing_evidence(hits: DataFrame, bid: DataFrame, bid_line: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL, most_codes: int = 25) -> DataFrame:
    """hits with tenders, institutions and product codes (the first ``most_codes`` by code) that a pair shares; looked up for hits only."""
    pairs = hits.select(F.least("loser", "winner").alias("a"), F.greatest("loser", "winner").alias("b"))
    met = head_to_head(bid, award, tender, pairs, w)
    where = met.groupBy("a", "b").agg(F.array_sort(F.collect_set("nro_sicop")).alias("tenders"), F.array_sort(F.collect_set("cedula_institucion")).alias("institutions"))
    offers = bid.filter(E.filled("cedula_proveedor")).select("nro_sicop", "nro_oferta", "cedula_proveedor")
    goods = bid_line.filter(E.filled("codigo_producto")).select("nro_sicop", "nro_oferta", "codigo_producto").join(offers, ["nro_sicop", "nro_oferta"])
    sides = met.select("a", "b", "nro_sicop", F.explode(F.array("a", "b")).alias("cedula_proveedor"))
    codes = sides.join(goods, ["nro_sicop", "cedula_proveedor"]).groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_set("codigo_producto")), 1, most_codes).alias("codes"))
    mine = hits.withColumn("a", F.least("loser", "winner")).withColumn("b", F.greatest("loser", "winner"))
    none = F.array().cast("array<string>")
    return mine.join(where, ["a", "b"], "left").join(codes, ["a", "b"], "left").drop("a", "b").withColumn("codes", F.coalesce("codes", none))


#: Columns on which a winning and a losing line have to agree, beside the tender.
SAME_LINE = ("nro_linea", "codigo_producto", "moneda")


def spread_lines(bid: DataFrame, bid_line: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL, same: Sequence[str] = SAME_LINE) -> DataFrame:
    """nro_sicop, nro_linea, winner, loser, gap_pct: lost bids priced at the winning one or above."""
    won = latest_award_lines(award).filter((F.col("precio_unitario") > 0) & F.col("cedula_proveedor").isNotNull())
    t = (tender.filter(w.tender()) if w.filters() else tender).select("nro_sicop")
    on = ["nro_sicop", *same]
    won = won.join(t, "nro_sicop", "left_semi").select(*on, F.col("nro_oferta").alias("won_offer"), F.col("cedula_proveedor").alias("winner"), F.col("precio_unitario").alias("won_price"))
    offers = bid.filter(F.col("cedula_proveedor").isNotNull()).select("nro_sicop", "nro_oferta", F.col("cedula_proveedor").alias("loser"))
    lost = bid_line.filter(F.col("precio_unitario") > 0).select(*on, "nro_oferta", F.col("precio_unitario").alias("price")).join(offers, ["nro_sicop", "nro_oferta"])
    met = won.join(lost, on).filter("nro_oferta <> won_offer and loser <> winner and price >= won_price")
    return met.select("nro_sicop", "nro_linea", "winner", "loser", ((F.col("price") - F.col("won_price")) / F.col("won_price") * 100).alias("gap_pct"))


def bid_spread(bid: DataFrame, bid_line: DataFrame, award: DataFrame, tender: DataFrame, w: Window = ALL, min_tenders: int = 5, keep_unscored: bool = False, same: Sequence[str] = SAME_LINE, most_gaps: int = 20) -> DataFrame:
    """winner, loser, lines, tenders, median_gap, mean_gap, cv, score, gaps: stable gaps over enough tenders.

    gaps are the first ``most_gaps`` lines of a pair by tender and line; they are kept
    apart while aggregating, so a pair never gathers more than that.
    """
    return spread_of(spread_lines(bid, bid_line, award, tender, w, same), min_tenders, keep_unscored, most_gaps)


def spread_of(rows: DataFrame, min_tenders: int = 5, keep_unscored: bool = False, most_gaps: int = 20) -> DataFrame:
    """bid_spread, from the rows of ``spread_lines``."""
    by = rows.groupBy("winner", "loser").agg(F.count("*").alias("lines"), F.countDistinct("nro_sicop").alias("tenders"), F.percentile("gap_pct", F.lit(0.5)).alias("median_gap"), F.avg("gap_pct").alias("mean_gap"), S.variation("gap_pct").alias("cv"))
    stable = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.2 - F.col("cv")) / 0.12)), F.lit(0.0))
    out = by.filter((F.col("tenders") >= min_tenders) & (F.col("median_gap") >= 0.5)).withColumn("score", stable * F.least(F.lit(1.0), F.col("tenders") / (2 * min_tenders)))
    kept = out if keep_unscored else out.filter("score > 0")
    turn = F.row_number().over(Turn.partitionBy("winner", "loser").orderBy("nro_sicop", "nro_linea", "gap_pct"))
    first = rows.join(kept.select("winner", "loser"), ["winner", "loser"], "left_semi").withColumn("n", turn).filter(F.col("n") <= most_gaps)
    gaps = first.groupBy("winner", "loser").agg(F.array_sort(F.collect_list(F.struct("n", "nro_sicop", "nro_linea", "gap_pct"))).alias("gaps"))
    return kept.join(gaps, ["winner", "loser"], "left")


def sole_bid_pairs(bid: DataFrame, award: DataFrame, tender: DataFrame, institution: DataFrame, w: Window = ALL, min_tenders: int = 3) -> DataFrame:
    """cedula_proveedor, cedula_institucion, nombre, sole_bids, sole_wins, both shares, score."""
    return sole_of(bidders(bid, tender, w), winners(award, tender, w), institution, min_tenders)


def sole_of(all_bidders: DataFrame, winning: DataFrame, institution: DataFrame, min_tenders: int = 3) -> DataFrame:
    """sole_bid_pairs, from the rows of ``bidders`` and ``winners``."""
    b = all_bidders.filter(E.filled("cedula_institucion"))
    count = b.groupBy("nro_sicop").agg(F.count("*").alias("n"))
    won = winning.select("nro_sicop", F.col("winner").alias("cedula_proveedor"), F.lit(True).alias("won"))
    marked = b.join(count, "nro_sicop").join(won, ["nro_sicop", "cedula_proveedor"], "left")
    sole = F.col("n") == 1
    pairs = marked.groupBy("cedula_proveedor", "cedula_institucion").agg(F.count("*").alias("total"), F.count_if(sole).alias("sole_bids"), F.count_if(sole & F.col("won")).alias("sole_wins"))
    singles = marked.groupBy("cedula_institucion").agg(F.count_if(sole).alias("institution_singles"))
    kept = pairs.filter(F.col("sole_bids") >= min_tenders).join(singles, "cedula_institucion").join(institution.select(F.col("cedula").alias("cedula_institucion"), "nombre"), "cedula_institucion", "left")
    here, mine = E.ratio("sole_bids", "institution_singles"), E.ratio("sole_bids", "total")
    return kept.select("cedula_proveedor", "cedula_institucion", "nombre", "sole_bids", "sole_wins", "institution_singles", F.col("total").alias("supplier_tenders"), here.alias("share_of_institution"), mine.alias("share_of_supplier"), F.sqrt(here * mine).alias("score"))


#: How the hits of each screen are listed: best first, ties by their keys.
ORDER = {
    "bid-rotation": (F.desc, ("score", "co_bid_tenders"), ("group_key",)),
    "consistent-losing": (F.asc, ("p_adjusted",), ("loser", "winner")),
    "bid-spread": (F.desc, ("score", "lines"), ("winner", "loser")),
    "single-bidder-concentration": (F.desc, ("score", "sole_bids"), ("cedula_proveedor", "cedula_institucion")),
}


def listed(screen: str, hits: DataFrame, limit: int = 25) -> DataFrame:
    """The first hits of a screen, best first."""
    way, by, ties = ORDER[screen]
    return hits.orderBy(*[way(c) for c in by], *ties).limit(limit)


def report(bid: DataFrame, bid_line: DataFrame, award: DataFrame, tender: DataFrame, institution: DataFrame, w: Window = ALL, **guards) -> DataFrame:
    """screen, population, tests, hits, missing: a row for each screen, with the number of tenders or lines it looked at and of comparisons made.

    Bidders, winners, bidder sets, pairs and lines are written once; all screens read them.
    Without tenders or bids every count is 0, and missing names the empty tables.
    """
    lacking = ",".join(name for name, df in (("tender", tender), ("bid", bid)) if not df.limit(1).count())
    spark = bid.sparkSession
    if lacking:
        return spark.createDataFrame([(s, 0, 0, 0, lacking) for s in ORDER], "screen string, population long, tests long, hits long, missing string")
    losing, spread = dict(guards.get("losing", {})), dict(guards.get("spread", {}))
    b = written(bidders(bid, tender, w), "bidders")
    won = written(winners(award, tender, w), "winners")
    sets = written(sets_of(b), "bidder-sets")
    pairs = written(pairs_of(b, won, losing.pop("min_tenders", 5)), "losing-pairs")
    lines = written(spread_lines(bid, bid_line, award, tender, w, spread.pop("same", SAME_LINE)), "spread-lines")
    size = b.groupBy("nro_sicop").agg(F.count("*").alias("n"))
    here = b.filter(E.filled("cedula_institucion")).select("cedula_proveedor", "cedula_institucion").distinct()
    parts = {
        "bid-rotation": (sets, groups_of(sets), rotation_of(b, sets, won, **guards.get("rotation", {}))),
        "consistent-losing": (sets.join(won, "nro_sicop", "left_semi"), pairs, losing_of(pairs, **losing)),
        "bid-spread": (lines, lines.select("winner", "loser").distinct(), spread_of(lines, **spread)),
        "single-bidder-concentration": (size, here, sole_of(b, won, institution, **guards.get("sole", {}))),
    }
    out = None
    for screen, (population, tests, hits) in parts.items():
        row = population.agg(F.lit(screen).alias("screen"), F.count("*").alias("population")).crossJoin(F.broadcast(tests.agg(F.count("*").alias("tests")))).crossJoin(F.broadcast(hits.agg(F.count("*").alias("hits"))))  # one row each
        out = row if out is None else out.unionByName(row)
    return out.withColumn("missing", F.lit(""))
