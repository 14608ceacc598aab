"""Institutions against their peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import stats as S
from cartulary.operators import occurrences
from cartulary.storage import written

QUARTILES = (("peer_p25", 0.25), ("peer_median", 0.5), ("peer_p75", 0.75))

#: Metric, its value's column and its number of observations.
METRICS = (
    ("single_bidder_rate", "single_bidder_rate", "tenders_with_bids"),
    ("exception_rate", "substantive_rate", "tenders_published"),
    ("deserted_rate", "deserted_rate", "deserted_n"),
    ("publication_to_award_days", "award_median", "award_n"),
    ("award_to_payment_days", "payment_median", "payment_n"),
)


def metrics(competition: DataFrame, durations: DataFrame) -> DataFrame:
    """cedula_institucion, nombre, tenders_published, metric, value, n: a row for each metric of each institution.

    The number of resolved tenders is recovered from the deserted rate; at rate 0
    it is 0, so institutions without deserted tenders are left out, as published reports do.
    """
    deserted_n = F.when(F.col("deserted_rate") > 0, F.round(F.col("no_award") / F.col("deserted_rate")).cast("long")).otherwise(F.col("no_award"))
    both = competition.withColumn("deserted_n", deserted_n).join(durations.drop("nombre"), "cedula_institucion", "left")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(v).cast("double").alias("value"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for m, v, n in METRICS])
    return both.select("cedula_institucion", "nombre", "tenders_published", F.explode(rows).alias("m")).select("cedula_institucion", "nombre", "tenders_published", "m.*")


def _bin(volume: Column) -> Column:
    """Bins of doubling width; larger volumes never lie in lower bins."""
    return F.floor(F.log2(volume.cast("double"))).cast("int")


def _banded_counts(volumes: DataFrame, band: float) -> DataFrame:
    """volume, low, high, banded: how many other institutions lie in a volume's band, from counts of equal volumes."""
    counts = written(volumes.groupBy("volume").agg(F.count("*").alias("holders")), "volumes")
    low, high = F.greatest(F.lit(1), F.floor(F.col("volume") / band)), F.ceil(F.col("volume") * band)
    bands = counts.select("volume", low.cast("long").alias("low"), high.cast("long").alias("high"))
    there = counts.filter("volume > 0").select(F.col("volume").alias("other"), "holders", _bin(F.col("volume")).alias("bin"))
    met = bands.filter("high >= low").withColumn("bin", F.explode(F.sequence(_bin(F.col("low")), _bin(F.col("high"))))).join(there, "bin").filter("other between low and high")
    sums = met.groupBy("volume").agg(F.sum("holders").alias("held"))
    own = F.when((F.col("volume") >= F.col("low")) & (F.col("volume") <= F.col("high")), 1).otherwise(0)
    return bands.join(sums, "volume", "left").select("volume", "low", "high", (F.coalesce("held", F.lit(0)) - own).alias("banded"))


def _among_banded(mine: DataFrame, values: DataFrame) -> DataFrame:
    """subject, metric and the peers' statistics, for subjects that are compared within their band: they meet the bins that it touches."""
    at = mine.filter("in_band").withColumn("bin", F.explode(F.sequence(_bin(F.col("low")), _bin(F.col("high")))))
    there = values.filter("peer_volume > 0").withColumn("bin", _bin(F.col("peer_volume")))
    met = at.join(there, ["metric", "bin"]).filter((F.col("peer_volume") >= F.col("low")) & (F.col("peer_volume") <= F.col("high")) & (F.col("subject") != F.col("peer")))
    stats = met.groupBy("subject", "metric").agg(*S.summary("peer_value", "peer_"), F.count_if(F.col("peer_value") < F.col("value")).alias("below"), F.count_if(F.col("peer_value") == F.col("value")).alias("equal"))
    return stats.select("subject", "metric", "peer_n", "peer_p25", "peer_median", "peer_p75", "below", "equal")


def _among_all(mine: DataFrame, values: DataFrame) -> DataFrame:
    """The same for subjects that are compared with all others: places in the order of a metric's values, without the subject's own."""
    sized = written(occurrences.numbered(values.filter(S.finite("peer_value").isNotNull()), ["metric"], "peer_value", "place"), "places")
    groups = sized.groupBy("metric", "peer_value").agg((F.min("place") - 1).alias("below"), F.count("*").alias("alike"))
    totals = sized.groupBy("metric").agg(F.count("*").alias("n_values"))
    own = sized.select(F.col("peer").alias("subject"), "metric", (F.col("place") - 1).alias("own_place"))
    asked = mine.filter("not in_band").join(F.broadcast(totals), "metric").join(own, ["subject", "metric"], "left")  # a row per metric
    asked = asked.withColumn("peer_n", F.col("n_values") - F.when(F.col("own_place").isNull(), 0).otherwise(1)).filter("peer_n > 0")
    spots = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("peer_n") - 1) * p).alias("at")) for name, p in QUARTILES])
    each = asked.select("subject", "metric", "own_place", F.explode(spots).alias("s")).select("subject", "metric", "own_place", "s.*")
    ends = each.withColumn("k", F.explode(F.array(F.floor("at"), F.floor("at") + 1)))
    # a place from the subject's own on is one further in the whole order
    place = F.col("k") + F.when(F.col("k") >= F.col("own_place"), 1).otherwise(0) + 1
    weight = F.when(F.col("k") > F.col("at"), F.col("at") - F.floor("at")).otherwise(1 - (F.col("at") - F.floor("at")))
    found = ends.withColumn("place", place.cast("long")).withColumn("weight", weight).filter("weight > 0").join(sized.select("metric", "place", "peer_value"), ["metric", "place"])
    wide = found.groupBy("subject", "metric").agg(*[F.sum(F.when(F.col("name") == name, F.col("weight") * F.col("peer_value"))).alias(name) for name, _ in QUARTILES])
    against = asked.join(groups.withColumnRenamed("peer_value", "value"), ["metric", "value"], "left")
    equal = F.col("alike") - F.when(F.col("own_place").isNull(), 0).otherwise(1)
    return against.select("subject", "metric", "peer_n", "below", equal.alias("equal")).join(wide, ["subject", "metric"]).select("subject", "metric", "peer_n", *[n for n, _ in QUARTILES], "below", "equal")


def benchmark(long: DataFrame, band: float = 2, min_peers: int = 5, min_sample: int = 20, all_peers: bool = False) -> DataFrame:
    """Every metric of every institution with its peers' quartiles and its standing (1 is the good end).

    Peers have between 1/band and band times the institution's tenders, or are all
    others if those are too few. Within a band subjects and peers meet by bins of
    volume; against all others a subject's numbers follow from the metric's order.
    """
    long = written(long, "metrics")
    volumes = long.select("cedula_institucion", F.col("tenders_published").alias("volume")).distinct()
    in_band = (F.col("banded") >= min_peers) & F.lit(not all_peers)
    subjects = volumes.join(_banded_counts(volumes, band), "volume").select(F.col("cedula_institucion").alias("subject"), "low", "high", in_band.alias("in_band"))
    values = long.filter((F.col("n") >= min_sample) & F.col("value").isNotNull()).select(F.col("cedula_institucion").alias("peer"), "metric", F.col("value").alias("peer_value"), F.col("tenders_published").alias("peer_volume"))
    mine = long.select(F.col("cedula_institucion").alias("subject"), "nombre", "metric", "value", "n")
    asked = written(mine.select("subject", "metric", "value").join(subjects, "subject"), "asked")
    stats = _among_banded(asked, values).unionByName(_among_all(asked, values))
    out = mine.join(stats, ["subject", "metric"], "left").withColumn("peer_n", F.coalesce("peer_n", F.lit(0)).cast("long"))
    why = F.when(F.col("value").isNull(), "no-value").when(F.col("n") < min_sample, "few-observations").when(F.col("peer_n") < min_peers, "few-peers")
    share = F.when(why.isNull(), (F.col("below") + F.col("equal") / 2) / F.col("peer_n"))
    return out.select(F.col("subject").alias("cedula_institucion"), "nombre", "metric", "value", "n", "peer_n", "peer_p25", "peer_median", "peer_p75", why.alias("suppressed"), share.alias("percentile"), (1 - share).alias("standing"))


def ranking(long: DataFrame, metric: str, min_sample: int = 20) -> DataFrame:
    """Institutions by one metric, highest first."""
    rows = long.filter((F.col("metric") == metric) & (F.col("n") >= min_sample) & F.col("value").isNotNull())
    return rows.orderBy(F.desc("value"), "cedula_institucion").select("cedula_institucion", "nombre", "tenders_published", "value", "n")
