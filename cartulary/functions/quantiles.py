"""Exact quantiles of groups of any size.

Groups with few rows use Spark's percentile, which holds a group's distinct values in one task.
Hot groups are searched by refining histograms: of every rank that is asked for
the interval is known in which its value lies; rows within it are counted in BINS equal
bins with their least and greatest value, and the bin that holds the rank is the next interval, until
it has one value. Counts are combined before the shuffle, so a task never holds more than
bins; what the driver keeps is two numbers for each rank of at most a thousand groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions.stats import finite
from cartulary.storage import written

HOT = 1_000_000
BINS = 1024


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: Sequence[float], hot: int = HOT) -> DataFrame:
    """keys, n, q: number of finite values and their quantiles (type 7, in order of the shares) of every group; null without values."""
    data = rows.select(*keys, finite(value).cast("double").alias("v"))
    small = [F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")]
    held = written(data, "values")
    total = held.count()
    if total < hot:
        return held.groupBy(*keys).agg(*small)
    sizes = written(held.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).filter(F.col("n") >= max(hot, total // 1000)), "hot-groups")
    groups = [r.asDict() for r in sizes.collect()]  # a thousand at most
    if not groups:
        return held.groupBy(*keys).agg(*small)
    large = held.sparkSession.createDataFrame([(g, *[r[k] for k in keys]) for g, r in enumerate(groups)], sizes.select(F.lit(0).alias("g"), *[F.col(k).alias(f"__{k}") for k in keys]).schema)
    meet = F.lit(True)
    for k in keys:
        meet &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    rest = held.join(F.broadcast(large), meet, "left_anti").groupBy(*keys).agg(*small)
    many = held.filter("v is not null").join(F.broadcast(large), meet).select("g", "v")
    ranks = {(g, s): (r["n"] - 1) * s for g, r in enumerate(groups) for s in shares}
    asked = sorted({(g, k) for (g, _), at in ranks.items() for k in (math.floor(at), math.ceil(at))})
    found = ranked(many, [(g, k, groups[g]["low"], groups[g]["high"]) for g, k in asked])
    out = []
    for g, r in enumerate(groups):
        q = []
        for s in shares:
            at = ranks[g, s]
            low, high = found[g, math.floor(at)], found[g, math.ceil(at)]
            q.append(low + (high - low) * (at - math.floor(at)))
        out.append((*[r[k] for k in keys], r["n"], q))
    return rest.unionByName(held.sparkSession.createDataFrame(out, rest.schema))


def ranked(rows: DataFrame, asked: list[tuple[int, int, float, float]]) -> dict[tuple[int, int], float]:
    """The value of each rank (from 0) of the groups that are asked for; rows have g and v, a request (g, rank, least, greatest value)."""
    spark, done = rows.sparkSession, {}
    # group, rank, rank among the rows of the interval, and the interval
    state = [(g, k, k, low, high) for g, k, low, high in asked]
    while True:
        done |= {(g, k): low for g, k, _, low, high in state if low == high}
        state = [s for s in state if s[3] < s[4]]
        if not state:
            return done
        # equal intervals of a group are counted once
        intervals = sorted({(g, low, high) for g, _, _, low, high in state})
        known = spark.createDataFrame(intervals, "ig int, low double, high double")
        inside = rows.join(F.broadcast(known), (F.col("g") == F.col("ig")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        # halves, so that no difference of two doubles overflows
        place = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS
        bins = inside.groupBy("g", "low", "high", F.least(F.lit(BINS - 1), F.floor(place).cast("int")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        up_to = F.sum("c").over(W.partitionBy("g", "low", "high").orderBy("bin"))
        sums = bins.withColumn("after", up_to)
        wanted = spark.createDataFrame([(g, k, r, low, high) for g, k, r, low, high in state], "g int, k long, r long, low double, high double")
        hit = sums.join(F.broadcast(wanted), ["g", "low", "high"]).filter("r < after and r >= after - c")
        state = [(x["g"], x["k"], x["r"] - (x["after"] - x["c"]), x["least"], x["most"]) for x in hit.collect()]
