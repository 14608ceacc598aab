"""Statistics as aggregate and scalar Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Makes the median absolute deviation comparable to a standard deviation.
MAD_SCALE = 1.4826


def finite(c: str | Column) -> Column:
    """The value, null if it isn't a finite number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def summary(c: str | Column, prefix: str = "") -> list[Column]:
    """n, min, p25, median, p75, p90, max of the finite values; quantiles interpolate linearly (type 7)."""
    x = finite(c)
    q = F.percentile(x, F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75, 0.9))))
    return [F.count(x).alias(f"{prefix}n"), F.min(x).alias(f"{prefix}min"), *(q[k].alias(f"{prefix}{name}") for k, name in enumerate(("p25", "median", "p75", "p90"))), F.max(x).alias(f"{prefix}max")]


def mad(df: DataFrame, keys: list[str], value: str, center: str = "median") -> DataFrame:
    """keys, median and the scaled median absolute deviation of each group; two passes over one exchange."""
    middle = df.groupBy(*keys).agg(F.percentile(F.col(value), F.lit(0.5)).alias(center))
    both = df.select(*keys, value).join(middle, keys)
    return both.groupBy(*keys).agg(F.first(center).alias(center), (F.percentile(F.abs(F.col(value) - F.col(center)), F.lit(0.5)) * MAD_SCALE).alias("mad"))


def wilson_low(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval; null without trials."""
    return F.when(n > 0, F.greatest(F.lit(0.0), _wilson(k, n, z, -1)))


def wilson_high(k: Column, n: Column, z: float = 1.96) -> Column:
    """Upper end of the Wilson interval; null without trials."""
    return F.when(n > 0, F.least(F.lit(1.0), _wilson(k, n, z, 1)))


def _wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    p, m = k.cast("double") / n, n.cast("double")
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return (p + z * z / (2 * m) + sign * half) / (1 + z * z / m)


def hhi(df: DataFrame, value: str) -> DataFrame:
    """One row: groups, total, hhi, top_share, effective (10,000 / hhi) of the positive values."""
    x = F.when(F.col(value) > 0, F.col(value))
    sums = df.agg(F.count(x).alias("groups"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.sum(x * x).alias("squares"), F.max(x).alias("top"))
    index = F.when(F.col("total") > 0, F.col("squares") / (F.col("total") * F.col("total")) * 10000)
    return sums.select("groups", "total", index.alias("hhi"), F.when(F.col("total") > 0, F.col("top") / F.col("total")).alias("top_share"), F.when(index > 0, 10000 / index).alias("effective"))


def evenness(squares: Column, total: Column, positive: Column, slots: Column) -> Column:
    """(1 - sum of squared shares) / (1 - 1/k) with k = max(slots, positive values); null without values."""
    k = F.greatest(slots, positive)
    return F.when(total <= 0, None).when(k <= 1, 0.0).when(total > 0, (1 - squares / (total * total)) / (1 - 1 / k))


def variation(c: str) -> Column:
    """Sample standard deviation over the mean's size; null under two values or at mean 0."""
    mean = F.avg(c)
    return F.when((F.count(c) >= 2) & (mean != 0), F.stddev_samp(c) / F.abs(mean))


#: Points of the Gauss-Legendre rule that integrates a tail; 64 are exact for polynomials up to degree 127.
POINTS = 64
#: Integrands are followed until they have fallen by so many powers of e.
FALL = 46.0
#: Tails of up to so many tosses are sums of their terms.
FEW = 64


def _stirling_rest(m: Column) -> Column:
    """ln m! less Stirling's formula, for whole numbers from 1 on."""
    exact = F.ln(F.factorial(F.least(m, F.lit(_STIRLING)).cast("int")).cast("double")) - ((m + 0.5) * F.ln(m) - m + 0.5 * F.ln(2 * F.pi()))
    return F.when(m <= _STIRLING, exact).otherwise(1 / (12 * m) - 1 / (360 * F.pow(m, F.lit(3.0))) + 1 / (1260 * F.pow(m, F.lit(5.0))) - 1 / (1680 * F.pow(m, F.lit(7.0))))


def _fair_tail_above(k: Column, n: Column) -> Column:
    """P(X >= k) of n fair tosses, for 2k > n; all doubles."""
    d, c = (2 * k - n) / n, 2 * k - n - 1
    # chance of exactly k heads: near-equal large terms meet inside log1p and atanh, never as a difference
    away = n / 2 * F.log1p(-d * d) + n * d * F.atanh(d)
    inner = F.exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - away) * F.sqrt(n / (2 * F.pi() * k * (n - k)))
    exactly = F.when(k == n, F.pow(F.lit(2.0), -n)).otherwise(inner)
    # the tail is k times that, times the integral of (1 - w)^(k - 1) (1 + w)^(n - k) over [0, 1], which falls from 1
    end = F.when(n > 1, F.least(F.lit(1.0), (F.sqrt(c * c + 2 * FALL * (n - 1)) - c) / (n - 1))).otherwise(1.0)
    x, w = np.polynomial.legendre.leggauss(POINTS)
    points = F.array(*[F.struct(F.lit(float((at + 1) / 2)).alias("x"), F.lit(float(weight / 2)).alias("w")) for at, weight in zip(x, w, strict=True)])

    def add(acc: Column, p: Column) -> Column:
        at = p["x"] * end
        return acc + p["w"] * F.exp((n - 1) / 2 * F.log1p(-at * at) - c * F.atanh(at))

    return exactly * k * end * F.aggregate(points, F.lit(0.0), add)


def _few_tosses_tail(k: Column, n: Column) -> Column:
    """P(X >= k) of up to FEW fair tosses: the terms, from the last one on, by their logarithms."""
    logs = F.array(*[F.lit(math.log(math.factorial(i)) if i < 7 else _log_gamma(i + 1.0, math.log)) for i in range(FEW + 1)])

    def at(i: Column) -> Column:
        return F.get(logs, i.cast("int"))

    return F.aggregate(F.sequence(n, k, F.lit(-1)), F.lit(0.0), lambda acc, i: acc + F.exp(at(n) - at(i) - at(n - i) - n * math.log(2)))


def binomial_tail(k: Column, n: Column) -> Column:
    """Chance of k or more heads in n fair tosses, in a bounded number of steps for any n.

    The tail is the regularised incomplete beta function at a half, I(k, n - k + 1),
    taken as an integral that POINTS points give to about 1e-13 of its size. (Its continued fraction
    needs some sqrt(n) steps near the middle.) The lower half follows by symmetry.
    Up to FEW tosses the terms are added: these tails can be exact halves of a rounded
    digit (7 of 7 is 0.0078125), which then go the way of the SQL's sum.
    """
    kd, nd = k.cast("double"), n.cast("double")
    upper = 2 * kd > nd
    tail = _fair_tail_above(F.when(upper, kd).otherwise(nd - kd + 1), nd)
    known = F.when((n <= 0) | (k <= 0), 1.0).when(k > n, 0.0).when(n <= FEW, F.least(F.lit(1.0), _few_tosses_tail(k.cast("int"), n.cast("int"))))
    return known.when(upper, F.least(F.lit(1.0), tail)).otherwise(F.greatest(F.lit(0.0), 1 - tail))


#: From here on Stirling's series gives the factorial's logarithm to double precision.
_STIRLING = 16
#: Factors of the odd powers of 1/x in Stirling's series of the gamma function's logarithm; from x = 8 on the rest is under 1e-16.
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156, -3617 / 122400)


def _log_gamma(x: Column | float, ln: Callable) -> Column | float:
    """Logarithm of the gamma function for x from 8 on, of a column or of a number."""
    z = 1 / x
    y, rest = z * z, _SERIES[-1]
    for factor in _SERIES[-2::-1]:
        rest = rest * y + factor
    return (x - 0.5) * (ln(x) - 1) + (z * rest + (0.5 * math.log(2 * math.pi) - 0.5))


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers from 0 on: of the product up to 6!, then Stirling's series."""
    small = F.ln(F.factorial(F.least(n, F.lit(6)).cast("int")).cast("double"))
    return F.when(n < 0, None).when(n < 7, small).otherwise(_log_gamma(n.cast("double") + 1, F.ln))


def log_choose(n: Column, k: Column) -> Column:
    """ln of the number of ways to choose k of n; null if there is none."""
    return F.when((k >= 0) & (k <= n), log_factorial(n) - log_factorial(k) - log_factorial(n - k))


def binomial_tail_at(k: Column, n: Column, p: Column | float) -> Column:
    """Chance of k or more successes in n trials of chance p.

    The first term comes from logarithms, the others from their ratios, so any
    number of trials works; the sum runs from the side of the tail that has its
    largest term first.
    """
    p = F.lit(p) if isinstance(p, float) else p
    odds = p / (1 - p)

    def total(a: Column, b: Column, up: bool) -> Column:
        # sum of the terms from a on, to b
        start = F.exp(log_choose(n, a) + a * F.ln(p) + (n - a) * F.ln(1 - p))

        def term(acc: Column, i: Column) -> Column:
            ratio = (n - i) / (i + 1) * odds if up else i / (n - i + 1) / odds
            return F.struct((acc["sum"] + acc["at"]).alias("sum"), (acc["at"] * ratio).alias("at"))

        steps = F.sequence(a, b) if up else F.sequence(a, b, F.lit(-1))
        return F.aggregate(steps, F.struct(F.lit(0.0).alias("sum"), start.alias("at")), term, lambda acc: acc["sum"])

    upper = k.cast("double") > n * p
    inside = F.when(upper, total(k.cast("int"), n.cast("int"), True)).otherwise(1 - total((k - 1).cast("int"), F.lit(0), False))
    return F.when((n <= 0) | (k <= 0), 1.0).when((k > n) | (p <= 0), 0.0).when(p >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside)))


def bonferroni(p: Column, tests: Column) -> Column:
    """p times the number of tests, at most 1."""
    return F.least(F.lit(1.0), p * F.greatest(F.lit(1), tests))


def kaplan_meier(df: DataFrame, keys: list[str], time: str, completed: str, cases: str | None = None) -> DataFrame:
    """keys, n, events, censored, km_median, reached: the first time at which survival is at most a half.

    A row stands for as many cases as the column ``cases`` says, else for one.

    Times are pre-aggregated, so windows run over distinct times. Survival is a
    true product: a last factor of 0 makes it 0.
    """
    one = F.col(cases) if cases else F.lit(1)
    steps = df.groupBy(*keys, time).agg(F.sum(F.col(completed).cast("long") * one).alias("d"), F.sum(one).alias("c"))
    at_risk = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    risk = steps.withColumn("risk", F.sum("c").over(at_risk))
    so_far = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    curve = risk.withColumn("s", F.product(1 - F.col("d") / F.col("risk")).over(so_far))
    out = curve.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("d").alias("events"), F.min(F.when(F.col("s") <= 0.5, F.col(time))).alias("km_median"))
    return out.select(*keys, "n", "events", (F.col("n") - F.col("events")).alias("censored"), "km_median", F.col("km_median").isNotNull().alias("reached"))


def percentile_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with rank_share: the share of the other rows of its group below it, ties counting half."""
    low = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    others = F.count("*").over(Window.partitionBy(*keys)) - 1
    below = F.rank().over(low) - 1
    ties = F.count("*").over(same) - 1
    return df.withColumn("rank_share", F.when(others > 0, (below + ties / 2) / others))


