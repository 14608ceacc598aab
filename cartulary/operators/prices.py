"""Unit-price benchmarks of all product codes at once: guards, fence, outliers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.functions.exprs import ALL, Window


@dataclass(frozen=True)
class Rules:
    """Thresholds of the guards and of the outlier fence."""

    currency: str = "CRC"
    min_sample: int = 10
    max_iqr_ratio: float = 10
    max_spread: float = 1000
    most_decades: int = 3
    most_span: int = 2
    decade_share: float = 0.05
    lump_sum_share: float = 0.8
    min_ratio: float = 1.5
    cutoff: float = 3.5
    mad_scale: float = 0.6745
    mean_scale: float = 1.253314


RULES = Rules()


def scoped_lines(lines: DataFrame, tender: DataFrame, w: Window = ALL) -> DataFrame:
    """Lines with a product code, joined to their tender where there is one; the month is the line's, the rest the tender's."""
    t = tender.select("nro_sicop", "cedula_institucion", E.iso_date("fecha_publicacion").alias("fecha"))
    rows = lines.filter(E.filled("codigo_producto"))
    if w.month:
        rows = rows.filter(F.col("source_month") == w.month)
    joined = rows.join(t, "nro_sicop", "left")
    side = Window(w.from_, w.to, None, w.institution)
    if not side.filters():
        return joined
    out = side.dates("fecha")
    return joined.filter(out & (F.col("cedula_institucion") == w.institution) if w.institution else out)


def price_rows(lines: DataFrame, tender: DataFrame, rules: Rules = RULES, w: Window = ALL) -> DataFrame:
    """Usable lines: in the currency, with a positive price and quantity."""
    return scoped_lines(lines, tender, w).filter((F.col("moneda") == rules.currency) & (F.col("precio_unitario") > 0) & (F.col("cantidad") > 0))


def with_supplier(rows: DataFrame, bid: DataFrame | None = None) -> DataFrame:
    """Price rows or outliers with cedula_proveedor: their own (award lines), or that of their offer (bid lines and bid).

    Offers are keyed by (nro_sicop, nro_oferta), so a row meets one at most.
    """
    if bid is None:
        return rows
    offers = bid.groupBy("nro_sicop", "nro_oferta").agg(F.min("cedula_proveedor").alias("cedula_proveedor"))
    return rows.drop("cedula_proveedor").join(offers, ["nro_sicop", "nro_oferta"], "left")


def exclusions(lines: DataFrame, tender: DataFrame, rules: Rules = RULES, w: Window = ALL) -> DataFrame:
    """codigo_producto, other_currency, non_positive, missing; a line may count in several."""
    mine = F.col("moneda").eqNullSafe(rules.currency)
    low = (F.col("precio_unitario") <= 0) | (F.col("cantidad") <= 0)
    gone = F.col("precio_unitario").isNull() | F.col("cantidad").isNull()
    return scoped_lines(lines, tender, w).groupBy("codigo_producto").agg(F.count_if(~mine).alias("other_currency"), F.count_if(mine & low).alias("non_positive"), F.count_if(mine & gone).alias("missing"))


def magnitude(rows: DataFrame, rules: Rules = RULES) -> DataFrame:
    """codigo_producto, decades (powers of ten with enough of the sample), decade_span."""
    per = rows.groupBy("codigo_producto", E.decade("precio_unitario").alias("decade")).agg(F.count("*").alias("c"))
    share = per.withColumn("share", F.col("c") / F.sum("c").over(W.partitionBy("codigo_producto")))
    d = F.when(F.col("share") >= rules.decade_share, F.col("decade"))
    return share.groupBy("codigo_producto").agg(F.count(d).alias("decades"), F.coalesce(F.max(d) - F.min(d), F.lit(0)).alias("decade_span"))


def price_stats(rows: DataFrame) -> DataFrame:
    """Summary of unit prices per code, with dispersion measures."""
    base = rows.groupBy("codigo_producto").agg(*S.summary("precio_unitario"), F.avg((F.col("cantidad") == 1).cast("double")).alias("quantity_one"))
    iqr = E.ratio("p75", "p25")
    return base.select("*", iqr.alias("iqr_ratio"), E.ratio("max", "min").alias("spread"), E.ratio(F.col("p75") - F.col("p25"), F.col("p75") + F.col("p25")).alias("quartile_dispersion"), E.dispersion(iqr).alias("dispersion"))


def fences(rows: DataFrame, rules: Rules = RULES) -> DataFrame:
    """codigo_producto, median, mad, mean_ad, fence, rule of each code.

    The scaled deviation is divided by 0.6745 once more, so that fences equal those of published reports.
    """
    middle = S.mad(rows, ["codigo_producto"], "precio_unitario")
    ad = rows.join(middle, "codigo_producto").groupBy("codigo_producto").agg(F.first("median").alias("median"), F.first("mad").alias("mad"), F.avg(F.abs(F.col("precio_unitario") - F.col("median"))).alias("mean_ad"))
    by_mad, by_mean = F.col("mad") > 0, F.col("mean_ad") > 0
    fence = F.when(by_mad, F.col("median") + rules.cutoff * F.col("mad") / rules.mad_scale).when(by_mean, F.col("median") + rules.cutoff * rules.mean_scale * F.col("mean_ad"))
    return ad.select("codigo_producto", "median", "mad", "mean_ad", fence.alias("fence"), F.when(by_mad, "mad").when(by_mean, "mean-ad").otherwise("identical").alias("rule"))


def verdicts(lines: DataFrame, tender: DataFrame, rules: Rules = RULES, w: Window = ALL) -> DataFrame:
    """Statistics of every code with the first guard that rejects it (reason), or usable."""
    rows = price_rows(lines, tender, rules, w)
    s = price_stats(rows).join(magnitude(rows, rules), "codigo_producto")
    wide = F.col("dispersion").isin("wide", "extreme")
    reason = (
        F.when(F.col("n") < rules.min_sample, "small-sample")
        .when(F.col("iqr_ratio") > rules.max_iqr_ratio, "iqr-ratio")
        .when(F.col("spread") > rules.max_spread, "spread")
        .when(F.col("decades") >= rules.most_decades, "decades")
        .when(F.col("decade_span") >= rules.most_span, "decade-span")
        .when((F.col("quantity_one") >= rules.lump_sum_share) & wide, "lump-sum")
    )
    return s.withColumn("reason", reason).withColumn("usable", reason.isNull())


def outliers(lines: DataFrame, tender: DataFrame, rules: Rules = RULES, w: Window = ALL) -> DataFrame:
    """Lines of usable codes beyond the fence and well above the median."""
    rows = price_rows(lines, tender, rules, w)
    good = verdicts(lines, tender, rules, w).filter("usable").select("codigo_producto")
    f = fences(rows, rules).join(good, "codigo_producto", "left_semi")
    price, m = F.col("precio_unitario"), F.col("median")
    z = F.when(F.col("rule") == "mad", rules.mad_scale * (price - m) / F.col("mad")).otherwise((price - m) / (rules.mean_scale * F.col("mean_ad")))
    out = rows.join(f, "codigo_producto").filter((price > F.col("fence")) & (price >= m * rules.min_ratio))
    whose = [c for c in ("nro_oferta", "cedula_proveedor", "cedula_institucion") if c in out.columns]
    return out.select("codigo_producto", "nro_sicop", "nro_linea", *whose, "cantidad", "precio_unitario", (price / m).alias("ratio_to_median"), z.alias("modified_z"), ((price - m) * F.col("cantidad")).alias("excess_value"), "rule")


def scan(lines: DataFrame, tender: DataFrame, rules: Rules = RULES, codes: int = 50, per_code: int = 5, w: Window = ALL) -> DataFrame:
    """The largest outliers of the most frequent codes, all codes in one job."""
    top = frequent_codes(lines, rules, codes, w)
    found = outliers(lines, tender, rules, w).join(F.broadcast(top.select("codigo_producto")), "codigo_producto", "left_semi")  # codes rows at most
    order = W.partitionBy("codigo_producto").orderBy(F.desc("excess_value"), "nro_sicop", "nro_linea", "precio_unitario")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_code)


def frequent_codes(lines: DataFrame, rules: Rules = RULES, codes: int = 50, w: Window = ALL) -> DataFrame:
    """codigo_producto, rows: the most frequent codes of the scan, which rank by lines in the currency and month alone; ties go to the lesser code."""
    picked = lines.filter(E.filled("codigo_producto") & (F.col("moneda") == rules.currency) & (F.col("precio_unitario") > 0) & (F.col("cantidad") > 0))
    if w.month:
        picked = picked.filter(F.col("source_month") == w.month)
    return picked.groupBy("codigo_producto").agg(F.count("*").alias("rows")).filter(F.col("rows") >= rules.min_sample).orderBy(F.desc("rows"), "codigo_producto").limit(codes)


def rejected(lines: DataFrame, tender: DataFrame, rules: Rules = RULES, codes: int = 50, w: Window = ALL) -> DataFrame:
    """codigo_producto, rows, reason: codes of the scan that a guard rejects."""
    top = frequent_codes(lines, rules, codes, w)
    return verdicts(lines, tender, rules, w).filter("not usable").select("codigo_producto", "reason").join(F.broadcast(top), "codigo_producto").select("codigo_producto", "rows", "reason")  # codes rows at most
