"""Stage durations with censoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.functions.exprs import ALL, Window
from cartulary.schemas import STAGES, Stage
from cartulary.storage import written


def unpivoted(stage_dates: DataFrame, w: Window = ALL, stages: Sequence[Stage] = STAGES, tender: DataFrame | None = None) -> DataFrame:
    """nro_sicop, line_id, stage, start, end: every stage of every line in one pass."""
    rows = stage_dates
    if w.filters():
        rows = rows.filter(w.dates("publicacion"))
        if w.month:
            rows = rows.filter(F.col("source_month") == w.month)
        if w.institution and tender is not None:
            rows = rows.join(tender.filter(F.col("cedula_institucion") == w.institution).select("nro_sicop"), "nro_sicop", "left_semi")
    pairs = F.array(*[F.struct(F.lit(s.key).alias("stage"), E.iso_date(s.start).alias("start"), E.iso_date(s.end).alias("end")) for s in stages])
    line = F.concat_ws("|", "nro_sicop", "cartel_seq", "partida", "linea")
    return rows.select("nro_sicop", line.alias("line_id"), F.explode(pairs).alias("p")).select("nro_sicop", "line_id", "p.*")


def procedures(rows: DataFrame) -> DataFrame:
    """nro_sicop, stage, start, end, lines_started, lines_ended: a procedure has ended when all its started lines have."""
    by = rows.groupBy("nro_sicop", "stage").agg(F.min("start").alias("start"), F.max("end").alias("last"), F.count("start").alias("lines_started"), F.count("end").alias("lines_ended"))
    done = (F.col("lines_ended") > 0) & (F.col("lines_ended") == F.col("lines_started"))
    return by.select("nro_sicop", "stage", "start", F.when(done, F.col("last")).alias("end"), "lines_started", "lines_ended")


def disposed(rows: DataFrame, as_of: str) -> DataFrame:
    """rows with disposition (completed, censored, notStarted, negative) and days (elapsed so far, if censored)."""
    spent, waited = E.days_between("start", "end"), E.days_between("start", F.lit(as_of))
    kind = (
        F.when(F.col("start").isNull(), "notStarted")
        .when(F.col("end").isNull(), F.when(waited >= 0, "censored").otherwise("negative"))
        .when(spent.isNull(), "notStarted")
        .when(spent < 0, "negative")
        .otherwise("completed")
    )
    return rows.withColumn("disposition", kind).withColumn("days", F.when(F.col("disposition") == "completed", spent).when(F.col("disposition") == "censored", waited))


def disposition_counts(rows: DataFrame) -> DataFrame:
    """stage, n, completed, censored, not_started, negative, censoring_rate."""
    def of(kind: str):
        return F.count_if(F.col("disposition") == kind)

    by = rows.groupBy("stage").agg(F.count("*").alias("n"), of("completed").alias("completed"), of("censored").alias("censored"), of("notStarted").alias("not_started"), of("negative").alias("negative"))
    return by.withColumn("censoring_rate", E.ratio("censored", F.col("completed") + F.col("censored")))


def report(rows: DataFrame) -> DataFrame:
    """Per stage: counts, summary of completed days, the Kaplan-Meier median, censored cases beyond the median.

    Cases are counted once by stage, disposition and days; all figures come from that small table.
    """
    by = written(rows.groupBy("stage", "disposition", "days").agg(F.count("*").alias("cases")), "stage-days")
    done = F.col("disposition") == "completed"

    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("disposition") == kind, F.col("cases"))), F.lit(0)).cast("long")

    counts = by.groupBy("stage").agg(F.sum("cases").alias("n"), of("completed").alias("completed"), of("censored").alias("censored"), of("notStarted").alias("not_started"), of("negative").alias("negative"))
    counts = counts.withColumn("censoring_rate", E.ratio("censored", F.col("completed") + F.col("censored")))
    days = F.col("days").cast("double")
    q = F.percentile(days, F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75, 0.9))), F.col("cases"))
    ended = by.filter(done).groupBy("stage").agg(F.min(days).alias("min"), *(q[k].alias(name) for k, name in enumerate(("p25", "median", "p75", "p90"))), F.max(days).alias("max"))
    known = by.filter("days is not null").withColumn("done", done)
    km = S.kaplan_meier(known, ["stage"], "days", "done", "cases").select("stage", "km_median", "reached")
    late = by.filter("disposition = 'censored'").join(ended.select("stage", "median"), "stage").groupBy("stage").agg(F.sum(F.when(F.col("days") > F.col("median"), F.col("cases"))).alias("censored_past_median"))
    out = counts.join(ended, "stage", "left").join(km, "stage", "left").join(late, "stage", "left")
    return out.withColumn("censored_past_median", F.coalesce("censored_past_median", F.lit(0)).cast("long")).withColumn("reached", F.coalesce("reached", F.lit(False)))


# Completed cases under which percentiles only indicate; shares of open cases from which the median runs fast, and describes a minority.
FEW_CASES, MANY_OPEN, MOSTLY_OPEN = 30, 0.2, 0.5


def warnings(made: DataFrame) -> DataFrame:
    """stage, warning: what a reader of report() has to know next to a stage's figures."""
    done, rate = F.col("completed"), F.col("censoring_rate")
    said = F.array(
        F.when(done == 0, "no-completed-cases").when(done < FEW_CASES, "few-completed-cases"),
        F.when(rate >= MOSTLY_OPEN, "most-cases-still-open").when(rate >= MANY_OPEN, "many-cases-still-open"),
        F.when(F.col("censored_past_median") > 0, "open-cases-past-the-median"),
        F.when(F.col("negative") > 0, "ends-before-starts-left-out"),
        F.when(F.col("reached") & (F.col("km_median") > F.col("median")), "survival-median-is-longer"),
        F.when(~F.col("reached") & (F.col("censored") > 0), "median-beyond-observation"),
    )
    return made.select("stage", F.explode(F.array_compact(said)).alias("warning"))


def by_institution(stage_dates: DataFrame, tender: DataFrame, institution: DataFrame, as_of: str, w: Window = ALL, min_completed: int = 10) -> DataFrame:
    """Per institution: procedures, and n, median (from min_completed on) and censored of two stages. The window's institution is ignored."""
    two = [s for s in STAGES if s.key in ("publication_to_award", "award_to_payment")]
    rows = disposed(procedures(unpivoted(stage_dates, Window(w.from_, w.to, w.month), two)), as_of)
    t = tender.select("nro_sicop", "cedula_institucion")
    joined = rows.join(t, "nro_sicop")

    def part(key: str, name: str) -> list:
        mine = F.col("stage") == key
        days = F.when(mine & (F.col("disposition") == "completed"), F.col("days").cast("double"))
        return [F.count(days).alias(f"{name}_n"), F.when(F.count(days) >= min_completed, F.percentile(days, F.lit(0.5))).alias(f"{name}_median"), F.count_if(mine & (F.col("disposition") == "censored")).alias(f"{name}_censored")]

    by = joined.groupBy("cedula_institucion").agg(F.countDistinct("nro_sicop").alias("procedures"), *part("publication_to_award", "award"), *part("award_to_payment", "payment"))
    return by.join(institution.select(F.col("cedula").alias("cedula_institucion"), "nombre"), "cedula_institucion", "left")
