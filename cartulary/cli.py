"""Command line: queries, the analyses of a loaded index with their filters, and the verbs of archives.

    python -m cartulary.cli list
    python -m cartulary.cli run competition_report --data DIR [--out PATH --format parquet|json|csv]
    python -m cartulary.cli export --data DIR --out PATH
    python -m cartulary.cli load --archives DIR --index DIR [--force]
    python -m cartulary.cli analyse screens --index DIR [--from DAY --to DAY --month M --institution ID --supplier ID --screen NAME --limit N ...]
    python -m cartulary.cli snapshot --archives DIR --store DIR --source cr
    python -m cartulary.cli diff --store DIR --archives DIR --source cr --period 202401 [--first STAMP --second STAMP]
    python -m cartulary.cli prove --archives DIR --source cr --period 202401 --table T --id ID
    python -m cartulary.cli bundle --archives DIR --source cr --period 202401 --out DIR [--full]
    python -m cartulary.cli verify-bundle --archives DIR --bundle DIR
    python -m cartulary.cli history --archives DIR --source cr --period 202401 --table T --id ID
    python -m cartulary.cli versions --archives DIR --source cr [--period 202401]
    python -m cartulary.cli recover --store DIR --source cr [--entries DIR]
    python -m cartulary.cli anchor --store DIR --source cr --day DAY [--most N]
    python -m cartulary.cli watch --landed DIR --copies DIR --feed DIR --checkpoint DIR --reports DIR --source cr [--bundles DIR --limit N]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions.exprs import Window as Scope
from cartulary.operators import awards, bundle, collusion, competition, differ, durations, history, institutions, loading, prices, reports, snapshots, versions
from cartulary.plans import catalog
from cartulary.schemas import CANON_VERSION, CHANGE_KINDS
from cartulary.sources import archive
from cartulary.storage import written
from cartulary.streaming import watch

#: Queries of the static export, a folder of JSON lines for each.
EXPORTED = ("index_counts", "index_spans", "months_held", "feed_by_kind", "entity_kinds", "competition_report", "collusion_report", "institution_ranking", "report_summaries", "tender_entities", "supplier_profiles")


def put(df: DataFrame, out: str | None, form: str, rows: int = 50) -> None:
    """Write a result, or show its first rows as a table."""
    if out:
        df.write.mode("overwrite").format(form).option("header", True).save(out)
    else:
        df.show(rows, truncate=80)


def export(spark: SparkSession, data: str, out: str, names: Sequence[str] = EXPORTED) -> None:
    """Results of queries as JSON lines, a folder for each; pages for readers without an engine."""
    for name in names:
        catalog.queries()[name](spark, data).write.mode("overwrite").json(f"{out}/{name}")


def take_snapshots(spark: SparkSession, archives: str, store: str, source: str) -> DataFrame:
    """Snapshots of all archives that aren't stored under the current rules, all of them in the same jobs; their headers."""
    listed = archive.archive_list(spark, archives)
    held = snapshots.headers(spark, store).filter(F.col("source") == source).filter(F.col("canon_version") == CANON_VERSION).select("period", "stamp")
    new = written(listed.join(held, ["period", "stamp"], "left_anti").select("path"), "new")
    if new.head(1):
        records = written(snapshots.records_of(spark, archives, source).join(F.broadcast(new), "path", "left_semi"), "records")  # a path for each archive
        heads = snapshots.headers_of(spark, archives, records, source).join(new, "path", "left_semi")
        snapshots.store(store, records, heads)
    return snapshots.headers(spark, store).filter(F.col("source") == source).drop("tables")


def compare(spark: SparkSession, store: str, archives: str, source: str, period: str, first: str | None = None, second: str | None = None) -> str:
    """What changed between two copies of a period, in words."""
    a, b = versions.pair(archive.archive_list(spark, archives), period, first, second)
    one, two = (written(snapshots.load_or_build(spark, store, archives, source, period, stamp), "copy") for stamp in (a, b))
    counts = {r["kind"]: r["changes"] for r in differ.kind_counts(differ.diff(one, two)).collect()}  # five rows
    heads = snapshots.headers(spark, store).filter((F.col("source") == source) & (F.col("period") == period) & (F.col("canon_version") == CANON_VERSION))
    tables = {s: heads.filter(F.col("stamp") == s).select(F.inline("tables")) for s in (a, b)}
    moved = [(r["table"], r["before"], r["after"]) for r in differ.schema_changes(tables[a], tables[b]).orderBy("table").collect()]  # one row per table
    return bundle.summary_text(period, {k: counts[k] for k in CHANGE_KINDS}, (one.count(), two.count()), moved)


def prove(spark: SparkSession, archives: str, source: str, period: str, table: str, id_: str) -> str | None:
    """The proof document of a record in the newest copy of a period; None if it isn't there."""
    newest = archive.archive_list(spark, archives).filter(F.col("period") == period).orderBy(F.desc("stamp")).first()
    if newest is None:
        return None
    records = written(snapshots.records_of(spark, newest["path"], source), "records")
    wanted = records.filter((F.col("table") == table) & (F.col("id") == id_))
    none = spark.createDataFrame([], "day string, period string, root string")
    found = snapshots.proof_documents(snapshots.headers_of(spark, newest["path"], records, source), records, wanted, none).first()
    return found["document"] if found else None


def history_of(spark: SparkSession, archives: str, source: str, period: str, table: str, id_: str) -> DataFrame:
    """A record in every copy of a period: step, hashes, leaf, check of the path, root."""
    listed = archive.archive_list(spark, archives).filter(F.col("period") == period)
    paths = [r["path"] for r in listed.collect()]  # copies of one period
    if not paths:
        raise ValueError(f"no archive of {period}")
    parts = [snapshots.records_of(spark, p, source).join(F.broadcast(listed.select("path", "stamp")), "path") for p in paths]
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    wanted = spark.createDataFrame([(table, id_)], "table string, id string")
    made = history.proven(written(records.select("stamp", "table", "id", "byte_hash", "value_hash"), "copies"), wanted)
    return made.withColumn("steps", F.size("steps")).orderBy("stamp")


def held_copies(spark: SparkSession, archives: str, source: str, period: str | None = None) -> DataFrame:
    """period, stamp, sha256, bytes, copies (of the period), newest of every archive held."""
    listed = archive.archive_list(spark, archives)
    rows = (listed.filter(F.col("period") == period) if period else listed).join(archive.archive_sums(spark, archives).select("path", "sha256"), "path")
    w = Window.partitionBy("period")
    return rows.select(F.lit(source).alias("source"), "period", "stamp", "sha256", F.col("length").alias("bytes"), F.count("*").over(w).alias("copies"), (F.max("stamp").over(w) == F.col("stamp")).alias("newest")).orderBy("period", "stamp")


def recoverable(spark: SparkSession, store: str, source: str, entries: str | None = None) -> DataFrame:
    """What can be recovered of every capture: stored snapshots against the roots on record."""
    held = snapshots.headers(spark, store).filter(F.col("source") == source).select("source", "period", "stamp", F.col("archive_sha256").alias("sha256"), "root", "canon_version", "records")
    none = spark.createDataFrame([], "key string, type string, value string")
    family = CANON_VERSION.rpartition("-")[0]
    found = versions.of_source(versions.parse_versions(versions.read_entries(spark, entries) if entries else none), source)
    anchored = found.withColumn("canon_version", F.concat(F.lit(f"{family}-"), F.col("canon").cast("string")))
    return versions.recovery(versions.captures(held, anchored), anchored)


def anchor_plan(spark: SparkSession, store: str, source: str, day: str, most: int) -> DataFrame:
    """Entries that would be put on record for a day: the newest snapshot of each period, in batches; nothing is sent."""
    held = snapshots.headers(spark, store).filter((F.col("source") == source) & (F.col("canon_version") == CANON_VERSION))
    rows = held.select("source", "period", "stamp", F.col("archive_sha256").alias("sha256"), "root", "canon_version", "records")
    return versions.day_plan(versions.checked(versions.day_entries(day, versions.newest(rows), source)), most).orderBy("batch", "place")


#: Analyses of a loaded index: what they need of a filter, by name.
SCREENS = ("bid-rotation", "consistent-losing", "bid-spread", "single-bidder-concentration")


def analyse(spark: SparkSession, what: str, folder: str, a: argparse.Namespace) -> DataFrame:
    """One analysis over a loaded index under a window of dates, month and institution."""
    t = lambda name: loading.table(spark, folder, name)
    w = Scope(a.from_, a.to, a.month, a.institution)
    tender, bid, award = t("tender"), t("bid"), t("award_line")
    more = lambda **kw: {k: v for k, v in kw.items() if v is not None}
    if what == "competition":
        return reports.competition_report(bid, tender, award, w)
    if what == "institutions":
        return competition.by_institution(bid, tender, t("institution"), w, **more(min_tenders=a.min_tenders))
    if what == "concentration":
        return awards.top_suppliers(award, tender, a.currency or "CRC", a.limit or 10, w)
    if what == "screens":
        if not a.screen:
            return collusion.report(bid, t("bid_line"), award, tender, t("institution"), w)
        guard = more(min_tenders=a.min_tenders)
        hits = {
            SCREENS[0]: lambda: collusion.rotation(bid, award, tender, w, **guard),
            SCREENS[1]: lambda: collusion.consistent_losing(bid, award, tender, w, **guard),
            SCREENS[2]: lambda: collusion.bid_spread(bid, t("bid_line"), award, tender, w, **guard),
            SCREENS[3]: lambda: collusion.sole_bid_pairs(bid, award, tender, t("institution"), w, **guard),
        }[a.screen]()
        return collusion.listed(a.screen, hits, a.limit or 25)
    if what == "prices":
        lines = t("bid_line") if a.lines == "bid" else award
        rules = replace(prices.RULES, **more(currency=a.currency, min_sample=a.min_sample))
        if a.code:
            lines = lines.filter(F.col("codigo_producto") == a.code)
        found = prices.with_supplier(prices.outliers(lines, tender, rules, w), bid if a.lines == "bid" else None)
        found = found.filter(F.col("cedula_proveedor") == a.supplier) if a.supplier else found
        return found.orderBy(F.desc("excess_value"), "nro_sicop", "nro_linea").limit(a.limit or 25)
    if what == "durations":
        day = a.as_of or reports.as_of(loading.ledger(spark, folder), t("stage_dates")).first()["as_of"]
        rows = durations.unpivoted(t("stage_dates"), w, tender=tender)
        rows = rows if a.grain == "line" else durations.procedures(rows)
        made = durations.report(durations.disposed(rows, day))
        return made.filter(F.col("stage") == a.stage) if a.stage else made
    if what == "suppliers":
        made = reports.supplier_profiles(bid, t("bid_line"), award, tender, t("institution"), t("supplier"), t("appeal"), t("sanction"), w, **more(limit=a.limit))
        return made.filter(F.col("cedula_proveedor") == a.supplier) if a.supplier else made
    day = a.as_of or reports.as_of(loading.ledger(spark, folder), t("stage_dates")).first()["as_of"]
    long = institutions.metrics(competition.by_institution(bid, tender, t("institution"), w), durations.by_institution(t("stage_dates"), tender, t("institution"), day, w))
    if what == "ranking":
        return institutions.ranking(long, a.metric or institutions.METRICS[0][0], **more(min_sample=a.min_sample))
    made = institutions.benchmark(long, all_peers=a.all_peers, **more(min_sample=a.min_sample))
    return made.filter(F.col("metric") == a.metric) if a.metric else made


ANALYSES = ("competition", "institutions", "concentration", "screens", "prices", "durations", "suppliers", "ranking", "peers")


def parser() -> argparse.ArgumentParser:
    """All commands and their options."""
    p = argparse.ArgumentParser(prog="cartulary")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, needed: Sequence[str] = (), optional: Sequence[str] = ()) -> argparse.ArgumentParser:
        made = verbs.add_parser(name)
        for option in needed:
            made.add_argument(option, required=True)
        for option in optional:
            made.add_argument(option)
        return made

    verb("list")
    run = verb("run", ("--data",), ("--out",))
    run.add_argument("query")
    verb("export", ("--data", "--out"))
    verb("load", ("--archives", "--index")).add_argument("--force", action="store_true")
    asked = verb("analyse", ("--index",), ("--to", "--month", "--institution", "--supplier", "--code", "--currency", "--stage", "--metric", "--as-of", "--out"))
    asked.add_argument("what", choices=ANALYSES)
    asked.add_argument("--from", dest="from_")
    asked.add_argument("--screen", choices=SCREENS)
    asked.add_argument("--grain", choices=("procedure", "line"), default="procedure")
    asked.add_argument("--lines", choices=("award", "bid"), default="award")
    asked.add_argument("--all-peers", action="store_true")
    for option in ("--limit", "--min-tenders", "--min-sample"):
        asked.add_argument(option, type=int)
    for made in (run, asked):
        made.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    verb("snapshot", ("--archives", "--source", "--store"))
    verb("diff", ("--archives", "--source", "--store", "--period"), ("--first", "--second"))
    verb("prove", ("--archives", "--source", "--period", "--table", "--id"))
    verb("history", ("--archives", "--source", "--period", "--table", "--id"))
    verb("versions", ("--archives", "--source"), ("--period",))
    verb("bundle", ("--archives", "--source", "--period", "--out"), ("--first", "--second")).add_argument("--full", action="store_true")
    verb("verify-bundle", ("--archives", "--bundle"))
    verb("recover", ("--store", "--source"), ("--entries",))
    verb("anchor", ("--store", "--source", "--day")).add_argument("--most", type=int, default=versions.MAX_ENTRIES)
    watched = verb("watch", ("--landed", "--copies", "--feed", "--checkpoint", "--reports", "--source"), ("--bundles",))
    watched.add_argument("--limit", type=int, default=watch.MOST_LISTED)
    return p


def main(words: Sequence[str] | None = None) -> int:
    """Run one command; 0 if it worked, 1 if what was asked for isn't there or doesn't hold."""
    a = parser().parse_args(words)
    if a.verb == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if a.verb == "run" and a.query not in catalog.queries():
        print(f"no query {a.query}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("cartulary").getOrCreate()
    try:
        return _done(spark, a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


def _done(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.verb == "run":
        put(catalog.queries()[a.query](spark, a.data), a.out, a.format)
    elif a.verb == "export":
        export(spark, a.data, a.out)
    elif a.verb == "load":
        put(loading.load_archives(spark, a.archives, a.index, a.force), None, "")
    elif a.verb == "analyse":
        put(analyse(spark, a.what, a.index, a), a.out, a.format)
    elif a.verb == "snapshot":
        put(take_snapshots(spark, a.archives, a.store, a.source), None, "")
    elif a.verb == "diff":
        print(compare(spark, a.store, a.archives, a.source, a.period, a.first, a.second))
    elif a.verb == "history":
        put(history_of(spark, a.archives, a.source, a.period, a.table, a.id), None, "")
    elif a.verb == "versions":
        put(held_copies(spark, a.archives, a.source, a.period), None, "")
    elif a.verb == "bundle":
        kinds = CHANGE_KINDS if a.full else bundle.REVISIONS_ONLY
        print(bundle.from_archives(spark, a.archives, a.source, a.period, a.out, a.first, a.second, kinds))
    elif a.verb == "verify-bundle":
        checks = bundle.verify_archives(spark, a.bundle, a.archives)
        print("\n".join(f"{'ok  ' if ok else 'FAIL'}  {name:<20} {detail}" for name, ok, detail in checks))
        return 0 if all(ok for _, ok, _ in checks) else 1
    elif a.verb == "recover":
        put(recoverable(spark, a.store, a.source, a.entries), None, "")
    elif a.verb == "anchor":
        put(anchor_plan(spark, a.store, a.source, a.day, a.most), None, "")
    elif a.verb == "watch":
        report = watch.reporter(spark, a.reports, a.source, limit=a.limit, bundles=a.bundles)
        watch.watch(spark, a.landed, a.copies, a.feed, a.checkpoint, report).awaitTermination()
    else:
        found = prove(spark, a.archives, a.source, a.period, a.table, a.id)
        print(found or "no such record")
        return 0 if found else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
