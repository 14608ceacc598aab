"""Delivery: change feed, subjects of changes, key dates, alerts, release packages, paging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.functions import exprs as E
from cartulary.operators.awards import latest_award_lines
from cartulary.schemas import PROCEDURE_TABLES
from cartulary.storage import names_in, remove, together, written


def flatten(reports: DataFrame) -> DataFrame:
    """A row for each change of each finding of watch reports (ran_at, source, findings)."""
    f = reports.select("ran_at", "source", F.explode("findings").alias("f"))
    c = f.select("ran_at", "source", F.col("f.month").alias("month"), F.col("f.closed_month").alias("closed_month"), F.explode("f.changes").alias("c"))
    return c.select(F.col("ran_at").alias("detected_at"), "source", "month", "closed_month", "c.*")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """ran_at, source, findings of the watch reports (``*.json``) under a folder; other files and unreadable ones are left out."""
    change = "struct<kind:string,table:string,id:string,beforeHash:string,afterHash:string>"
    schema = f"ran_at string, source string, findings array<struct<month:string,closed_month:boolean,changes:array<{change}>>>, broken string"
    found = spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").option("multiLine", "true").option("columnNameOfCorruptRecord", "broken").json(folder)
    return found.filter("broken is null and ran_at is not null").drop("broken")


def report_summaries(reports: DataFrame) -> DataFrame:
    """day, ran_at, months_checked, months_updated (sorted), changes of each report."""
    found = F.coalesce("findings", F.array())
    changed = F.filter("findings", lambda f: F.size(f["changes"]) > 0)
    total = F.aggregate(F.transform("findings", lambda f: F.size(f["changes"])), F.lit(0), lambda a, n: a + n)
    return reports.select(F.substring("ran_at", 1, 10).alias("day"), "ran_at", F.size(found).alias("months_checked"), F.array_sort(F.transform(changed, lambda f: f["month"])).alias("months_updated"), total.alias("changes"))


def feed(changes: DataFrame, since: str | None = None, until: str | None = None, month: str | None = None, kind: str | None = None, table: str | None = None, institution: str | None = None, tender: str | None = None) -> DataFrame:
    """Changes within bounds, newest first; institution and tender ask for changes with their subject (static_subject, subjects)."""
    out = changes
    for column, value in (("month", month), ("kind", kind), ("table", table), ("institution", institution), ("nro_sicop", tender)):
        if value:
            out = out.filter(F.col(column) == value)
    if since:
        out = out.filter(F.col("detected_at") >= since)
    if until:
        out = out.filter(F.col("detected_at") <= until)
    return out.orderBy(F.desc("detected_at"), "table", "id")


def by_kind(changes: DataFrame) -> DataFrame:
    """kind, changes: how many of each kind there are."""
    return changes.groupBy("kind").agg(F.count("*").alias("changes"))


def from_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several publishers together, each with its source."""
    out = None
    for name, df in sorted(parts.items()):
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out


def page(df: DataFrame, limit: int = 100, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page of an ordered table; the limit is held between 1 and most."""
    return df.offset(max(0, offset)).limit(min(most, max(1, limit)))


def static_subject(changes: DataFrame) -> DataFrame:
    """changes with nro_sicop, supplier, institution and product as far as a record's id alone tells."""
    parts, by_content = F.split("id", r"\|"), F.col("id").startswith("sha256:")

    def of(at: int, *tables: str) -> Column:
        return F.when(F.col("table").isin(*tables) & ~by_content, F.nullif(F.get(parts, F.lit(at)), F.lit("")))

    institution = F.coalesce(of(0, "InstitucionesRegistradas", "FuncionariosInhibicion"), of(1, "SancionProveedores"))
    return changes.withColumn("nro_sicop", of(0, *PROCEDURE_TABLES)).withColumn("supplier", of(0, "Proveedores", "SancionProveedores")).withColumn("institution", institution).withColumn("product", of(3, "SancionProveedores"))


def subjects(changes: DataFrame, tender: DataFrame, bid: DataFrame, award: DataFrame, bid_line: DataFrame) -> DataFrame:
    """changes with the institution, suppliers and products around their procedure (sorted arrays)."""
    ids = changes.select("nro_sicop").filter("nro_sicop is not null").distinct()
    parties = bid.select("nro_sicop", "cedula_proveedor").union(award.select("nro_sicop", "cedula_proveedor")).filter(E.filled("cedula_proveedor")).join(ids, "nro_sicop", "left_semi")
    people = parties.groupBy("nro_sicop").agg(F.array_sort(F.collect_set("cedula_proveedor")).alias("suppliers"))
    goods = bid_line.filter(E.filled("codigo_producto")).join(ids, "nro_sicop", "left_semi").groupBy("nro_sicop").agg(F.array_sort(F.collect_set("codigo_producto")).alias("products"))
    where = tender.select("nro_sicop", F.col("cedula_institucion").alias("tender_institution"))
    out = changes.join(where, "nro_sicop", "left").join(people, "nro_sicop", "left").join(goods, "nro_sicop", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("institution", F.coalesce("institution", "tender_institution")).drop("tender_institution").withColumn("suppliers", F.coalesce("suppliers", F.when(F.col("supplier").isNotNull(), F.array("supplier")), none)).withColumn("products", F.coalesce("products", F.when(F.col("product").isNotNull(), F.array("product")), none))


def key_dates(tender: DataFrame, stage_dates: DataFrame) -> DataFrame:
    """nro_sicop, published, opens, awarded, noticed: a tender's dates, from its stages where it lacks them."""
    s = stage_dates.groupBy("nro_sicop").agg(F.min(E.iso_date("publicacion")).alias("p"), F.min(E.iso_date("fecha_apertura")).alias("o"), F.min(E.iso_date("adjudicacion_firme")).alias("awarded"))
    return tender.join(s, "nro_sicop", "left").select("nro_sicop", F.coalesce(E.iso_date("fecha_publicacion"), "p").alias("published"), F.coalesce(E.iso_date("fechah_apertura"), "o").alias("opens"), "awarded")


def objection_window(dates: DataFrame, today: str) -> DataFrame:
    """dates with closes_at (a third of the way from publication to opening), status and days_remaining."""
    wait = E.days_between("published", "opens")
    closes = F.when(wait >= 0, F.date_add(E.as_day("published"), F.floor(wait / 3).cast("int")))
    left = F.datediff(closes, F.lit(today).cast("date"))
    status = F.when(closes.isNull(), "unknown").when(left >= 0, "open").otherwise("closed")
    return dates.select("*", F.date_format(closes, "yyyy-MM-dd").alias("closes_at"), status.alias("status"), left.alias("days_remaining"))


def alerts(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """subscription, kind, table, id, severity: changes that a subscription follows, each once.

    What a change concerns is exploded to (what, value) and met by equality, so the
    work follows the matches. Blank values never match; kinds, if given, restrict.
    """
    one = lambda what, c: F.array(F.struct(F.lit(what).alias("what"), F.col(c).alias("value")))
    many = lambda what, c: F.transform(c, lambda v: F.struct(F.lit(what).alias("what"), v.alias("value")))
    about = F.concat(one("tender", "nro_sicop"), one("institution", "institution"), many("supplier", "suppliers"), many("product", "products"))
    rows = changes.select("kind", "table", "id", "closed_month", F.explode(about).alias("a")).select("kind", "table", "id", "closed_month", "a.*").filter(E.filled("value"))
    s = subscriptions.filter(E.filled("value")).select(F.col("id").alias("subscription"), F.col("kind").alias("what"), "value", "kinds")
    met = rows.join(s, ["what", "value"]).filter(F.col("kinds").isNull() | (F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind")))
    high = (F.col("kind") == "silentRevision") & F.col("closed_month")
    severity = F.when(high, "high").when(F.col("kind").isin("silentRevision", "removed"), "medium").otherwise("low")
    return met.select("subscription", "kind", "table", "id", severity.alias("severity")).distinct()


def alert_list(matches: DataFrame) -> DataFrame:
    """alerts with a stable id, gravest first: high, medium, low, then by subscription, table and record."""
    id_ = F.substring(F.sha2(F.concat_ws("|", "subscription", "kind", "table", "id"), 256), 1, 16)
    grade = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return matches.withColumn("alert_id", id_).orderBy(grade, "subscription", "table", "id", "kind")


# Payloads of single things and of the whole


def _listed(df: DataFrame, order: Sequence[Column], most: int, name: str) -> DataFrame:
    """One row: the number of rows and the first ones, in order, as an array."""
    first = df.orderBy(*order).limit(most).agg(F.collect_list(F.struct(*df.columns)).alias(name))
    return df.agg(F.count("*").alias(f"n_{name}")).crossJoin(first)  # one row each, of at most ``most`` elements


def supplier_entity(cedula: str, supplier: DataFrame, bid: DataFrame, award: DataFrame, contract: DataFrame, appeal: DataFrame, sanction: DataFrame, most: int = 500) -> DataFrame:
    """One row: a supplier with its bids, awards, contracts, appeals and sanctions, newest first, at most so many of each; all filters reach the scans."""
    mine = F.col("cedula_proveedor") == cedula
    out = supplier.filter(mine).agg(F.max("nombre").alias("nombre")).select(F.lit(cedula).alias("cedula"), "nombre")
    for df, order, name, n in ((bid, "nro_sicop", "bids", most), (award, "nro_sicop", "awards", most), (contract, "fecha_notificacion", "contracts", most), (appeal, "nro_recurso", "appeals", min(most, 200)), (sanction, "cedula_proveedor", "sanctions", most)):
        rows = df.filter(mine)
        out = out.crossJoin(_listed(rows, [F.desc(order), *[F.col(c) for c in rows.columns if c != order]], n, name))  # one row each
    return out


def institution_entity(cedula: str, institution: DataFrame, tender: DataFrame, contract: DataFrame, most: int = 500) -> DataFrame:
    """One row: an institution with its tenders, newest first, and the number of its contracts."""
    tenders = tender.filter(F.col("cedula_institucion") == cedula).select("nro_sicop", "nro_procedimiento", "fecha_publicacion", "tipo_procedimiento", "cartel_stat", "monto_est", "source_month")
    out = institution.filter(F.col("cedula") == cedula).agg(F.max("nombre").alias("nombre")).select(F.lit(cedula).alias("cedula"), "nombre")
    agreed = contract.join(tenders.select("nro_sicop"), "nro_sicop", "left_semi") if "cedula_institucion" not in contract.columns else contract.filter(F.col("cedula_institucion") == cedula)
    return out.crossJoin(_listed(tenders, (F.desc("fecha_publicacion"), F.col("nro_sicop")), most, "tenders")).crossJoin(agreed.agg(F.count("*").alias("n_contracts")))  # one row each


def tender_entities(tender: DataFrame, bid: DataFrame, bid_line: DataFrame, award: DataFrame, contract: DataFrame, appeal: DataFrame | None, institution: DataFrame, dates: DataFrame) -> DataFrame:
    """nro_sicop, the institution's name, key dates and the numbers of bids, lines, awards, contracts and appeals around each tender; filter by nro_sicop for one."""
    out = tender.join(institution.select(F.col("cedula").alias("cedula_institucion"), "nombre"), "cedula_institucion", "left").select("nro_sicop", "cedula_institucion", "nombre", "cartel_stat").join(dates, "nro_sicop", "left")
    parts = {"bids": bid, "bid_lines": bid_line, "award_lines": award, "contracts": contract} | ({"appeals": appeal} if appeal is not None else {})
    for name, df in parts.items():
        out = out.join(df.groupBy("nro_sicop").agg(F.count("*").alias(name)), "nro_sicop", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    proof = F.concat(F.lit("/proof/DetalleCarteles/"), F.url_encode("nro_sicop"))
    return out.withColumn("proof", proof)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def entity_kinds(entity: DataFrame) -> DataFrame:
    """kind, entities, members: how many entities of each kind there are."""
    return entity.groupBy("kind").agg(F.count("*").alias("entities"), F.sum("member_count").cast("long").alias("members"))


def months(archives: DataFrame) -> DataFrame:
    """source, period, versions, stamps (sorted): what is held of each period."""
    return archives.groupBy("source", "period").agg(F.countDistinct("stamp").alias("versions"), F.array_sort(F.collect_set("stamp")).alias("stamps"))


def health(index_tables: dict[str, DataFrame], snapshots: DataFrame) -> DataFrame:
    """One row: status (ok, or degraded without an index or a snapshot), whether there is an index, and snapshots."""
    ready = all(df.limit(1).count() for df in index_tables.values())
    return snapshots.agg(F.count("*").alias("snapshots")).select(F.when(F.lit(ready) & (F.col("snapshots") > 0), "ok").otherwise("degraded").alias("status"), F.lit("ready" if ready else "missing").alias("index"), "snapshots")


def bundle_status(bundles: DataFrame, recorded: DataFrame) -> DataFrame:
    """bundles (period, canon, from_sha256, to_sha256, digest) with the digest on record and whether it matches; both null if there is none.

    recorded are entries as versions.parse_diffs gives them; of several for a bundle the least digest counts.
    """
    on = recorded.groupBy("period", "from_id", "to_id", "canon").agg(F.min("digest").alias("recorded_digest"))
    mine = bundles.withColumn("from_id", F.substring("from_sha256", 1, 12)).withColumn("to_id", F.substring("to_sha256", 1, 12))
    return mine.join(on, ["period", "from_id", "to_id", "canon"], "left").withColumn("digest_matches", F.col("digest") == F.col("recorded_digest"))


# Release packages


def award_values(award: DataFrame) -> DataFrame:
    """nro_sicop, nro_acto, cedula_proveedor, lines, amount, currency: the amount only if there is one currency."""
    cur = E.ocds_currency("moneda")
    rows = award.withColumn("cur", cur)
    total = F.round(F.sum(F.coalesce("cantidad", F.lit(0.0)) * F.coalesce("precio_unitario", F.lit(0.0))), 5)
    by = rows.groupBy("nro_sicop", "nro_acto", "cedula_proveedor").agg(F.count("*").alias("lines"), F.countDistinct("cur").alias("n"), total.alias("t"), F.min("cur").alias("c"))
    return by.select("nro_sicop", "nro_acto", "cedula_proveedor", "lines", F.when(F.col("n") == 1, F.col("t")).alias("amount"), F.when(F.col("n") == 1, F.col("c")).alias("currency"))


def contract_amendments(contract: DataFrame) -> DataFrame:
    """nro_contrato, first_sequence, amendments: rows of a contract after its first sequence number."""
    w = W.partitionBy("nro_contrato").orderBy(E.leading_int("secuencia"), "secuencia")
    rows = contract.withColumn("n", F.row_number().over(w))
    return rows.groupBy("nro_contrato").agg(F.max(F.when(F.col("n") == 1, F.col("secuencia"))).alias("first_sequence"), F.count_if(F.col("n") > 1).alias("amendments"))


def _has(df: DataFrame, name: str) -> Column:
    """A column's trimmed text; null if it is blank or the table lacks it."""
    return F.when(E.filled(name), F.trim(F.col(name))) if name in df.columns else F.lit(None).cast("string")


def _some(struct: Column, *parts: str) -> Column:
    """A struct, or null if none of its named parts has a value, so that no empty object is written."""
    return F.when(F.coalesce(*[struct[p].cast("string") for p in parts]).isNotNull(), struct)


def _release_items(lines: DataFrame, keys: list[str], prefix: Column) -> DataFrame:
    """keys, items: an item for each line number, the first of equal numbers by offer, code and price."""
    w = W.partitionBy(*keys, "nro_linea").orderBy(F.col("nro_oferta"), F.col("codigo_producto"), F.col("precio_unitario"))
    code = F.trim("codigo_producto")
    unspsc = F.when(code.rlike(r"^\d{8}"), F.struct(F.lit("UNSPSC").alias("scheme"), F.substring(code, 1, 8).alias("id")))
    unit = F.when(F.col("precio_unitario").isNotNull(), F.struct(F.struct(F.col("precio_unitario").alias("amount"), E.ocds_currency("moneda").alias("currency")).alias("value")))
    item = F.struct(F.concat(prefix, F.lit("-item-"), F.col("nro_linea")).alias("id"), unspsc.alias("classification"), F.col("cantidad").alias("quantity"), unit.alias("unit"))
    return lines.withColumn("n", F.row_number().over(w)).filter("n = 1").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _release_contracts(contract: DataFrame) -> DataFrame:
    """nro_sicop, contracts, currency: contracts with their amendments in order; the currency of the first one that states any."""
    order = F.struct(E.leading_int("secuencia").alias("k"), F.col("secuencia").alias("s"))
    changed = E.ocds_time(F.coalesce(_has(contract, "fecha_modificacion"), _has(contract, "fecha_elaboracion")))
    row = F.struct(order.alias("o"), "secuencia", changed.alias("date"), _has(contract, "tipo_modificacion").alias("rationale"), E.ocds_time(_has(contract, "fecha_elaboracion")).alias("signed"), E.ocds_time(_has(contract, "fecha_notificacion")).alias("start"), _has(contract, "vigencia").alias("text"), _has(contract, "moneda").alias("money"))
    rows = contract.groupBy("nro_sicop", "nro_contrato").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    by = rows.withColumn("currency", F.get(F.filter(F.transform("rows", lambda r: r["money"]), lambda m: m.isNotNull()), F.lit(0)))
    first, rest = F.get("rows", F.lit(0)), F.slice("rows", 2, 1_000_000)
    amendments = F.transform(rest, lambda r: F.struct(F.concat_ws("-", "nro_contrato", r["secuencia"]).alias("id"), r["date"].alias("date"), r["rationale"].alias("rationale")))
    paper = F.struct(
        F.col("nro_contrato").alias("id"), F.lit("active").alias("status"), first["signed"].alias("dateSigned"), F.when(first["start"].isNotNull(), F.struct(first["start"].alias("startDate"))).alias("period"),
        first["text"].alias("description"), F.when(F.size("rows") > 1, amendments).alias("amendments"),
    )
    return by.groupBy("nro_sicop").agg(F.array_sort(F.collect_list(paper)).alias("contracts"), F.min_by("currency", F.when(F.col("currency").isNotNull(), F.col("nro_contrato"))).alias("currency"))


def releases(tender: DataFrame, bid: DataFrame, bid_line: DataFrame, award: DataFrame, contract: DataFrame, supplier: DataFrame, institution: DataFrame, prefix: str = "ocds-x-", scheme: str = "X-ID", language: str = "es", keep: Sequence[str] = ()) -> DataFrame:
    """ocid, source_month, release (JSON) and what of the tender's columns is to be kept: a release for each tender; members without a value are left out.

    Every child table is grouped by procedure once and joined; nulls, empty lists and
    empty objects don't reach the JSON. A release's id names the copy that it was read from, so
    releases of two copies of a month stay apart.
    """
    party = lambda c: F.concat(F.lit(f"{scheme}-"), c)
    names = supplier.select(F.trim("cedula_proveedor").alias("who"), F.trim("nombre").alias("name")).unionByName(institution.select(F.trim("cedula").alias("who"), F.trim("nombre").alias("name"))).groupBy("who").agg(F.max("name").alias("name"))
    roles = tender.select("nro_sicop", F.trim("cedula_institucion").alias("who"), F.lit("buyer").alias("role"))
    for df, role in ((bid, "tenderer"), (award, "supplier"), (contract, "supplier")):
        roles = roles.unionByName(df.select("nro_sicop", F.trim("cedula_proveedor").alias("who"), F.lit(role).alias("role")))
    each = roles.filter(E.filled("who")).groupBy("nro_sicop", "who").agg(F.array_sort(F.collect_set("role")).alias("roles")).join(names, "who", "left")
    person = F.struct(party(F.col("who")).alias("id"), "name", F.struct(F.lit(scheme).alias("scheme"), F.col("who").alias("id"), F.col("name").alias("legalName")).alias("identifier"), "roles")
    known = F.struct(party(F.col("who")).alias("id"), "name")
    parties = each.groupBy("nro_sicop").agg(
        F.array_sort(F.collect_list(person)).alias("parties"), F.array_sort(F.collect_list(F.when(F.array_contains("roles", "tenderer"), known))).alias("tenderers"),
        F.min(F.when(F.array_contains("roles", "buyer"), known)).alias("buyer"),
    )

    items = _release_items(bid_line, ["nro_sicop"], F.col("nro_sicop"))
    lines = latest_award_lines(award).withColumn("who", F.trim("cedula_proveedor"))
    awarded = _release_items(lines, ["nro_sicop", "nro_acto", "cedula_proveedor"], F.concat_ws("-", "nro_sicop", "nro_acto"))
    value = award_values(lines).join(awarded, ["nro_sicop", "nro_acto", "cedula_proveedor"], "left").withColumn("who", F.trim("cedula_proveedor")).join(names, "who", "left")
    to = F.when(E.filled("who"), F.array(F.struct(party(F.col("who")).alias("id"), "name")))
    one = F.struct(F.concat_ws("-", "nro_acto", "who").alias("id"), F.lit("active").alias("status"), to.alias("suppliers"), "items", F.when(F.col("amount").isNotNull(), F.struct("amount", "currency")).alias("value"))
    awards = value.groupBy("nro_sicop").agg(F.array_sort(F.collect_list(one)).alias("awards"))
    bidders = bid.groupBy("nro_sicop").agg(F.count("*").alias("offers"))

    out = tender
    for df in (parties, items, awards, _release_contracts(contract), bidders):
        out = out.join(df, "nro_sicop", "left")
    number, exception = F.coalesce(_has(tender, "nro_procedimiento"), F.col("nro_sicop")), _has(tender, "des_excepcion")
    amount = F.when(F.col("monto_est").isNotNull(), F.struct(F.col("monto_est").alias("amount"), E.ocds_currency("currency").alias("currency")))
    planning = _some(F.struct(exception.alias("rationale"), F.when(F.col("monto_est").isNotNull(), F.struct(number.alias("id"), amount.alias("amount"))).alias("budget")), "rationale", "budget")
    period = _some(F.struct(E.ocds_time(_has(tender, "fecha_publicacion")).alias("startDate"), E.ocds_time(_has(tender, "fechah_apertura")).alias("endDate")), "startDate", "endDate")
    month = F.concat(F.substring("source_month", 1, 4), F.lit("-"), F.substring("source_month", 5, 2), F.lit("-01T00:00:00Z"))
    # a contract belongs to the award if there is just one
    sole = F.when(F.size("awards") == 1, F.get("awards", F.lit(0))["id"])
    papers = F.transform("contracts", lambda c: F.struct(c["id"].alias("id"), sole.alias("awardID"), *[c[x].alias(x) for x in ("status", "dateSigned", "period", "description", "amendments")]))
    body = F.struct(
        F.concat(F.lit(prefix), F.col("nro_sicop")).alias("ocid"), F.concat_ws("-", "nro_sicop", "source_month", _has(tender, "archive_stamp")).alias("id"),
        F.coalesce(E.ocds_time(_has(tender, "fecha_publicacion")), month).alias("date"),
        F.array_compact(F.array(F.when(planning.isNotNull(), "planning"), F.lit("tender"), F.when(F.col("awards").isNotNull(), "award"), F.when(F.col("contracts").isNotNull(), "contract"))).alias("tag"),
        F.lit("tender").alias("initiationType"), F.lit(language).alias("language"), "parties", "buyer", planning.alias("planning"),
        F.struct(
            number.alias("id"), _has(tender, "cartel_nm").alias("title"), E.ocds_status("cartel_stat").alias("status"), F.col("buyer").alias("procuringEntity"), "items", amount.alias("value"),
            E.ocds_method("tipo_procedimiento").alias("procurementMethod"), _has(tender, "tipo_procedimiento").alias("procurementMethodDetails"), exception.alias("procurementMethodRationale"), E.ocds_category("clas_obj").alias("mainProcurementCategory"),
            period.alias("tenderPeriod"), F.col("offers").alias("numberOfTenderers"), F.when(F.size("tenderers") > 0, F.col("tenderers")).alias("tenderers"), _has(tender, "modalidad").alias("submissionMethodDetails"),
        ).alias("tender"),
        "awards", papers.alias("contracts"),
    )
    return out.select(F.concat(F.lit(prefix), F.col("nro_sicop")).alias("ocid"), "source_month", F.to_json(body).alias("release"), *keep)


#: Tenders whose releases are made at a time.
SLICE = 2_000_000


def _slices(tender: DataFrame, children: Sequence[DataFrame], most: int) -> list[list[DataFrame]]:
    """tender and its child tables in slices of about ``most`` tenders by the hash of the procedure; all rows are in one of them."""
    n = max(1, -(-tender.count() // most))
    if n == 1:
        return [[tender, *children]]
    return [[df.filter(F.pmod(F.xxhash64("nro_sicop"), F.lit(n)) == k) for df in (tender, *children)] for k in range(n)]


def releases_in_slices(tender: DataFrame, bid: DataFrame, bid_line: DataFrame, award: DataFrame, contract: DataFrame, supplier: DataFrame, institution: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda made: made, most: int | None = None) -> DataFrame:
    """What ``shape`` makes of ``releases``, row by row, written slice by slice: child tables lie on disk for one slice at a time."""
    parts = _slices(tender, (bid, bid_line, award, contract), most or SLICE)
    return together(tender.sparkSession, [lambda p=p: shape(releases(*p, supplier, institution)) for p in parts], "releases")[1]


def packages_in_slices(tender: DataFrame, bid: DataFrame, bid_line: DataFrame, award: DataFrame, contract: DataFrame, supplier: DataFrame, institution: DataFrame, published: str, publisher: str, size: int = 1000, shape: Callable[[DataFrame], DataFrame] = lambda made: made, most: int | None = None, prefix: str = "ocds-x-") -> DataFrame:
    """What ``shape`` makes of ``release_packages`` of all months, row by row, written slice by slice.

    Tenders get their pages before releases are made, so that no window holds releases. With several
    slices releases are stored by a hash of their page, and each part is packed and removed.
    """
    spark = tender.sparkSession
    order = W.partitionBy("source_month").orderBy(F.concat(F.lit(prefix), F.col("nro_sicop")))
    paged = written(_with_page(tender.withColumn("n", F.row_number().over(order) - 1), size), "paged")
    parts = _slices(paged, (bid, bid_line, award, contract), most or SLICE)
    made = [lambda p=p: releases(*p, supplier, institution, prefix=prefix, keep=("n", "page")) for p in parts]
    if len(made) == 1:
        return together(spark, [lambda: shape(_packed(made[0](), published, publisher))], "packages")[1]
    n = F.lit(len(made))
    held, _ = together(spark, [lambda m=m: m().withColumn("part", F.pmod(F.xxhash64("source_month", "page"), n).cast("int")) for m in made], "paged-releases", by="part")

    def packs() -> Iterator[Callable[[], DataFrame]]:
        for name in [x for x in names_in(spark, held) if x.startswith("part=")]:
            yield lambda name=name: shape(_packed(spark.read.parquet(f"{held}/{name}"), published, publisher))
            remove(spark, f"{held}/{name}")

    return together(spark, packs(), "packages")[1]


def _with_page(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("page", F.floor(F.col("n") / size).cast("int"))


def release_packages(made: DataFrame, tender: DataFrame, published: str, publisher: str, month: str | None = None, size: int = 1000) -> DataFrame:
    """source_month, page, releases, package (JSON): releases packed by month, in order of ocid, so many to a page.

    made are releases() of the tenders. A page is one row; numbers within a month come from a window over that month.
    """
    rows = made.filter(F.col("source_month") == month) if month else made
    n = F.row_number().over(W.partitionBy("source_month").orderBy("ocid")) - 1
    return _packed(_with_page(rows.withColumn("n", n), size), published, publisher)


def _packed(paged: DataFrame, published: str, publisher: str) -> DataFrame:
    """Releases (with n and page) as packages."""
    packed = paged.groupBy("source_month", "page").agg(F.count("*").alias("releases"), F.array_sort(F.collect_list(F.struct("n", "release"))).alias("all"))
    head = F.to_json(F.struct(F.concat(F.lit("urn:package:"), F.col("source_month"), F.lit(":"), F.col("page").cast("string")).alias("uri"), F.lit("1.1").alias("version"), F.lit(published).alias("publishedDate"), F.struct(F.lit(publisher).alias("name")).alias("publisher")))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"releases":['), F.array_join(F.transform("all", lambda r: r["release"]), ","), F.lit("]}"))
    return packed.select("source_month", "page", "releases", body.alias("package"))
