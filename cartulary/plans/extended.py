"""Queries of archives and snapshots, whole reports, payloads, periods and anchors, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import exprs as E
from cartulary.functions import stats as S
from cartulary.operators import bundle, canonical, collusion, competition, delivery, differ, durations, index, merkle, prices, reports, snapshots, versions
from cartulary.plans.registry import ARCHIVES, AS_OF, BY_LINE, COMPANIES, DATES, FEED, PAIRS, SPREAD, _archives, _companies, _feed, _loaded, _observations, _records, _stages, query, r, wilson
from cartulary.schemas import CANON_VERSION
from cartulary.sources import archive
from cartulary.sources.lens import Lens
from cartulary.storage import alone, shared_folder, written

# Archives: written from orders, read again, made canonical, stored


def _published(t: Lens) -> DataFrame:
    """Orders as the rows of a published table, month by month; texts hold quotes, separators and line ends."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"; or'), F.when(k % 3 == 0, "\n").otherwise(","), F.lit("not"))
    amount = F.concat(F.round("o_totalprice").cast("long").cast("string"), F.lit(",50"))
    cells = F.array(k.cast("string"), title, amount, F.date_format("o_orderdate", "yyyy-MM-dd"))
    header = F.array(*map(F.lit, ("NRO_SICOP", "CARTEL_NM", "MONTO_EST", "FECHA_MOD")))
    period = F.date_format("o_orderdate", "yyyyMM")
    return t.raw("orders").select(period.alias("period"), F.concat(period, F.lit("28T120000Z")).alias("stamp"), F.lit("DetalleCarteles").alias("table"), k.alias("row_pos"), header.alias("header"), cells.alias("cells"))


def _mirror(t: Lens) -> tuple[str, DataFrame, DataFrame]:
    """Folder, records and headers of the archives."""
    folder = f"{shared_folder(t.spark)}/cartulary/mirror-{uuid.uuid4().hex}"
    archive.write_archives(_published(t), folder)
    made = written(snapshots.records_of(t.spark, folder, "cr"), "records")
    return folder, made, written(snapshots.headers_of(t.spark, folder, made, "cr"), "headers")


MIRROR = r"""cells AS (SELECT strftime(o_orderdate, '%Y%m') AS period, o_orderkey::VARCHAR AS id, 'say "' || o_orderpriority || '"; or' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE ',' END || 'not' AS title,
round(o_totalprice)::BIGINT::VARCHAR AS amount, strftime(o_orderdate, '%Y-%m-%d') AS changed FROM orders),
mirror AS (SELECT period, id, sha256('cartulary-canon-2' || chr(0) || 'DetalleCarteles' || chr(0) || id || chr(0) || 'CARTEL_NM' || chr(31) || title || chr(30) || 'FECHA_MOD' || chr(31) || changed || chr(30) || 'MONTO_EST' || chr(31) || amount || ',50' || chr(30) || 'NRO_SICOP' || chr(31) || id) AS byte_hash,
sha256('cartulary-canon-2' || chr(0) || 'DetalleCarteles' || chr(0) || id || chr(0) || 'CARTEL_NM' || chr(31) || title || chr(30) || 'MONTO_EST' || chr(31) || amount || '.5' || chr(30) || 'NRO_SICOP' || chr(31) || id) AS value_hash FROM cells),
leaf AS (SELECT period, row_number() OVER (PARTITION BY period ORDER BY id) - 1 AS idx, sha256('\x00'::BLOB || encode('DetalleCarteles' || chr(0) || id || chr(0) || byte_hash)) AS h, count(*) OVER (PARTITION BY period) AS n, id FROM mirror),
lv AS (SELECT 0 AS level, period, idx, h, n FROM leaf UNION ALL SELECT level + 1, period, idx // 2, CASE WHEN count(*) = 2 THEN sha256('\x01'::BLOB || unhex(arg_min(h, idx)) || unhex(arg_max(h, idx))) ELSE max(h) END, (any_value(n) + 1) // 2
FROM lv WHERE n > 1 GROUP BY level, period, idx // 2)"""


@query(f"WITH RECURSIVE {MIRROR} SELECT period, id, byte_hash, value_hash FROM mirror")
def archive_records(t: Lens) -> DataFrame:
    folder, made, _ = _mirror(t)
    period = F.regexp_extract("path", r"/([0-9]{6})/[^/]*$", 1)
    return made.select(period.alias("period"), "id", "byte_hash", "value_hash")


@query(f"""WITH RECURSIVE {MIRROR} SELECT 'cr' AS source, period, period || '28T120000Z' AS stamp, 'cartulary-canon-2' AS canon_version, h AS root, (SELECT count(*) FROM mirror m WHERE m.period = lv.period) AS records, 'DetalleCarteles' AS table_name,
substr(sha256('cartulary-canon-2' || chr(0) || 'schema' || chr(0) || 'DetalleCarteles' || chr(0) || array_to_string(['NRO_SICOP', 'CARTEL_NM', 'MONTO_EST', 'FECHA_MOD'], chr(30))), 1, 16) AS schema FROM lv WHERE n = 1""")
def snapshot_headers(t: Lens) -> DataFrame:
    _, made, heads = _mirror(t)
    folder = f"{shared_folder(t.spark)}/cartulary/snapshots-{uuid.uuid4().hex}"
    snapshots.store(folder, made, heads)
    found = snapshots.headers(t.spark, folder)
    return found.select("source", "period", "stamp", "canon_version", "root", "records", F.inline("tables")).select("source", "period", "stamp", "canon_version", "root", "records", F.col("table").alias("table_name"), "schema")


@query(f"WITH RECURSIVE {MIRROR} SELECT id, byte_hash, value_hash, 1::BIGINT AS rules FROM mirror WHERE period = (SELECT min(period) FROM mirror)")
def snapshot_load_or_build(t: Lens) -> DataFrame:
    folder, _, heads = _mirror(t)
    first = heads.agg(F.min(F.struct("period", "stamp")).alias("f")).first()["f"]
    held = f"{shared_folder(t.spark)}/cartulary/snapshots-{uuid.uuid4().hex}"
    snapshots.load_or_build(t.spark, held, folder, "cr", first["period"], first["stamp"])
    made = snapshots.load_or_build(t.spark, held, folder, "cr", first["period"], first["stamp"])
    rules = len(snapshots.stored(t.spark, held, "cr", first["period"], first["stamp"]))
    return made.select("id", "byte_hash", "value_hash", F.lit(rules).cast("long").alias("rules"))


@query(f"""WITH RECURSIVE {MIRROR}, up AS (SELECT period, id, idx AS leaf_index, idx AS i, n, 0 AS steps FROM leaf WHERE id::BIGINT % 50 = 0 UNION ALL SELECT period, id, leaf_index, i // 2, (n + 1) // 2, steps + (xor(i, 1) < n)::INT FROM up WHERE n > 1)
SELECT period, id, leaf_index, steps::BIGINT AS steps, true AS verified, CASE WHEN period::INT % 2 = 1 THEN '2024-01-15' END AS anchored_day FROM up WHERE n = 1""")
def proof_documents(t: Lens) -> DataFrame:
    _, made, heads = _mirror(t)
    odd = heads.filter(F.col("period").cast("int") % 2 == 1).select("period", "root")
    anchored = odd.withColumn("day", F.explode(F.array(F.lit("2024-02-01"), F.lit("2024-01-15"))))
    wanted = made.filter(F.col("id").cast("long") % 50 == 0)
    docs = snapshots.proof_documents(heads, made, wanted, anchored)
    checked = merkle.verified(docs.select("period", "id", "leaf_index", "anchored_day", F.size("path_up").cast("long").alias("n_steps"), "hash", F.col("path_up").alias("steps"), "root"))
    return checked.select("period", "id", "leaf_index", F.col("n_steps").alias("steps"), F.col("ok").alias("verified"), "anchored_day")


# Bundles


@query("""SELECT * FROM (VALUES ('digest', true), ('changes', true), ('lines', true), ('counts', true), ('policy', true), ('arithmetic', true), ('unique', true), ('earlier archive', true), ('later archive', true), ('earlier root', true), ('later root', true),
('rebuilt changes', true), ('rebuilt digest', true), ('published changes', true)) v(name, ok)""")
def bundle_checks(t: Lens) -> DataFrame:
    """A bundle without plain additions, written, read again and checked by itself and against both copies."""
    one, two = written(_records(t), "before"), written(_records(t, True), "after")
    lines = written(bundle.build(one, two, canonical.fields(one), canonical.fields(two), bundle.REVISIONS_ONLY), "lines")
    counts = {x["kind"]: x["changes"] for x in differ.kind_counts(differ.diff(one, two)).collect()}  # five rows
    heads = [{"stamp": stamp, "sha256": stamp, "root": merkle.root(df).first()["root"]} for stamp, df in (("20240101T000000Z", one), ("20240201T000000Z", two))]
    m = bundle.manifest(lines, counts, "cr", "202401", *heads, kinds=bundle.REVISIONS_ONLY, canon_version=CANON_VERSION)
    folder = bundle.folder_of(f"{shared_folder(t.spark)}/cartulary/bundles-{uuid.uuid4().hex}", "cr", "202401", heads[0]["stamp"], heads[1]["stamp"], CANON_VERSION)
    bundle.write(lines, m, folder)
    said, found = bundle.read(t.spark, folder)
    checks = bundle.verify(said, found) + bundle.verify_against(said, found, one, two, *heads)
    return t.spark.createDataFrame([(name, ok) for name, ok, _ in checks], "name string, ok boolean")


@query("SELECT 'orders' AS table_name, count(*) AS changes, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'silentRevision') AS silent, count(*) FILTER (kind = 'reformatted') AS reformatted, count(*) FILTER (kind = 'removed') AS removed FROM changes")
def table_summary(t: Lens) -> DataFrame:
    made = differ.table_summary(differ.diff(_records(t), _records(t, True)))
    return made.select(F.col("table").alias("table_name"), "changes", "added", F.col("silentRevision").alias("silent"), "reformatted", "removed")


@query("SELECT id FROM field_rows WHERE field = 'o_orderpriority'")
def bundle_filtered(t: Lens) -> DataFrame:
    one, two = written(_records(t), "before"), written(_records(t, True), "after")
    parsed = bundle.parsed(bundle.build(one, two, canonical.fields(one), canonical.fields(two), max_detail=None))
    return bundle.filtered(parsed, kind="silentRevision", table="orders", field="o_orderpriority", readable=True).select("id")


# Whole reports


@query(f"""WITH s AS (SELECT count(*) AS n, count(*) FILTER (bidders = 1) AS k FROM bidder_counts), w AS (SELECT n, k, {wilson('k', 'n')} FROM s),
d AS (SELECT count(*) AS published, count(*) FILTER (cartel_stat = 'Contrato') AS awarded, count(*) FILTER (cartel_stat = 'Desierto') AS no_award, count(*) FILTER (cartel_stat LIKE 'En%') AS in_progress FROM tender),
e AS (SELECT count(*) AS published, count(des_excepcion) AS with_exception, count(*) FILTER (des_excepcion LIKE 'escasa%') AS low_value, count(*) FILTER (des_excepcion NOT LIKE 'escasa%') AS substantive, count(*) FILTER (des_excepcion IS NULL AND cod_excepcion IS NOT NULL) AS undescribed FROM tender),
v AS (SELECT cedula_proveedor, sum(cantidad * precio_unitario) AS value FROM latest_award WHERE moneda = 'CRC' AND cantidad > 0 AND precio_unitario > 0 GROUP BY 1),
c AS (SELECT count(*) AS groups, sum(value) AS total, sum(value * value) / (sum(value) * sum(value)) * 10000 AS hhi, max(value) AS top FROM v),
rows AS (SELECT 'deserted' AS section, u.name, u.value::DOUBLE AS value FROM d, LATERAL (VALUES ('published', published::DOUBLE), ('awarded', awarded), ('no_award', no_award), ('annulled', 0), ('in_progress', in_progress), ('unclassified', 0), ('rate_of_published', no_award / published), ('rate_of_resolved', no_award / (awarded + no_award))) u(name, value)
UNION ALL SELECT 'exceptions', u.name, u.value FROM e, LATERAL (VALUES ('published', published::DOUBLE), ('with_exception', with_exception), ('low_value', low_value), ('substantive', substantive), ('undescribed_codes', undescribed), ('rate', with_exception / published), ('substantive_rate', substantive / published)) u(name, value)
UNION ALL SELECT 'concentration', u.name, u.value FROM c, LATERAL (VALUES ('groups', groups::DOUBLE), ('total', round(total, 2)), ('hhi', hhi), ('top_share', top / total), ('effective', 10000 / hhi), ('other_currency', (SELECT count(*) FROM latest_award WHERE moneda <> 'CRC')), ('no_amount', 0)) u(name, value)
UNION ALL SELECT 'single_bidder', u.name, u.value FROM w, LATERAL (VALUES ('tenders_with_bids', n::DOUBLE), ('single_bidder', k), ('rate', k / n), ('ci_low', ci_low), ('ci_high', ci_high)) u(name, value)
UNION ALL SELECT 'bidders', CASE i WHEN 4 THEN '4+' ELSE i::VARCHAR END, (SELECT count(*) FROM bidder_counts WHERE least(bidders, 4) = i) FROM range(1, 5) x(i)
UNION ALL SELECT 'orphans', 'orphan_tenders', count(DISTINCT nro_sicop) FROM bid WHERE nro_sicop NOT IN (SELECT nro_sicop FROM tender)
UNION ALL SELECT 'coverage', 'without_bids', (SELECT count(*) FROM tender) - (SELECT count(DISTINCT nro_sicop) FROM bid WHERE nro_sicop IN (SELECT nro_sicop FROM tender)))
SELECT section, name, round(value, 5) AS value FROM rows""")
def competition_report(t: Lens) -> DataFrame:
    return reports.competition_report(t.bid, t.tender, t.award_line).withColumn("value", r("value", digits=5))


@query(f"""WITH {PAIRS}, {SPREAD.replace('l.moneda = w.moneda', 'l.moneda = w.moneda AND l.codigo_producto = w.codigo_producto')}, size AS (SELECT nro_sicop, any_value(cedula_institucion) AS i, min(cedula_proveedor) AS s, count(*) AS n FROM tender_bidders GROUP BY 1),
sets AS (SELECT nro_sicop, list_sort(list(cedula_proveedor)) AS m FROM tender_bidders GROUP BY 1), groups AS (SELECT m, count(*) AS tenders, list(nro_sicop) AS ids FROM sets WHERE len(m) >= 2 GROUP BY 1),
seen AS (SELECT cedula_proveedor, count(*) AS appearances FROM tender_bidders GROUP BY 1), kept AS (SELECT * FROM groups WHERE tenders >= 4 AND len(m) >= 3),
ex AS (SELECT m, min(tenders / appearances) AS x FROM (SELECT m, tenders, unnest(m) AS c FROM kept) JOIN seen ON c = cedula_proveedor GROUP BY 1),
wn AS (SELECT m, count(DISTINCT winner) AS winners FROM (SELECT m, unnest(ids) AS nro_sicop FROM kept) JOIN tender_winners USING (nro_sicop) GROUP BY 1),
tail AS (SELECT n, k, sum(c) OVER (PARTITION BY n ORDER BY k DESC) AS p FROM (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) AS c FROM (SELECT DISTINCT encounters AS n FROM pairs) a, LATERAL (SELECT unnest(range(0, n + 1)) AS k) b)),
spread AS (SELECT winner, loser, count(DISTINCT nro_sicop) AS tenders, quantile_cont(gap, 0.5) AS med, CASE WHEN count(*) >= 2 THEN stddev_samp(gap) / abs(avg(gap)) END AS cv FROM gaps GROUP BY 1, 2),
sole AS (SELECT s, i, count(*) AS k FROM size WHERE n = 1 GROUP BY 1, 2)
SELECT 'bid-rotation' AS screen, (SELECT count(*) FROM size WHERE n >= 2) AS population, (SELECT count(*) FROM groups) AS tests, (SELECT count(*) FROM ex JOIN wn USING (m) WHERE x >= 0.25 AND winners >= 2) AS hits, '' AS missing
UNION ALL SELECT 'consistent-losing', (SELECT count(*) FROM size WHERE n >= 2 AND nro_sicop IN (SELECT nro_sicop FROM tender_winners)), (SELECT count(*) FROM pairs), (SELECT count(*) FROM pairs JOIN tail ON n = encounters AND k = greatest(a_wins, b_wins) WHERE p * (SELECT count(*) FROM pairs) <= 0.05), ''
UNION ALL SELECT 'bid-spread', (SELECT count(*) FROM gaps), (SELECT count(*) FROM spread), (SELECT count(*) FROM spread WHERE tenders >= 5 AND med >= 0.5 AND cv < 0.2), ''
UNION ALL SELECT 'single-bidder-concentration', (SELECT count(*) FROM size), (SELECT count(DISTINCT (cedula_proveedor, cedula_institucion)) FROM tender_bidders), (SELECT count(*) FROM sole WHERE k >= 3), ''""")
def collusion_report(t: Lens) -> DataFrame:
    """The four screens with their default guards."""
    return collusion.report(t.bid, t.bid_line, t.award_line, t.tender, t.institution)


@query(f"""WITH {PAIRS}, h AS (SELECT a, b FROM pairs), met AS (SELECT h.a, h.b, x.nro_sicop, x.cedula_institucion FROM h JOIN tender_bidders x ON x.cedula_proveedor = h.a JOIN tender_bidders y ON y.nro_sicop = x.nro_sicop AND y.cedula_proveedor = h.b
LEFT JOIN tender_winners xw ON xw.nro_sicop = x.nro_sicop AND xw.winner = h.a LEFT JOIN tender_winners yw ON yw.nro_sicop = x.nro_sicop AND yw.winner = h.b WHERE (xw.winner IS NULL) <> (yw.winner IS NULL)),
goods AS (SELECT DISTINCT a, b, codigo_producto FROM met JOIN bid_line l ON l.nro_sicop = met.nro_sicop AND l.nro_oferta IN (a, b))
SELECT a, b, array_to_string(list_sort(list(DISTINCT nro_sicop)), ',') AS tenders, array_to_string(list_sort(list(DISTINCT cedula_institucion)), ',') AS institutions,
(SELECT array_to_string(list_sort(list(codigo_producto))[1:25], ',') FROM goods g WHERE g.a = met.a AND g.b = met.b) AS codes FROM met GROUP BY a, b""")
def losing_evidence(t: Lens) -> DataFrame:
    hits = collusion.consistent_losing(t.bid, t.award_line, t.tender, alpha=1.0)
    made = collusion.losing_evidence(hits, t.bid, t.bid_line, t.award_line, t.tender)
    return made.select(F.least("loser", "winner").alias("a"), F.greatest("loser", "winner").alias("b"), *[F.array_join(c, ",").alias(c) for c in ("tenders", "institutions", "codes")])


@query(f"""WITH {SPREAD}, k AS (SELECT winner, loser FROM gaps GROUP BY 1, 2 HAVING count(DISTINCT nro_sicop) >= 2 AND quantile_cont(gap, 0.5) >= 0.5), n AS (SELECT winner, loser, nro_sicop, nro_linea, gap, row_number() OVER (PARTITION BY winner, loser ORDER BY nro_sicop, nro_linea, gap) AS place FROM gaps)
SELECT winner, loser, place, nro_sicop, nro_linea, round(gap, 6) AS gap_pct FROM n JOIN k USING (winner, loser) WHERE place <= 20""")
def spread_evidence(t: Lens) -> DataFrame:
    made = collusion.bid_spread(t.bid, t.bid_line, t.award_line, t.tender, min_tenders=2, keep_unscored=True, same=BY_LINE)
    return made.select("winner", "loser", F.inline("gaps")).select("winner", "loser", F.col("n").cast("long").alias("place"), "nro_sicop", "nro_linea", r("gap_pct"))


@query("""WITH a AS (SELECT cedula_proveedor, count(*) AS appearances, count(*) FILTER (decided) AS decided, count(*) FILTER (won) AS won, count(DISTINCT period) AS periods, count(DISTINCT cedula_institucion) AS institutions FROM appearances GROUP BY 1),
rv AS (SELECT cedula_proveedor, rival, count(*) AS times FROM lost GROUP BY 1, 2), top AS (SELECT cedula_proveedor, count(*) AS rivals, list(rival ORDER BY times DESC, rival)[1] AS top_rival, max(times) AS top_times FROM rv GROUP BY 1),
p AS (SELECT nro_oferta AS cedula_proveedor, count(DISTINCT codigo_producto) AS products FROM bid_line WHERE nro_sicop IN (SELECT nro_sicop FROM tender) GROUP BY 1),
ap AS (SELECT cedula_proveedor, count(*) AS appeals FROM (SELECT cedula_proveedor, resultado, count(DISTINCT nro_recurso) AS n FROM appeal GROUP BY 1, 2) GROUP BY 1),
every AS (SELECT cedula_proveedor FROM a UNION SELECT cedula_proveedor FROM supplier_t UNION SELECT cedula_proveedor FROM ap UNION SELECT cedula_proveedor FROM sanction)
SELECT e.cedula_proveedor, s.nombre, appearances, decided, won, CASE WHEN decided > 0 THEN round(won / decided, 6) END AS rate, coalesce(periods, 0) AS periods, least(coalesce(rivals, 0), 15) AS rivals, top_rival, top_times, least(coalesce(products, 0), 15) AS products, least(coalesce(institutions, 0), 15) AS institutions,
coalesce(appeals, 0) AS appeals, (SELECT count(*) FROM sanction x WHERE x.cedula_proveedor = e.cedula_proveedor) AS own_sanctions
FROM every e LEFT JOIN a USING (cedula_proveedor) LEFT JOIN top USING (cedula_proveedor) LEFT JOIN p USING (cedula_proveedor) LEFT JOIN ap USING (cedula_proveedor) LEFT JOIN supplier_t s USING (cedula_proveedor)""")
def supplier_profiles(t: Lens) -> DataFrame:
    made = alone(t.spark, lambda: reports.supplier_profiles(t.bid, t.bid_line, t.award_line, t.tender, t.institution, t.supplier, t.appeal, t.sanction), "profiles")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    first = F.get("beaten_by", F.lit(0))
    return made.select("cedula_proveedor", "nombre", "overall.appearances", "overall.decided", "overall.won", r(F.col("overall.rate"), "rate"), size("by_period").alias("periods"), size("beaten_by").alias("rivals"), first["rival"].alias("top_rival"), first["times"].alias("top_times"), size("products").alias("products"), size("institutions").alias("institutions"), size("appeals").alias("appeals"), "own_sanctions")


@query("SELECT trim(upper(cartel_stat)) AS status, count(*) AS tenders FROM tender GROUP BY 1")
def unclassified_statuses(t: Lens) -> DataFrame:
    """Every text in capitals is one that no class covers, but for those that name an empty outcome in any case."""
    shouted = t.tender.withColumn("cartel_stat", F.concat(F.lit(" "), F.upper("cartel_stat"), F.lit(" ")))
    found = reports.unclassified_statuses(shouted)
    rest = competition.status_rollup(shouted).filter("status_class = 'noAward'").select("status", "tenders")
    return found.unionByName(rest)


@query("SELECT '1998-08-07' AS as_of, 'loaded_archive' AS source UNION ALL SELECT strftime(max(publicacion), '%Y-%m-%d'), 'stage_dates' FROM stage_dates")
def as_of_day(t: Lens) -> DataFrame:
    ledger = t.spark.createDataFrame([("19980807T101500Z",), ("19980706T000000Z",)], "archive_stamp string")
    return reports.as_of(ledger, t.stage_dates).unionByName(reports.as_of(ledger.limit(0), t.stage_dates))


@query("SELECT 'empty' AS name UNION ALL SELECT 'none'")
def missing_inputs(t: Lens) -> DataFrame:
    names = reports.missing_inputs({"tender": t.tender, "empty": t.bid.limit(0), "bid": t.bid, "none": t.tender.filter("nro_sicop is null")})
    return t.spark.createDataFrame([(n,) for n in names], "name string")


# Payloads


@query("SELECT kind, count(*) AS changes FROM changes GROUP BY 1")
def feed_by_kind(t: Lens) -> DataFrame:
    return delivery.by_kind(_feed(t))


@query(f"WITH {FEED} SELECT id, kind FROM feed JOIN tender ON nro_sicop = id WHERE cedula_institucion = '3'")
def feed_of_institution(t: Lens) -> DataFrame:
    made = delivery.subjects(delivery.static_subject(_feed(t)), t.tender, t.bid, t.award_line, t.bid_line)
    return delivery.feed(made, institution="3").select("id", "kind")


@query("SELECT u.name, u.rows FROM (SELECT (SELECT count(*) FROM tender) AS a, (SELECT count(*) FROM contract) AS b, (SELECT count(*) FROM supplier_t) AS c, (SELECT count(*) FROM institution) AS d, (SELECT count(*) FROM appeal) AS e), LATERAL (VALUES ('tender', a), ('contract', b), ('supplier', c), ('institution', d), ('appeal', e)) u(name, rows)")
def index_counts(t: Lens) -> DataFrame:
    return delivery.counts({"tender": t.tender, "contract": t.contract, "supplier": t.supplier, "institution": t.institution, "appeal": t.appeal})


@query(f"""WITH {COMPANIES}, g AS (SELECT norm_name, serial, count(*) AS n FROM co GROUP BY 1, 2), cons AS (SELECT id_consorcio, count(DISTINCT cedula_proveedor) AS n FROM bid WHERE id_consorcio IS NOT NULL GROUP BY 1)
SELECT 'group' AS kind, count(*) AS entities, sum(n)::BIGINT AS members FROM g WHERE n >= 2 HAVING count(*) > 0 UNION ALL SELECT 'supplier', count(*), count(*) FROM g WHERE n = 1 HAVING count(*) > 0 UNION ALL SELECT 'consortium', count(*), sum(n)::BIGINT FROM cons HAVING count(*) > 0""")
def entity_kinds(t: Lens) -> DataFrame:
    entity, _ = index.resolve(index.with_names(_companies(t)), t.bid)
    return delivery.entity_kinds(entity)


@query(f"""WITH {DATES} SELECT t.nro_sicop, t.cedula_institucion, i.nombre, t.cartel_stat, published, opens, awarded, coalesce(b.n, 0) AS bids, coalesce(l.n, 0) AS bid_lines, coalesce(w.n, 0) AS award_lines, coalesce(c.n, 0) AS contracts, '/proof/DetalleCarteles/' || t.nro_sicop AS proof
FROM tender t LEFT JOIN institution i ON i.cedula = t.cedula_institucion JOIN dates d ON d.nro_sicop = t.nro_sicop LEFT JOIN (SELECT nro_sicop, count(*) AS n FROM bid GROUP BY 1) b ON b.nro_sicop = t.nro_sicop LEFT JOIN (SELECT nro_sicop, count(*) AS n FROM bid_line GROUP BY 1) l ON l.nro_sicop = t.nro_sicop
LEFT JOIN (SELECT nro_sicop, count(*) AS n FROM award_line GROUP BY 1) w ON w.nro_sicop = t.nro_sicop LEFT JOIN (SELECT nro_sicop, count(*) AS n FROM contract GROUP BY 1) c ON c.nro_sicop = t.nro_sicop""")
def tender_entities(t: Lens) -> DataFrame:
    made = delivery.tender_entities(t.tender, t.bid, t.bid_line, t.award_line, t.contract, None, t.institution, delivery.key_dates(t.tender, t.stage_dates))
    return made.select("nro_sicop", "cedula_institucion", "nombre", "cartel_stat", "published", "opens", "awarded", "bids", "bid_lines", "award_lines", "contracts", "proof")


@query("""SELECT '7' AS cedula, (SELECT nombre FROM supplier_t WHERE cedula_proveedor = '7') AS nombre, (SELECT count(*) FROM bid WHERE cedula_proveedor = '7') AS n_bids, (SELECT count(*) FROM award_line WHERE cedula_proveedor = '7') AS n_awards, (SELECT count(*) FROM contract WHERE cedula_proveedor = '7') AS n_contracts,
(SELECT count(*) FROM appeal WHERE cedula_proveedor = '7') AS n_appeals, (SELECT count(*) FROM sanction WHERE cedula_proveedor = '7') AS n_sanctions, (SELECT max(fecha_notificacion) FROM contract WHERE cedula_proveedor = '7') AS last_notice""")
def supplier_entity(t: Lens) -> DataFrame:
    made = delivery.supplier_entity("7", t.supplier, t.bid, t.award_line, t.contract, t.appeal, t.sanction)
    return made.select("cedula", "nombre", "n_bids", "n_awards", "n_contracts", "n_appeals", "n_sanctions", F.get("contracts", F.lit(0))["fecha_notificacion"].alias("last_notice"))


@query("""WITH m AS (SELECT * FROM tender WHERE cedula_institucion = '3') SELECT '3' AS cedula, (SELECT nombre FROM institution WHERE cedula = '3') AS nombre, (SELECT count(*) FROM m) AS n_tenders, (SELECT nro_sicop FROM m ORDER BY fecha_publicacion DESC, nro_sicop LIMIT 1) AS newest, (SELECT count(*) FROM contract WHERE nro_sicop IN (SELECT nro_sicop FROM m)) AS n_contracts""")
def institution_entity(t: Lens) -> DataFrame:
    made = delivery.institution_entity("3", t.institution, t.tender, t.contract)
    return made.select("cedula", "nombre", "n_tenders", F.get("tenders", F.lit(0))["nro_sicop"].alias("newest"), "n_contracts")


@query(f"WITH {ARCHIVES} SELECT source, period, count(*) AS versions, array_to_string(list_sort(list(stamp)), ',') AS stamps FROM arch GROUP BY 1, 2")
def months_held(t: Lens) -> DataFrame:
    return delivery.months(_archives(t)).withColumn("stamps", F.array_join("stamps", ","))


@query(f"WITH {ARCHIVES} SELECT 'ok' AS status, 'ready' AS index, count(*) AS snapshots FROM arch")
def health(t: Lens) -> DataFrame:
    return delivery.health({"tender": t.tender, "bid": t.bid}, _archives(t))


@query(f"""WITH {ARCHIVES}, p AS (SELECT period, min(stamp) AS a, max(stamp) AS b FROM arch GROUP BY 1 HAVING count(*) > 1) SELECT period, CASE WHEN period::INT % 3 = 0 THEN NULL WHEN period::INT % 5 = 0 THEN sha256('other' || period) ELSE sha256('bundle' || period) END AS recorded_digest,
CASE WHEN period::INT % 3 = 0 THEN NULL ELSE period::INT % 5 <> 0 END AS digest_matches FROM p""")
def bundle_status(t: Lens) -> DataFrame:
    """Bundles of the months held twice against those on record: a third isn't there, a fifth has another digest."""
    a = _archives(t)
    both = a.groupBy("period").agg(F.min(F.struct("stamp", "sha256")).alias("x"), F.max(F.struct("stamp", "sha256")).alias("y"), F.count("*").alias("n")).filter("n > 1")
    k = F.col("period").cast("int")
    mine = both.select("period", F.col("x.sha256").alias("from_sha256"), F.col("y.sha256").alias("to_sha256"), F.sha2(F.concat(F.lit("bundle"), "period"), 256).alias("digest"), F.lit(2).alias("canon"))
    zero = [F.lit(0).alias(c) for c in ("added", "recorded_amendment", "silent_revision", "reformatted", "removed")]
    sent = mine.filter(k % 3 != 0).select("period", "from_sha256", "to_sha256", F.when(k % 5 == 0, F.sha2(F.concat(F.lit("other"), "period"), 256)).otherwise(F.col("digest")).alias("digest"), F.lit(CANON_VERSION).alias("canon_version"), F.lit("cartulary-bundle-2").alias("bundle_version"), F.lit("").alias("changes_sha256"), *zero)
    recorded = versions.parse_diffs(versions.diff_entries(sent))
    return delivery.bundle_status(mine, recorded).select("period", "recorded_digest", "digest_matches")


@query("""SELECT 'ocds-x-' || t.nro_sicop AS ocid, source_month, CASE cartel_stat WHEN 'Contrato' THEN 'complete' WHEN 'Desierto' THEN 'unsuccessful' ELSE 'active' END AS status, fecha_publicacion || 'T00:00:00Z' AS start_date,
(SELECT count(DISTINCT nro_linea) FROM bid_line b WHERE b.nro_sicop = t.nro_sicop) AS items, (SELECT count(DISTINCT (nro_acto, cedula_proveedor)) FROM latest_award a WHERE a.nro_sicop = t.nro_sicop) AS awards,
(SELECT count(DISTINCT nro_contrato) FROM contract c WHERE c.nro_sicop = t.nro_sicop) AS contracts, (SELECT count(*) FROM bid b WHERE b.nro_sicop = t.nro_sicop) AS offers,
1 + (SELECT count(DISTINCT cedula_proveedor) FROM (SELECT cedula_proveedor FROM bid b WHERE b.nro_sicop = t.nro_sicop UNION SELECT cedula_proveedor FROM award_line a WHERE a.nro_sicop = t.nro_sicop UNION SELECT cedula_proveedor FROM contract c WHERE c.nro_sicop = t.nro_sicop) x WHERE cedula_proveedor <> t.cedula_institucion) AS parties FROM tender t""")
def release_figures(t: Lens) -> DataFrame:
    """What the releases' JSON says, read back from it."""
    body = F.from_json("release", "ocid string, tender struct<status:string,items:array<struct<id:string>>,tenderPeriod:struct<startDate:string>,numberOfTenderers:long>, awards array<struct<id:string>>, contracts array<struct<id:string>>, parties array<struct<id:string>>").alias("j")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    shape = lambda made: made.select("source_month", body).select("j.ocid", "source_month", "j.tender.status", F.col("j.tender.tenderPeriod.startDate").alias("start_date"), size("j.tender.items").alias("items"), size("j.awards").alias("awards"), size("j.contracts").alias("contracts"), F.coalesce("j.tender.numberOfTenderers", F.lit(0)).alias("offers"), size("j.parties").alias("parties"))
    return delivery.releases_in_slices(*_released(t), shape=shape)


def _released(t: Lens) -> tuple[DataFrame, ...]:
    """The tables that releases are made of."""
    contract = t.contract.withColumn("cedula_institucion", F.lit(None).cast("string"))
    return t.tender, t.bid, t.bid_line, t.award_line, contract, t.supplier, t.institution


def _releases(t: Lens) -> DataFrame:
    return delivery.releases(*_released(t))


@query("""WITH n AS (SELECT source_month, ((row_number() OVER (PARTITION BY source_month ORDER BY 'ocds-x-' || nro_sicop) - 1) // 100)::INT AS page, 'ocds-x-' || nro_sicop AS ocid FROM tender)
SELECT source_month, page, count(*) AS releases, min(ocid) AS first_ocid, 'urn:package:' || source_month || ':' || page AS uri FROM n GROUP BY 1, 2""")
def release_packages(t: Lens) -> DataFrame:
    body = F.from_json("package", "uri string, version string, releases array<struct<ocid:string>>").alias("j")
    shape = lambda made: made.select("source_month", "page", "releases", body).select("source_month", "page", "releases", F.get("j.releases", F.lit(0))["ocid"].alias("first_ocid"), "j.uri")
    return delivery.packages_in_slices(*_released(t), "2024-01-01T00:00:00Z", "cartulary", size=100, shape=shape)


# Index


@query("""SELECT nro_sicop, nro_linea, source_month, codigo_producto FROM (SELECT *, row_number() OVER (PARTITION BY nro_sicop, nro_linea ORDER BY source_month DESC, codigo_producto::BIGINT DESC) AS rn FROM bid_line) WHERE rn = 1""")
def index_load_range(t: Lens) -> DataFrame:
    """The fold of all months in two loads, the second of which finds the first in the ledger; saved and read between them."""
    rows = _loaded(t).drop("load_seq").withColumn("archive_stamp", F.concat("source_month", F.lit("28T000000Z"))).withColumn("sha256", F.sha2("source_month", 256))
    folder = f"{shared_folder(t.spark)}/cartulary/index-{uuid.uuid4().hex}"
    none = t.spark.createDataFrame([], "source_month string, archive_stamp string")
    first, entries = index.load_range(None, rows.filter("source_month < '199506'"), "bid_line", none)
    index.save(t.spark, folder, "bid_line", first)
    ledger = written(entries, "ledger")
    second, more = index.load_range(t.spark.read.parquet(f"{folder}/bid_line"), rows, "bid_line", ledger)
    if more.join(ledger, ["source_month", "archive_stamp"]).limit(1).count():
        raise ValueError("an archive was loaded twice")
    index.save(t.spark, folder, "bid_line", second)
    return t.spark.read.parquet(f"{folder}/bid_line").select("nro_sicop", "nro_linea", "source_month", "codigo_producto")


@query("SELECT DISTINCT source_month FROM tender WHERE source_month >= '199601'")
def not_loaded(t: Lens) -> DataFrame:
    archives = t.tender.select("source_month", F.lit("s").alias("archive_stamp")).distinct()
    return index.not_loaded(archives, archives.filter("source_month < '199601'")).select("source_month")


@query(f"WITH {COMPANIES} SELECT serial, count(DISTINCT norm_name) AS names FROM (SELECT serial, norm_name FROM co UNION ALL SELECT serial, 'OTRA' FROM co WHERE k % 6 = 0) GROUP BY 1 HAVING count(DISTINCT norm_name) > 1")
def serial_collisions(t: Lens) -> DataFrame:
    people = _companies(t)
    other = t.raw("supplier").filter("s_suppkey % 6 = 0").select(F.concat(F.lit("3105"), F.lpad(F.floor(F.col("s_suppkey") / 2).cast("string"), 6, "0")).alias("cedula"), F.lit("Otra").alias("nombre"))
    return index.serial_collisions(index.with_names(people.unionByName(other)))


# Watch reports


REPORTS = "SELECT kind, id, strftime(DATE '2024-01-01' + (id::BIGINT % 5)::INT, '%Y-%m-%d') || 'T06:00:00Z' AS ran_at, CASE WHEN id::BIGINT % 2 = 0 THEN '202312' ELSE '202401' END AS month FROM changes"


def _reports(t: Lens) -> DataFrame:
    """Changes as watch reports, a JSON file for each of five days, written and read again; another file lies among them."""
    c = differ.diff(_records(t), _records(t, True))
    k = F.col("id").cast("long")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 5).cast("int")), "yyyy-MM-dd'T06:00:00Z'")
    change = F.struct("kind", "table", "id", F.col("before.byte_hash").alias("beforeHash"), F.col("after.byte_hash").alias("afterHash"))
    found = c.select(day.alias("ran_at"), F.when(k % 2 == 0, "202312").otherwise("202401").alias("month"), change.alias("c")).groupBy("ran_at", "month").agg(F.collect_list("c").alias("changes"))
    made = found.groupBy("ran_at").agg(F.collect_list(F.struct("month", (F.col("month") == "202312").alias("closed_month"), "changes")).alias("findings")).withColumn("source", F.lit("cr"))
    folder = f"{shared_folder(t.spark)}/cartulary/reports-{uuid.uuid4().hex}"
    made.repartition(5, "ran_at").write.option("maxRecordsPerFile", 1).json(folder)
    t.spark.createDataFrame([("not a report",)], "value string").write.mode("append").text(folder)
    return delivery.read_reports(t.spark, folder)


@query(f"WITH r AS ({REPORTS}) SELECT ran_at AS detected_at, month, month = '202312' AS closed_month, kind, id FROM r")
def flattened_reports(t: Lens) -> DataFrame:
    return delivery.flatten(_reports(t)).select("detected_at", "month", "closed_month", "kind", "id")


@query(f"WITH r AS ({REPORTS}) SELECT substr(ran_at, 1, 10) AS day, count(DISTINCT month) AS months_checked, array_to_string(list_sort(list(DISTINCT month)), ',') AS months_updated, count(*) AS changes FROM r GROUP BY 1")
def report_summaries(t: Lens) -> DataFrame:
    made = delivery.report_summaries(_reports(t))
    return made.select("day", F.col("months_checked").cast("long").alias("months_checked"), F.array_join("months_updated", ",").alias("months_updated"), F.col("changes").cast("long").alias("changes"))


# Periods, stamps, numbers


@query("""WITH e AS (SELECT event_id, event_id % 4 AS f, 1 + event_id % 28 AS d, 1 + event_id % 12 AS m, 1990 + event_id % 30 AS y FROM events)
SELECT event_id, CASE WHEN f = 3 THEN NULL ELSE printf('%04d-%02d-%02d', y, m, d) END AS day, CASE WHEN f = 3 THEN NULL ELSE printf('%04d-%02d-%02d', y, m, d) END AS from_compact FROM e""")
def dates_normalised(t: Lens) -> DataFrame:
    """Dates as ISO with a time, day first with either mark, and text that is none."""
    k = F.col("event_id")
    y, m, d = (1990 + k % 30).cast("string"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lpad((1 + k % 28).cast("string"), 2, "0")
    raw = F.when(k % 4 == 0, F.concat_ws("-", y, m, F.concat(d, F.lit(" 10:00:00")))).when(k % 4 == 1, F.concat_ws("/", d, m, y)).when(k % 4 == 2, F.concat(F.lit(" "), F.concat_ws("-", d, m, y), F.lit(" "))).otherwise(F.lit("31 de mayo"))
    packed = F.when(k % 4 == 3, F.lit("00999999")).otherwise(F.concat(d, m, y))
    rows = t.raw("events").select("event_id", raw.alias("raw"), packed.alias("packed"))
    return rows.select("event_id", E.iso_date("raw").alias("day"), E.compact_date("packed").alias("from_compact"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id / 100.0 WHEN 1 THEN event_id + 0.5 WHEN 2 THEN -event_id * 1000.0 END::DOUBLE AS value, event_id % 5 > 1 AS filled FROM events""")
def numbers_parsed(t: Lens) -> DataFrame:
    k = F.col("event_id")
    cents = F.format_string("%d.%02d", F.floor(k / 100), k % 100)
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), cents)).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(",5"))).when(k % 4 == 2, F.concat(F.lit("-"), k.cast("string"), F.lit("e3"))).otherwise(F.lit("12 colones"))
    text = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "  ").otherwise("x")
    return t.raw("events").select("event_id", E.number(raw).alias("value"), E.filled(text).alias("filled"))


@query("""WITH e AS (SELECT event_id, (event_id % 100000)::DECIMAL(38,0) AS a, (event_id % 7 * 13 % 97)::DECIMAL(38,0) AS b FROM events), d AS (SELECT event_id, b * 1000000000000000000 + 5 - (a * 1000000000000000000 + 5) AS x FROM e)
SELECT event_id, CASE WHEN x > 0 THEN '+' ELSE '' END || x::VARCHAR AS delta FROM d""")
def exact_deltas(t: Lens) -> DataFrame:
    """Differences of numbers that doubles can't hold."""
    k = F.col("event_id")
    a = F.concat((k % 100000).cast("string"), F.lit("000000000000000005"))
    b = F.concat((k % 7 * 13 % 97).cast("string"), F.lit("000000000000000005,00"))
    return t.raw("events").select("event_id", E.delta(a, b).alias("delta"))


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS period FROM orders), e AS (SELECT min(period) AS a, max(period) AS b FROM m)
SELECT 'month' AS grain, strftime(d, '%Y%m') AS period FROM e, LATERAL (SELECT unnest(generate_series(strptime(a || '01', '%Y%m%d'), strptime(b || '01', '%Y%m%d'), INTERVAL 1 MONTH)) AS d)
UNION ALL SELECT 'year', y::VARCHAR FROM e, LATERAL (SELECT unnest(range(substr(a, 1, 4)::INT, substr(b, 1, 4)::INT + 1)) AS y)""")
def period_ranges(t: Lens) -> DataFrame:
    ends = t.raw("orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    month = ends.select(F.lit("month").alias("grain"), F.explode(E.periods(E.current_period("a"), E.current_period("b"))).alias("period"))
    year = ends.select(F.lit("year").alias("grain"), F.explode(E.periods(E.current_period("a", True), E.current_period("b", True), True)).alias("period"))
    return month.unionByName(year)


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http_date FROM events")
def stamps(t: Lens) -> DataFrame:
    text = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    rows = t.raw("events").select("event_id", E.compact_stamp(text).alias("stamp"))
    return rows.withColumn("http_date", E.http_date("stamp"))


@query("""WITH c AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS k FROM orders GROUP BY 1), d AS (SELECT DISTINCT n, k FROM c),
g AS (SELECT DISTINCT n, unnest(range(0, n + 1)) AS i FROM d), p AS (SELECT n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(1 / 3) + (n - i) * ln(2 / 3)) AS third, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS fair FROM g),
s AS (SELECT n, i AS k, least(1.0, sum(third) OVER w) AS tail, least(1.0, sum(fair) OVER w) AS fair_tail FROM p WINDOW w AS (PARTITION BY n ORDER BY i DESC))
SELECT c, n, k, round(lgamma(n + 1), 6) AS log_factorial, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1), 6) AS log_choose, round(tail, 6) AS tail, round(fair_tail, 6) AS fair_tail FROM c JOIN s USING (n, k)""")
def binomial_table(t: Lens) -> DataFrame:
    """Large orders among those of each customer: how likely so many or more would be."""
    g = t.raw("orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("k"))
    n, k = F.col("n"), F.col("k")
    return g.select("c", "n", "k", r(S.log_factorial(n), "log_factorial"), r(S.log_choose(n, k), "log_choose"), r(S.binomial_tail_at(k, n, 1 / 3), "tail"), r(S.binomial_tail(k, n), "fair_tail"))


# Anchors


@query(f"""WITH {ARCHIVES}, s AS (SELECT * FROM arch WHERE stamp < '19980101'), l AS (SELECT DISTINCT ON (period) * FROM s ORDER BY period, stamp DESC), p AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS n FROM l),
e AS (SELECT n // 4 AS batch, n % 4 * 2 + u.o AS place, u.key, u.value FROM p, LATERAL (VALUES (0, 'root_cr_1998-01-01_' || period, root), (1, 'meta_cr_1998-01-01_' || period, 'cartulary-canon-2|' || records || '|' || sha256)) u(o, key, value)
UNION ALL SELECT max(n) // 4, max(n) % 4 * 2 + 2, 'latest_cr', '1998-01-01' FROM p) SELECT batch::BIGINT AS batch, place::BIGINT AS place, key, value FROM e""")
def day_anchor_plan(t: Lens) -> DataFrame:
    held = versions.newest(_archives(t).filter("stamp < '19980101'"))
    return versions.day_plan(versions.checked(versions.day_entries("1998-01-01", held, "cr")), 9).select("batch", "place", "key", "value")


@query(f"WITH {ARCHIVES}, l AS (SELECT DISTINCT ON (period) * FROM arch ORDER BY period, stamp DESC) SELECT 'cr' AS ns, '1998-01-01' AS day, period, root, 'cartulary-canon-2' AS canon_version, records, sha256 FROM l")
def day_anchor_parse(t: Lens) -> DataFrame:
    return versions.parse_days(versions.day_entries("1998-01-01", versions.newest(_archives(t)), "cr"))


@query(f"""WITH {ARCHIVES}, e AS (SELECT 'ver_cr_' || period AS key FROM arch) SELECT key, count(*) AS times FROM e GROUP BY 1 HAVING count(*) > 1""")
def anchor_repeated_keys(t: Lens) -> DataFrame:
    return versions.repeated_keys(_archives(t).select(F.concat(F.lit("ver_cr_"), "period").alias("key")))


@query("""WITH v AS (SELECT source, period, sha256 FROM observations GROUP BY 1, 2, 3), p AS (SELECT source, period, count(*) AS versions FROM v GROUP BY 1, 2), o AS (SELECT source, count(*) AS observations, coalesce(sum(content_length) FILTER (status = 'stored'), 0)::BIGINT AS bytes FROM observations GROUP BY 1)
SELECT source, count(*) AS periods, sum(versions)::BIGINT AS versions, any_value(observations) AS observations, count(*) FILTER (versions > 1) AS rewritten, any_value(bytes) AS bytes FROM p JOIN o USING (source) GROUP BY 1""")
def archive_survey(t: Lens) -> DataFrame:
    return versions.survey(_observations(t))


@query(f"WITH {ARCHIVES} SELECT period, min(stamp) AS first, max(stamp) AS second FROM arch WHERE period = (SELECT max(period) FROM arch WHERE period::INT % 2 = 1) GROUP BY 1")
def version_pair(t: Lens) -> DataFrame:
    a = _archives(t)
    period = a.filter(F.col("period").cast("int") % 2 == 1).agg(F.max("period")).first()[0]
    first, second = versions.pair(a, period)
    return t.spark.createDataFrame([(period, first, second)], "period string, first string, second string")


@query(f"WITH {ARCHIVES} SELECT s.source, period, stamp FROM arch, (VALUES ('cr'), ('pa')) s(source)")
def all_sources(t: Lens) -> DataFrame:
    a = _archives(t).select("period", "stamp")
    return delivery.from_sources({"cr": a, "pa": a}).select("source", "period", "stamp")


# Further sections


@query("""WITH top AS (SELECT codigo_producto, count(*) AS rows FROM prices GROUP BY 1 HAVING count(*) >= 10 ORDER BY rows DESC, codigo_producto LIMIT 50) SELECT codigo_producto, rows, reason FROM top JOIN price_verdicts USING (codigo_producto) WHERE reason IS NOT NULL""")
def price_rejected(t: Lens) -> DataFrame:
    return prices.rejected(t.bid_line, t.tender)


LINE_DAYS = """lines AS (SELECT stage, CASE WHEN start IS NULL THEN 'notStarted' WHEN stop IS NULL THEN CASE WHEN DATE '1998-08-01' >= start THEN 'censored' ELSE 'negative' END WHEN stop < start THEN 'negative' ELSE 'completed' END AS disposition, start, stop FROM stage_rows),
days AS (SELECT stage, disposition, CASE disposition WHEN 'completed' THEN stop - start WHEN 'censored' THEN DATE '1998-08-01' - start END AS days FROM lines)"""


@query(f"""WITH {LINE_DAYS} SELECT stage, count(*) AS n, count(*) FILTER (disposition = 'completed') AS completed, count(*) FILTER (disposition = 'censored') AS censored, count(*) FILTER (disposition = 'negative') AS negative,
round(quantile_cont(days, 0.5) FILTER (disposition = 'completed'), 6) AS median FROM days GROUP BY 1""")
def stage_summary_lines(t: Lens) -> DataFrame:
    """Stages by line instead of by procedure."""
    made = durations.report(durations.disposed(_stages(t), AS_OF))
    return made.select("stage", "n", "completed", "censored", "negative", r("median"))


@query(f"""WITH {LINE_DAYS}, m AS (SELECT stage, quantile_cont(days, 0.5) AS med FROM days WHERE disposition = 'completed' GROUP BY 1), s AS (SELECT stage, count(*) FILTER (disposition = 'completed') AS done, count(*) FILTER (disposition = 'censored') AS waiting, count(*) FILTER (disposition = 'negative') AS negative,
count(*) FILTER (disposition = 'censored' AND days > med) AS late, any_value(med) AS med FROM days LEFT JOIN m USING (stage) GROUP BY 1),
e AS (SELECT stage, days, count(*) FILTER (disposition = 'completed') AS d, count(*) AS c FROM days WHERE days IS NOT NULL GROUP BY 1, 2), q AS (SELECT stage, days, 1 - d / sum(c) OVER (PARTITION BY stage ORDER BY days DESC) AS f FROM e),
k AS (SELECT stage, min(days) FILTER (surv <= 0.5) AS km FROM (SELECT stage, days, list_product(list(f) OVER (PARTITION BY stage ORDER BY days)) AS surv FROM q) GROUP BY 1)
SELECT stage, 'no-completed-cases' AS warning FROM s WHERE done = 0 UNION ALL SELECT stage, 'few-completed-cases' FROM s WHERE done BETWEEN 1 AND 29 UNION ALL SELECT stage, 'most-cases-still-open' FROM s WHERE waiting / (done + waiting) >= 0.5
UNION ALL SELECT stage, 'many-cases-still-open' FROM s WHERE waiting / (done + waiting) >= 0.2 AND waiting / (done + waiting) < 0.5 UNION ALL SELECT stage, 'open-cases-past-the-median' FROM s WHERE late > 0 UNION ALL SELECT stage, 'ends-before-starts-left-out' FROM s WHERE negative > 0
UNION ALL SELECT stage, 'survival-median-is-longer' FROM s JOIN k USING (stage) WHERE km > med UNION ALL SELECT stage, 'median-beyond-observation' FROM s JOIN k USING (stage) WHERE km IS NULL AND waiting > 0""")
def stage_warnings(t: Lens) -> DataFrame:
    return durations.warnings(durations.report(durations.disposed(_stages(t), AS_OF)))


@query("""WITH c AS (SELECT *, count(*) OVER (PARTITION BY nro_sicop) AS n FROM tender_bidders), p AS (SELECT cedula_proveedor, cedula_institucion, count(*) AS total, count(*) FILTER (n = 1) AS sole_bids FROM c GROUP BY 1, 2), s AS (SELECT cedula_institucion, count(*) FILTER (n = 1) AS singles FROM c GROUP BY 1)
SELECT cedula_proveedor, cedula_institucion, sole_bids, round(sqrt(sole_bids / singles * sole_bids / total), 6) AS score FROM p JOIN s USING (cedula_institucion) WHERE sole_bids >= 2 ORDER BY sqrt(sole_bids / singles * sole_bids / total) DESC, sole_bids DESC, cedula_proveedor, cedula_institucion LIMIT 25""")
def screen_listed(t: Lens) -> DataFrame:
    """The first 25 hits of a screen, best first."""
    hits = collusion.sole_bid_pairs(t.bid, t.award_line, t.tender, t.institution, min_tenders=2)
    return collusion.listed("single-bidder-concentration", hits).select("cedula_proveedor", "cedula_institucion", "sole_bids", r("score"))


@query("SELECT nro_sicop FROM tender ORDER BY nro_sicop LIMIT 1")
def page_clamped(t: Lens) -> DataFrame:
    """A limit of 0 counts as 1, an offset below 0 as 0."""
    return delivery.page(t.tender.select("nro_sicop").orderBy("nro_sicop"), 0, -5)


@query(f"""WITH {FEED}, m AS (SELECT DISTINCT 'inst' AS subscription, f.* FROM feed f JOIN tender t ON t.nro_sicop = f.id WHERE t.cedula_institucion = '3'), g AS (SELECT subscription, kind, id, CASE WHEN kind = 'silentRevision' AND closed_month THEN 'high' WHEN kind IN ('silentRevision', 'removed') THEN 'medium' ELSE 'low' END AS severity FROM m)
SELECT substr(sha256(subscription || '|' || kind || '|DetalleCarteles|' || id), 1, 16) AS alert_id, id, severity FROM g""")
def alert_list(t: Lens) -> DataFrame:
    subs = t.spark.createDataFrame([("inst", "institution", "3", None)], "id string, kind string, value string, kinds array<string>")
    made = delivery.subjects(delivery.static_subject(_feed(t)), t.tender, t.bid, t.award_line, t.bid_line)
    return delivery.alert_list(delivery.alerts(made, subs)).select("alert_id", "id", "severity")


@query("SELECT nro_linea, count(*) AS lines FROM bid_line WHERE moneda = 'USD' GROUP BY 1")
def index_sql(t: Lens) -> DataFrame:
    """SQL with parameters over a saved index."""
    folder = f"{shared_folder(t.spark)}/cartulary/index-{uuid.uuid4().hex}"
    index.save(t.spark, folder, "bid_line", t.bid_line)
    return index.ask(t.spark, folder, "SELECT nro_linea, count(*) AS lines FROM bid_line WHERE moneda = :currency AND nro_sicop NOT IN (SELECT nro_sicop FROM tender) GROUP BY nro_linea", {"currency": "USD"})


@query("SELECT source, period, observed_at, sha256, status, content_length, true AS tls_verified FROM observations")
def manifest_scan(t: Lens) -> DataFrame:
    """Observations appended to a manifest in two turns and read again."""
    path = f"{shared_folder(t.spark)}/cartulary/manifest-{uuid.uuid4().hex}"
    seen = _observations(t)
    archive.append_manifest(seen.filter("content_length % 2 = 0"), path)
    archive.append_manifest(seen.filter("content_length % 2 = 1"), path)
    return archive.read_manifest(t.spark, path).select("source", "period", "observed_at", "sha256", "status", "content_length", "tls_verified")


@query(f"WITH {ARCHIVES} SELECT period, substr(sha256, 1, 12) AS id, root FROM arch")
def entries_landed(t: Lens) -> DataFrame:
    """Anchor entries landed as JSON arrays, read and taken apart."""
    folder = f"{shared_folder(t.spark)}/cartulary/entries-{uuid.uuid4().hex}"
    made = versions.version_entries(_archives(t), "cr")
    made.groupBy(F.crc32("key") % 7).agg(F.to_json(F.collect_list(F.struct("key", "type", "value"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return versions.parse_versions(versions.read_entries(t.spark, folder)).select("period", "id", "root")
