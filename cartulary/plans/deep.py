"""Queries of mechanisms for large tables: chunks, chosen proofs, buckets, histories, hot groups and deep pages, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import quantiles
from cartulary.functions.exprs import Window
from cartulary.operators import bundle, canonical, competition, differ, durations, history, institutions, loading, merkle, occurrences, paging, prices, reconcile, snapshots, state
from cartulary.plans.extended import MIRROR, _published, _releases
from cartulary.plans.registry import _metrics, _records, query, r
from cartulary.schemas import CHANGE_KINDS, TableDef, source
from cartulary.sources import archive
from cartulary.sources.lens import Lens
from cartulary.storage import alone, freed, passing, remove, shared_folder, written
from cartulary.streaming import watch


def _folder(t: Lens, what: str) -> str:
    return f"{shared_folder(t.spark)}/cartulary/{what}-{uuid.uuid4().hex}"


@query(f"WITH RECURSIVE {MIRROR} SELECT period, id, byte_hash, value_hash FROM mirror")
def archive_chunks(t: Lens) -> DataFrame:
    """Archives read in chunks of 300 bytes, each a task's work, whatever quotes and line ends they cut through."""
    folder = _folder(t, "mirror")
    archive.write_archives(_published(t), folder)
    made = canonical.records(archive.read_archives(t.spark, folder, chunk_bytes=300), source("cr").tables)
    return made.select(F.regexp_extract("path", r"/([0-9]{6})/[^/]*$", 1).alias("period"), "id", "byte_hash", "value_hash")


def _forest(t: Lens) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Leaves in three trees by order number, their upper levels, and the leaves that are asked for."""
    records = _records(t).withColumn("tree", (F.col("id").cast("long") % 3).cast("string"))
    numbered = written(merkle.leaves(records, "tree"), "numbered")
    return numbered, merkle.levels(numbered, "tree"), written(numbered.filter(F.col("id").cast("long") % 50 == 0), "wanted")


@query("SELECT o_orderkey::VARCHAR AS id, (o_orderkey % 3)::VARCHAR AS tree, o_orderkey % 7 <> 0 AS ok FROM orders WHERE o_orderkey % 50 = 0")
def proofs_chosen(t: Lens) -> DataFrame:
    """Paths of chosen leaves; those of every seventh order were altered afterwards and have to fail."""
    _, tree, wanted = _forest(t)
    made = merkle.proofs(tree, "tree", wanted=wanted.select("tree", "idx"))
    altered = F.when(F.col("id").cast("long") % 7 == 0, F.sha2("hash", 256)).otherwise(F.col("hash"))
    met = wanted.select("tree", "idx", "id").join(made, ["tree", "idx"]).withColumn("hash", altered)
    return merkle.verified(met).select("id", "tree", "ok")


@query("""SELECT (o_orderkey % 3)::VARCHAR AS tree, count(*) AS records, count(*) FILTER (o_orderkey % 50 = 0) AS wanted,
NOT (o_orderkey % 3 = 1 AND count(*) FILTER (o_orderkey % 350 = 0) > 0) AS ok FROM orders GROUP BY o_orderkey % 3""")
def proven_together(t: Lens) -> DataFrame:
    """Chosen leaves of three trees, each tree's proven by one set of nodes; in one tree some leaves were altered."""
    numbered, tree, wanted = _forest(t)
    siblings = written(merkle.frontier(tree, wanted.select("tree", "idx"), "tree"), "siblings")
    top = tree[-1].filter("idx = 0").select("tree", F.col("hash").alias("root"))
    sizes = written(numbered.groupBy("tree").agg(F.count("*").alias("records")).join(top, "tree"), "sizes")
    altered = F.when((F.col("tree") == "1") & (F.col("id").cast("long") % 350 == 0), F.sha2("hash", 256)).otherwise(F.col("hash"))
    made = merkle.proven_together(wanted.withColumn("hash", altered), siblings, sizes, "tree")
    asked = wanted.groupBy("tree").agg(F.count("*").alias("wanted"))
    return made.join(sizes, "tree").join(asked, "tree", "left").select("tree", "records", F.coalesce("wanted", F.lit(0)).cast("long").alias("wanted"), "ok")


@query("SELECT kind, 'orders' AS table_name, id, before_hash, after_hash FROM changes")
def bucket_diff(t: Lens) -> DataFrame:
    """Two stored copies compared by the digests of their buckets; one has twice as many buckets as the other."""
    one, two = _folder(t, "copy"), _folder(t, "copy")
    reconcile.store(_records(t), one, 32)
    reconcile.store(_records(t, True), two, 64)
    made = reconcile.diff(t.spark, one, two)
    return made.select("kind", F.col("table").alias("table_name"), "id", F.col("before.byte_hash").alias("before_hash"), F.col("after.byte_hash").alias("after_hash"))


@query("""SELECT count(*) AS records, 0::BIGINT AS differing FROM orders""")
def bucket_digests(t: Lens) -> DataFrame:
    """Digests of one copy stored twice, in different order and in different numbers of buckets: none differs."""
    one, two = _folder(t, "copy"), _folder(t, "copy")
    made = written(_records(t), "records")
    reconcile.store(made, one, 64)
    reconcile.store(made.repartition(7, "byte_hash"), two, 128)
    chosen, _ = reconcile.differing(t.spark, one, two)
    return reconcile.digests(t.spark, one).agg(F.sum("records").alias("records")).withColumn("differing", F.lit(len(chosen)).cast("long"))


@query("""SELECT nro_sicop, nro_linea, source_month, codigo_producto FROM (SELECT *, row_number() OVER (PARTITION BY nro_sicop, nro_linea ORDER BY source_month DESC, codigo_producto::BIGINT DESC) AS rn FROM bid_line) WHERE rn = 1""")
def bucketed_state(t: Lens) -> DataFrame:
    """Lines folded into keyed state in three batches, one of them twice."""
    rows = t.bid_line.withColumn("row_pos", F.col("codigo_producto").cast("long")).withColumn("nro_oferta", F.lit("1")).withColumn("archive_stamp", F.lit("1"))
    folder, part = _folder(t, "state"), F.pmod(F.xxhash64("nro_sicop", "codigo_producto"), F.lit(3))
    for n in (0, 1, 2, 1):
        state.fold(t.spark, folder, "bid_line", rows.filter(part == n), buckets=16)
    return state.read(t.spark, folder, "bid_line").select("nro_sicop", "nro_linea", "source_month", "codigo_producto")


def _copy(t: Lens, second: bool = False) -> DataFrame:
    """table, id and hashes of a copy's records, written once; nothing else of it stays on disk."""
    return alone(t.spark, lambda: _records(t, second).select("table", "id", "byte_hash", "value_hash"), "copy")


@query("""WITH k AS (SELECT id FROM (SELECT id FROM snap1 UNION SELECT id FROM snap2) WHERE id::BIGINT % 40 = 0), c AS (SELECT '20240101T000000Z' AS stamp, 1 AS seq, s.* FROM snap1 s UNION ALL SELECT '20240201T000000Z', 2, s.* FROM snap2 s UNION ALL SELECT '20240301T000000Z', 3, s.* FROM snap1 s),
n AS (SELECT stamp, seq, id, byte_hash, value_hash, row_number() OVER (PARTITION BY seq ORDER BY id) - 1 AS leaf_index FROM c), st AS (SELECT DISTINCT stamp, seq FROM c),
g AS (SELECT k.id, st.stamp, st.seq, n.byte_hash, n.value_hash, n.leaf_index FROM k CROSS JOIN st LEFT JOIN n ON n.id = k.id AND n.seq = st.seq),
w AS (SELECT *, lag(byte_hash) OVER (PARTITION BY id ORDER BY seq) AS pb, lag(value_hash) OVER (PARTITION BY id ORDER BY seq) AS pv FROM g)
SELECT id, stamp, leaf_index, CASE WHEN byte_hash IS NOT NULL THEN true END AS ok, CASE WHEN seq = 1 THEN CASE WHEN byte_hash IS NULL THEN 'absent' ELSE 'present' END WHEN pb IS NULL THEN CASE WHEN byte_hash IS NULL THEN 'absent' ELSE 'added' END WHEN byte_hash IS NULL THEN 'removed'
WHEN pb = byte_hash THEN 'unchanged' WHEN pv = value_hash THEN 'reformatted' ELSE 'silentRevision' END AS step FROM w""")
def record_history(t: Lens) -> DataFrame:
    """Chosen records in three copies, each with its leaf and the check of its path to the copy's root."""
    one, two = _copy(t), _copy(t, True)
    cut = lambda df, stamp: df.select(F.lit(stamp).alias("stamp"), "table", "id", "byte_hash", "value_hash")
    copies = cut(one, "20240101T000000Z").unionByName(cut(two, "20240201T000000Z")).unionByName(cut(one, "20240301T000000Z"))
    wanted = one.select("table", "id").unionByName(two.select("table", "id")).filter(F.col("id").cast("long") % 40 == 0)
    return alone(t.spark, lambda: history.proven(copies, wanted).select("id", "stamp", "leaf_index", "ok", "step"), "history")


@query("""WITH c AS (SELECT 1 AS seq, s.* FROM snap1 s UNION ALL SELECT 2, s.* FROM snap2 s UNION ALL SELECT 3, s.* FROM snap2 s),
m AS (SELECT *, CASE WHEN lag(byte_hash) OVER w = byte_hash AND lag(value_hash) OVER w = value_hash AND lag(seq) OVER w = seq - 1 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY id ORDER BY seq)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY seq) AS run FROM m)
SELECT id, byte_hash, min(seq)::BIGINT AS first_copy, max(seq)::BIGINT AS last_copy FROM g GROUP BY id, run, byte_hash""")
def validity_intervals(t: Lens) -> DataFrame:
    """All records of three copies as intervals in which they don't change."""
    one, two = written(_records(t), "one"), written(_records(t, True), "two")
    cut = lambda df, stamp: df.select(F.lit(stamp).alias("stamp"), "table", "id", "byte_hash", "value_hash")
    copies = cut(one, "1").unionByName(cut(two, "2")).unionByName(cut(two, "3"))
    return history.intervals(copies, history.copies_of(copies)).select("id", "byte_hash", F.col("first_seq").cast("long").alias("first_copy"), F.col("last_seq").cast("long").alias("last_copy"))


@query("SELECT l_orderkey * 10 + l_linenumber AS row_pos, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem")
def occurrence_numbers(t: Lens) -> DataFrame:
    """Lines numbered within three keys that hold all of them, each key spread over tasks."""
    rows = t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_pos"), "l_returnflag")
    return occurrences.numbered(rows, ["l_returnflag"], "row_pos", "n", hot=1000)


SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


@query(f"""WITH g AS (SELECT 'all' AS grp, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_returnflag, l_extendedprice FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'order ' || (l_orderkey % 100), l_extendedprice FROM lineitem),
q AS (SELECT grp, count(*) AS n, {', '.join(f'quantile_cont(v, {s}) AS q{k}' for k, s in enumerate(SHARES))} FROM g GROUP BY 1) SELECT grp, n, {', '.join(f'round(q{k}, 4) AS q{k}' for k in range(len(SHARES)))} FROM q""")
def hot_quantiles(t: Lens) -> DataFrame:
    """Exact quantiles of a group of all rows, of hot and of small groups."""
    line = t.raw("lineitem")
    price, part = F.col("l_extendedprice").alias("v"), F.concat(F.lit("order "), (F.col("l_orderkey") % 100).cast("string"))
    rows = line.select(F.lit("all").alias("grp"), price).unionByName(line.select(F.col("l_returnflag").alias("grp"), price)).unionByName(line.select(F.lit("quantity").alias("grp"), F.col("l_quantity").alias("v"))).unionByName(line.select(part.alias("grp"), price))
    made = quantiles.quantiles(rows, ["grp"], "v", SHARES, hot=1000)
    return made.select("grp", "n", *[F.round(F.get("q", F.lit(k)), 4).alias(f"q{k}") for k in range(len(SHARES))])


@query("""WITH st AS (SELECT m.cedula_institucion, m.metric, count(v.value) AS peer_n, quantile_cont(v.value, 0.25) AS p25, quantile_cont(v.value, 0.5) AS p50, quantile_cont(v.value, 0.75) AS p75, count(*) FILTER (v.value < m.value) AS below, count(*) FILTER (v.value = m.value) AS equal
FROM inst_metrics m JOIN inst_metrics v ON v.cedula_institucion <> m.cedula_institucion AND v.metric = m.metric WHERE v.n >= 20 AND v.value IS NOT NULL GROUP BY 1, 2)
SELECT m.cedula_institucion, m.metric, coalesce(peer_n, 0) AS peer_n, round(p25, 6) AS peer_p25, round(p50, 6) AS peer_median, round(p75, 6) AS peer_p75, CASE WHEN m.value IS NOT NULL AND m.n >= 20 AND peer_n >= 5 THEN round(1 - (below + equal / 2) / peer_n, 6) END AS standing FROM inst_metrics m LEFT JOIN st USING (cedula_institucion, metric)""")
def peers_all(t: Lens) -> DataFrame:
    """Every institution against all others, by its place in each metric's order."""
    return institutions.benchmark(_metrics(t), all_peers=True).select("cedula_institucion", "metric", "peer_n", r("peer_p25"), r("peer_median"), r("peer_p75"), r("standing"))


@query("""WITH p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS n, count(*) OVER () AS total FROM events) SELECT 'last full page' AS page, event_id, user_id FROM p WHERE n // 50 = total // 50 - 1
UNION ALL SELECT 'after', event_id, user_id FROM p WHERE n > total // 2 AND n <= total // 2 + 30""")
def deep_pages(t: Lens) -> DataFrame:
    """The last full page of all events, and the rows after a cursor in the middle."""
    folder, order = _folder(t, "pages"), ["user_id", "event_id"]
    rows = t.raw("events").select(*order)
    paging.store(rows, order, folder, file_rows=1000)
    total = t.spark.read.parquet(folder).agg(F.sum("n")).first()[0]
    last = paging.page(t.spark, folder, rows.schema, order, total // 50, 50)
    middle = paging.page(t.spark, folder, rows.schema, order, total // 2 + 1, 1).first()
    after = paging.following(t.spark, folder, rows.schema, order, (middle["user_id"], middle["event_id"]), 30)
    return last.select(F.lit("last full page").alias("page"), "event_id", "user_id").unionByName(after.select(F.lit("after").alias("page"), "event_id", "user_id"))


@query(f"WITH RECURSIVE {MIRROR} SELECT period, count(*) AS records, count(DISTINCT id) AS ids FROM mirror GROUP BY 1")
def snapshot_stored_twice(t: Lens) -> DataFrame:
    """Snapshots stored twice: each record is there once."""
    folder, held = _folder(t, "mirror"), _folder(t, "snapshots")
    archive.write_archives(_published(t), folder)
    made = written(snapshots.records_of(t.spark, folder, "cr"), "records")
    heads = written(snapshots.headers_of(t.spark, folder, made, "cr"), "headers")
    for _ in range(2):
        snapshots.store(held, made, heads)
    found = t.spark.read.option("basePath", f"{held}/records").parquet(f"{held}/records")
    return found.groupBy(F.col("period").cast("string").alias("period")).agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))


@query("""WITH l AS (SELECT l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b, strftime(l_shipdate, '%Y%m') AS month, l_partkey, l_quantity, l_linestatus FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY month DESC, l_partkey DESC) AS rn FROM l)
SELECT 'tender' AS tbl, o_orderkey::VARCHAR AS id, '' AS line, strftime(o_orderdate, '%Y%m') AS source_month, round(o_totalprice) + 0.5 AS amount, 'say "' || o_orderpriority || '"; or' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE ',' END || 'not' AS text FROM orders
UNION ALL SELECT 'bid_line', a, b, month, l_quantity, CASE l_linestatus WHEN 'F' THEN 'CRC' ELSE 'USD' END FROM w WHERE rn = 1""")
def archives_loaded(t: Lens) -> DataFrame:
    """Two tables of monthly archives loaded into the index at once, and again: the second load finds nothing to do."""
    header = F.array(*map(F.lit, ("NRO_SICOP", "Nro_Oferta", "NRO_LINEA", "CODIGO_PRODUCTO", "CANTIDAD_OFERTADA", "TIPO_MONEDA")))
    cells = F.array(F.col("l_orderkey").cast("string"), F.lit("1"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.regexp_replace(F.col("l_quantity").cast("string"), r"\.", ","), F.when(F.col("l_linestatus") == "F", "CRC").otherwise("USD"))
    month = F.date_format("l_shipdate", "yyyyMM")
    lines = t.raw("lineitem").select(month.alias("period"), F.concat(month, F.lit("28T120000Z")).alias("stamp"), F.lit("LineasOfertadas").alias("table"), F.col("l_partkey").alias("row_pos"), header.alias("header"), cells.alias("cells"))
    mirror, held = _folder(t, "mirror"), _folder(t, "index")
    archive.write_archives(_published(t).unionByName(lines), mirror)
    loading.load_archives(t.spark, mirror, held, buckets=8)
    if loading.load_archives(t.spark, mirror, held).head(1):
        raise ValueError("an archive was loaded twice")
    remove(t.spark, mirror)
    tender, line = loading.table(t.spark, held, "tender"), loading.table(t.spark, held, "bid_line")
    return tender.select(F.lit("tender").alias("tbl"), F.col("nro_sicop").alias("id"), F.lit("").alias("line"), "source_month", F.col("monto_est").alias("amount"), F.col("cartel_nm").alias("text")).unionByName(
        line.select(F.lit("bid_line").alias("tbl"), F.col("nro_sicop").alias("id"), F.col("nro_linea").alias("line"), "source_month", F.col("cantidad").alias("amount"), F.col("moneda").alias("text"))
    )


def _twice_published(t: Lens) -> DataFrame:
    """The first month of orders as two archives; in the later one some rows are changed, left out or added."""
    first = _published(t).withColumn("k", F.col("row_pos"))
    month = first.agg(F.min("period")).first()[0]
    mine = first.filter(F.col("period") == month)
    edited = F.when(F.col("k") % 11 == 0, F.array(F.get("cells", F.lit(0)), F.lit("edited"), F.get("cells", F.lit(2)), F.get("cells", F.lit(3)))).otherwise(F.col("cells"))
    later = mine.filter("k % 13 <> 0").withColumn("cells", edited).withColumn("stamp", F.regexp_replace("stamp", "28T120000Z", "29T120000Z"))
    return mine.unionByName(later).drop("k")


@query("""WITH m AS (SELECT min(strftime(o_orderdate, '%Y%m')) AS p FROM orders), o AS (SELECT o_orderkey AS k FROM orders, m WHERE strftime(o_orderdate, '%Y%m') = p), c AS (SELECT count(*) FILTER (k % 13 = 0) AS removed, count(*) FILTER (k % 13 <> 0 AND k % 11 = 0) AS revised FROM o)
SELECT 'honest' AS bundle, 'removed' AS name, removed > 0 AS ok, removed AS n FROM c UNION ALL SELECT 'honest', 'silentRevision', revised > 0, revised FROM c UNION ALL
SELECT b.bundle, v.name, NOT (b.bundle = 'other line' AND v.name IN ('changes', 'published changes')), 0 FROM (VALUES ('honest'), ('other line')) b(bundle),
(VALUES ('digest'), ('changes'), ('lines'), ('counts'), ('policy'), ('arithmetic'), ('unique'), ('earlier archive'), ('later archive'), ('earlier root'), ('later root'), ('rebuilt changes'), ('rebuilt digest'), ('published changes')) v(name)
UNION ALL SELECT 'no archive', 'later archive', false, 0""")
def bundle_from_archives(t: Lens) -> DataFrame:
    """A bundle of two archives checked from their bytes; the same with a line altered, and without one of the archives."""
    mirror, out = _folder(t, "mirror"), _folder(t, "bundles")
    made = archive.write_archives(_twice_published(t), mirror)
    period = made.first()["period"]
    folder = bundle.from_archives(t.spark, mirror, "cr", period, out)
    m, lines = bundle.read(t.spark, folder)
    rows = [("honest", name, ok, 0) for name, ok, _ in bundle.verify_archives(t.spark, folder, mirror)]
    by = {r["kind"]: r["n"] for r in lines.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # five rows
    rows += [("honest", kind, by.get(kind, 0) > 0, by.get(kind, 0)) for kind in ("removed", "silentRevision")]
    bundle.write(lines.withColumn("line", F.regexp_replace("line", '"edited"', '"Edited"')), m, f"{out}/line")
    rows += [("other line", name, ok, 0) for name, ok, _ in bundle.verify_archives(t.spark, f"{out}/line", mirror)]
    half = _folder(t, "mirror")
    archive.write_archives(_twice_published(t).filter("stamp like '%28T120000Z'"), half)
    rows += [("no archive", name, ok, 0) for name, ok, _ in bundle.verify_archives(t.spark, folder, half) if name == "later archive"]
    return t.spark.createDataFrame(rows, "bundle string, name string, ok boolean, n long")


@query("""WITH b AS (SELECT nro_sicop, nro_oferta, min(cedula_proveedor) AS s FROM bid GROUP BY 1, 2) SELECT codigo_producto, nro_sicop, nro_linea, s AS cedula_proveedor, cedula_institucion, count(*) AS lines
FROM prices LEFT JOIN b USING (nro_sicop, nro_oferta) LEFT JOIN tender USING (nro_sicop) GROUP BY ALL""")
def price_suppliers(t: Lens) -> DataFrame:
    """Price rows of offers with the supplier of the offer and the institution."""
    made = prices.with_supplier(prices.price_rows(t.bid_line, t.tender), t.bid)
    return made.groupBy("codigo_producto", "nro_sicop", "nro_linea", "cedula_proveedor", "cedula_institucion").agg(F.count("*").alias("lines"))


@query("""WITH n AS (SELECT cedula_proveedor AS who, nombre FROM supplier_t UNION ALL SELECT cedula, nombre FROM institution), nm AS (SELECT who, max(nombre) AS name FROM n GROUP BY 1),
b AS (SELECT nro_sicop, count(DISTINCT cedula_proveedor) AS tenderers FROM bid GROUP BY 1), bl AS (SELECT DISTINCT nro_sicop, nro_acto, cedula_proveedor, nro_linea FROM latest_award), al AS (SELECT nro_sicop, count(*) AS award_items, count(DISTINCT (nro_acto, cedula_proveedor)) AS awards, min(nro_acto || '-' || cedula_proveedor) AS first_award FROM bl GROUP BY 1),
cs AS (SELECT l_orderkey::VARCHAR AS nro_sicop, 1 AS contracts, count(*) - 1 AS amendments, arg_min(CASE l_linestatus WHEN 'F' THEN 'CRC' ELSE 'USD' END, (l_linenumber, l_shipdate, l_linestatus)) AS currency, strftime(min_by(l_shipdate, (l_linenumber, l_shipdate)), '%Y-%m-%d') AS starts FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT t.nro_sicop || '-' || t.source_month || '-' || replace(fecha_publicacion, '-', '') || 'T000000Z' AS id, fecha_publicacion || 'T00:00:00Z' AS date, array_to_string(list_filter([CASE WHEN monto_est IS NOT NULL OR des_excepcion IS NOT NULL THEN 'planning' END, 'tender', CASE WHEN awards IS NOT NULL THEN 'award' END, CASE WHEN contracts IS NOT NULL THEN 'contract' END], lambda x: x IS NOT NULL), ',') AS tags,
'es' AS language, 'X-ID-' || cedula_institucion AS buyer, nm.name AS procuring, monto_est AS budget, CASE WHEN monto_est IS NOT NULL THEN coalesce(currency, 'CRC') END AS currency, coalesce(tenderers, 0) AS tenderers, coalesce(award_items, 0) AS award_items,
CASE WHEN contracts IS NOT NULL AND awards = 1 THEN first_award END AS award_id, CASE WHEN contracts IS NOT NULL THEN coalesce(amendments, 0) END AS amendments, CASE WHEN contracts IS NOT NULL THEN starts || 'T00:00:00Z' END AS starts
FROM tender t LEFT JOIN nm ON nm.who = t.cedula_institucion LEFT JOIN b USING (nro_sicop) LEFT JOIN al USING (nro_sicop) LEFT JOIN cs USING (nro_sicop)""")
def release_members(t: Lens) -> DataFrame:
    """Members of the releases' JSON, read back from it."""
    party = "struct<id:string,name:string>"
    schema = f"""id string, date string, tag array<string>, language string, buyer {party}, planning struct<rationale:string,budget:struct<id:string,amount:struct<amount:double,currency:string>>>,
    tender struct<procuringEntity:{party},value:struct<amount:double,currency:string>,tenderers:array<{party}>>, awards array<struct<id:string,items:array<struct<id:string>>>>,
    contracts array<struct<id:string,awardID:string,period:struct<startDate:string>,amendments:array<struct<id:string,date:string>>>>"""
    rows = _releases(t).select(F.from_json("release", schema).alias("j")).select("j.*")
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long")
    first = F.get("contracts", F.lit(0))
    return rows.select(
        "id", "date", F.array_join("tag", ",").alias("tags"), "language", F.col("buyer.id").alias("buyer"), F.col("tender.procuringEntity.name").alias("procuring"), F.col("planning.budget.amount.amount").alias("budget"), F.col("tender.value.currency").alias("currency"),
        size(F.col("tender.tenderers")).alias("tenderers"), F.coalesce(F.aggregate("awards", F.lit(0).cast("long"), lambda n, x: n + size(x["items"])), F.lit(0)).cast("long").alias("award_items"), first["awardID"].alias("award_id"),
        F.aggregate("contracts", F.lit(0).cast("long"), lambda n, x: n + size(x["amendments"])).alias("amendments"), first["period"]["startDate"].alias("starts"),
    )


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), c AS (SELECT o, n, o % 5 = 0 AND n > 1 AS only_later, o % 7 = 0 AND n = 1 AS only_earlier FROM a WHERE o % 3 = 0),
before AS (SELECT * FROM c WHERE NOT only_later), after AS (SELECT * FROM c WHERE NOT only_earlier)
SELECT o || '|' || n AS id, CASE WHEN o IN (SELECT o FROM before) THEN 'recordedAmendment' ELSE 'added' END AS kind FROM after WHERE only_later UNION ALL SELECT o || '|' || n, 'removed' FROM before WHERE only_earlier""")
def amendments(t: Lens) -> DataFrame:
    """Contracts of two copies: new sequences of a known contract are amendments, of an unknown one additions."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    keys = t.raw("lineitem").filter(o % 3 == 0).select(o, n).distinct()
    cells = F.array(o.cast("string"), n.cast("string"))
    rows = lambda df: df.select(F.lit("Contratos").alias("table"), (o * 10 + n).alias("row_pos"), F.array(F.lit("NRO_CONTRATO"), F.lit("SECUENCIA")).alias("header"), cells.alias("cells"))
    defs = {"Contratos": source("cr").tables["Contratos"]}
    one = canonical.records(rows(keys.filter(~((o % 5 == 0) & (n > 1)))), defs)
    two = canonical.records(rows(keys.filter(~((o % 7 == 0) & (n == 1)))), defs)
    return differ.diff(one, two).select("id", "kind")


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_pos, row_number() OVER w > 1 AS duplicate_key, CASE WHEN row_number() OVER w = 1 THEN l_orderkey::VARCHAR END AS id FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def repeated_keys(t: Lens) -> DataFrame:
    """Rows of a table whose declared key repeats: the first keeps it, the others are named by their content."""
    lines = t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = canonical.rows_of(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_orderkey", "l_linenumber", "p"), "lines", "pos")
    made = canonical.identified(rows, {"lines": TableDef(("l_orderkey",), ())})
    return made.select("row_pos", "duplicate_key", F.when(~F.col("id").startswith("sha256:"), F.col("id")).alias("id"))


@query("""WITH l AS (SELECT codigo_producto, moneda, CASE WHEN codigo_producto::BIGINT % 7 = 0 THEN NULL WHEN codigo_producto::BIGINT % 5 = 0 THEN -precio_unitario ELSE precio_unitario END AS p, CASE WHEN nro_linea = '3' THEN 0 ELSE cantidad END AS c FROM bid_line)
SELECT codigo_producto, count(*) FILTER (moneda <> 'CRC') AS other_currency, count(*) FILTER (moneda = 'CRC' AND (p <= 0 OR c <= 0)) AS non_positive, count(*) FILTER (moneda = 'CRC' AND (p IS NULL OR c IS NULL)) AS missing FROM l GROUP BY 1""")
def price_exclusions_counted(t: Lens) -> DataFrame:
    """Lines that a price analysis leaves out, with missing and negative prices and empty quantities among them."""
    k = F.col("codigo_producto").cast("long")
    price = F.when(k % 7 == 0, None).when(k % 5 == 0, -F.col("precio_unitario")).otherwise(F.col("precio_unitario"))
    lines = t.bid_line.withColumn("precio_unitario", price).withColumn("cantidad", F.when(F.col("nro_linea") == "3", 0.0).otherwise(F.col("cantidad")))
    return prices.exclusions(lines, t.tender)


@query("""WITH m AS (SELECT max(source_month) AS month FROM tender), t AS (SELECT * FROM tender, m WHERE source_month = month AND cedula_institucion IN (SELECT cedula_institucion FROM tender t2, m WHERE t2.source_month = m.month ORDER BY cedula_institucion LIMIT 1)),
b AS (SELECT nro_sicop, count(DISTINCT cedula_proveedor) AS bidders FROM bid WHERE nro_sicop IN (SELECT nro_sicop FROM t) GROUP BY 1) SELECT nro_sicop, cedula_institucion, bidders FROM b JOIN t USING (nro_sicop)""")
def window_of_institution(t: Lens) -> DataFrame:
    """Bidders of one institution's tenders of one month."""
    month = t.tender.agg(F.max("source_month")).first()[0]
    institution = t.tender.filter(F.col("source_month") == month).agg(F.min("cedula_institucion")).first()[0]
    return competition.bidder_counts(t.bid, t.tender, Window(month=month, institution=institution)).select("nro_sicop", "cedula_institucion", "bidders")


@query("""WITH i AS (SELECT min(cedula_institucion) AS i FROM tender) SELECT stage, count(*) AS lines, count(start) AS started, count(stop) AS stopped FROM stage_rows JOIN tender USING (nro_sicop), i WHERE cedula_institucion = i AND start IS NOT NULL GROUP BY 1""")
def stages_of_institution(t: Lens) -> DataFrame:
    """Stages of one institution's procedures, whose lines meet its tenders by a semi join."""
    first = t.tender.agg(F.min("cedula_institucion")).first()[0]
    rows = durations.unpivoted(t.stage_dates, Window(institution=first), tender=t.tender).filter("start is not null")
    return rows.groupBy("stage").agg(F.count("*").alias("lines"), F.count("start").alias("started"), F.count("end").alias("stopped"))


def _watched(t: Lens) -> tuple[str, str]:
    """Feed and report folders after two copies of a month have landed, one after the other, and been compared by the stream."""
    base = _folder(t, "watch")
    places = {name: f"{base}/{name}" for name in ("landed", "copies", "feed", "checkpoint", "reports", "bundles")}
    report = watch.reporter(t.spark, places["reports"], "cr", bundles=places["bundles"])
    for stamp, second in (("20240201T000000Z", False), ("20240301T000000Z", True)):
        key = [F.lit("cr").alias("source"), F.lit("202401").alias("period"), F.lit(stamp).alias("stamp")]
        with passing(t.spark), freed(t.spark):
            _records(t, second).select(*key, "table", "id", "byte_hash", "value_hash").write.mode("append").option("compression", "zstd").parquet(places["landed"])
        watch.watch(t.spark, places["landed"], places["copies"], places["feed"], places["checkpoint"], report).awaitTermination()
        # the copy is kept by the stream now
        remove(t.spark, places["landed"])
    remove(t.spark, places["copies"])
    return places["feed"], places["reports"]


@query("SELECT kind, id, before_hash, after_hash, '20240301T000000Z' AS detected FROM changes")
def watch_feed(t: Lens) -> DataFrame:
    """The change feed of a stream of copies."""
    feed, _ = _watched(t)
    hashes = "struct<byte_hash:string,value_hash:string>"
    rows = t.spark.read.option("recursiveFileLookup", "true").schema(f"kind string, table string, id string, before {hashes}, after {hashes}, period string, detected string").parquet(feed)
    return rows.select("kind", "id", F.col("before.byte_hash").alias("before_hash"), F.col("after.byte_hash").alias("after_hash"), "detected")


@query("""WITH k AS (SELECT k.kind, coalesce(n, 0) AS changes FROM (VALUES ('added'), ('recordedAmendment'), ('silentRevision'), ('reformatted'), ('removed')) k(kind) LEFT JOIN (SELECT kind, count(*) AS n FROM changes GROUP BY 1) c USING (kind)), a AS (SELECT sum(changes)::BIGINT AS n FROM k)
SELECT '202401' AS month, true AS closed_month, kind, changes, least(n, 200) AS listed, n > 200 AS truncated, n AS in_bundle FROM k, a""")
def watch_report(t: Lens) -> DataFrame:
    """The stream's report: all changes counted, the first 200 listed, the others in its bundle."""
    _, reports = _watched(t)
    found = t.spark.read.json(reports).select(F.explode("findings").alias("f")).select("f.*")
    whole = t.spark.read.json(found.select("bundle").first()[0]).count()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"counts.{k}").alias("changes")) for k in CHANGE_KINDS])
    rows = found.select("month", "closed_month", F.size("changes").cast("long").alias("listed"), "truncated", F.lit(whole).cast("long").alias("in_bundle"), F.explode(kinds).alias("k"))
    return rows.select("month", "closed_month", "k.kind", "k.changes", "listed", "truncated", "in_bundle")
