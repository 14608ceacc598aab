"""The lens in DuckDB's SQL: the same tables as sources.lens, for oracles."""

from __future__ import annotations

import re

LENS = {
    "tender": """SELECT o_orderkey::VARCHAR AS nro_sicop, 'P-' || o_orderkey AS nro_procedimiento, c_nationkey::VARCHAR AS cedula_institucion,
        strftime(o_orderdate, '%Y-%m-%d') AS fecha_publicacion, strftime(o_orderdate + INTERVAL 15 DAY, '%Y-%m-%d') AS fechah_apertura,
        CASE o_orderstatus WHEN 'F' THEN 'Contrato' WHEN 'O' THEN 'En evaluación' ELSE 'Desierto' END AS cartel_stat,
        CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') THEN substr(o_orderpriority, 1, 1) END AS cod_excepcion,
        CASE o_orderpriority WHEN '5-LOW' THEN 'escasa cuantía' WHEN '1-URGENT' THEN 'Proveedor único' END AS des_excepcion,
        o_totalprice AS monto_est, strftime(o_orderdate, '%Y%m') AS source_month
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 8 <> 0""",
    "bid": """SELECT l_orderkey::VARCHAR AS nro_sicop, l_suppkey::VARCHAR AS nro_oferta, l_suppkey::VARCHAR AS cedula_proveedor,
        CASE WHEN l_suppkey % 10 = 0 THEN 'C' || (l_suppkey % 4) END AS id_consorcio, strftime(min(l_shipdate), '%Y%m') AS source_month
      FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "bid_line": """SELECT l_orderkey::VARCHAR AS nro_sicop, l_suppkey::VARCHAR AS nro_oferta, l_linenumber::VARCHAR AS nro_linea, l_partkey::VARCHAR AS codigo_producto,
        l_quantity AS cantidad, l_extendedprice / l_quantity AS precio_unitario, CASE l_linestatus WHEN 'F' THEN 'CRC' ELSE 'USD' END AS moneda,
        strftime(l_shipdate, '%Y%m') AS source_month FROM lineitem""",
    "award_line": """SELECT l_orderkey::VARCHAR AS nro_sicop, '1' AS nro_oferta, l_linenumber::VARCHAR AS nro_linea, l_suppkey::VARCHAR AS nro_acto, l_suppkey::VARCHAR AS cedula_proveedor,
        l_partkey::VARCHAR AS codigo_producto, l_quantity AS cantidad, l_extendedprice / l_quantity AS precio_unitario,
        CASE l_linestatus WHEN 'F' THEN 'CRC' ELSE 'USD' END AS moneda, strftime(l_shipdate, '%Y%m') AS source_month FROM lineitem WHERE l_returnflag = 'R'""",
    "latest_award": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY nro_sicop, nro_oferta, nro_linea
        ORDER BY nro_acto::BIGINT DESC, nro_acto DESC, codigo_producto DESC, precio_unitario DESC, cantidad DESC, source_month DESC) AS rn FROM award_line) WHERE rn = 1""",
    "contract": """SELECT l_orderkey::VARCHAR AS nro_contrato, l_linenumber::VARCHAR AS secuencia, l_orderkey::VARCHAR AS nro_sicop, l_suppkey::VARCHAR AS cedula_proveedor,
        strftime(l_shipdate, '%Y-%m-%d') AS fecha_notificacion, strftime(l_shipdate, '%Y%m') AS source_month FROM lineitem WHERE l_returnflag = 'A'""",
    "stage_dates": """SELECT l_orderkey::VARCHAR AS nro_sicop, '00' AS cartel_seq, '1' AS partida, l_linenumber::VARCHAR AS linea, o_orderdate::DATE AS publicacion,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE END AS adjudicacion_firme,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE + l_linenumber::INT END AS fecha_elaboracion_contrato,
        CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_shipdate::DATE + (30 + l_linenumber)::INT END AS fecha_1ra_sol_pago,
        CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN l_shipdate::DATE + (60 + l_linenumber)::INT END AS fecha_resul_pago,
        strftime(l_shipdate, '%Y%m') AS source_month FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "supplier_t": "SELECT s_suppkey::VARCHAR AS cedula_proveedor, s_name AS nombre FROM supplier",
    "institution": "SELECT n_nationkey::VARCHAR AS cedula, n_name AS nombre FROM nation",
    "appeal": """SELECT (event_id - event_id % 2)::VARCHAR AS nro_recurso, (user_id % 100)::VARCHAR AS cedula_proveedor,
        CASE event_id % 4 WHEN 0 THEN 'Con lugar' WHEN 1 THEN 'Sin lugar' WHEN 2 THEN ' Parcialmente con lugar' END AS resultado FROM events WHERE event_type = 'error'""",
    "sanction": "SELECT s_suppkey::VARCHAR AS cedula_proveedor FROM supplier WHERE s_acctbal < 0",
    # derived
    "bidder_counts": """SELECT b.nro_sicop, any_value(t.cedula_institucion) AS cedula_institucion, any_value(t.fecha_publicacion) AS published,
        count(DISTINCT b.cedula_proveedor) AS bidders, count(DISTINCT b.nro_oferta) AS offers FROM bid b LEFT JOIN tender t USING (nro_sicop) GROUP BY b.nro_sicop""",
    "tender_bidders": "SELECT DISTINCT b.nro_sicop, b.cedula_proveedor, t.cedula_institucion FROM bid b JOIN tender t USING (nro_sicop)",
    "tender_winners": "SELECT DISTINCT a.nro_sicop, a.cedula_proveedor AS winner FROM award_line a JOIN tender t USING (nro_sicop)",
    "appearances": """SELECT b.cedula_proveedor, b.nro_sicop, t.cedula_institucion, substr(t.fecha_publicacion, 1, 7) AS period,
        b.nro_sicop IN (SELECT nro_sicop FROM award_line) AS decided, (b.nro_sicop, b.cedula_proveedor) IN (SELECT nro_sicop, cedula_proveedor FROM award_line) AS won
      FROM (SELECT DISTINCT nro_sicop, cedula_proveedor FROM bid) b JOIN tender t USING (nro_sicop)""",
    "lost": "SELECT a.cedula_proveedor, a.nro_sicop, w.cedula_proveedor AS rival FROM appearances a JOIN (SELECT DISTINCT nro_sicop, cedula_proveedor FROM award_line) w USING (nro_sicop) WHERE a.decided AND NOT a.won",
    "prices": "SELECT * FROM bid_line WHERE moneda = 'CRC' AND precio_unitario > 0 AND cantidad > 0",
    "price_stats": """SELECT codigo_producto, count(*) AS n, min(precio_unitario) AS mn, quantile_cont(precio_unitario, 0.25) AS p25, quantile_cont(precio_unitario, 0.5) AS med,
        quantile_cont(precio_unitario, 0.75) AS p75, quantile_cont(precio_unitario, 0.9) AS p90, max(precio_unitario) AS mx, avg((cantidad = 1)::INT) AS quantity_one FROM prices GROUP BY 1""",
    "magnitudes": """SELECT codigo_producto, count(d) AS decades, coalesce(max(d) - min(d), 0) AS decade_span FROM (
        SELECT codigo_producto, CASE WHEN c / sum(c) OVER (PARTITION BY codigo_producto) >= 0.05 THEN decade END AS d FROM (
          SELECT codigo_producto, floor(log10(precio_unitario))::INT AS decade, count(*) AS c FROM prices GROUP BY 1, 2)) GROUP BY 1""",
    "price_verdicts": """SELECT s.*, m.decades, m.decade_span, p75 / p25 AS iqr_ratio, mx / mn AS spread,
        CASE WHEN n < 10 THEN 'small-sample' WHEN p75 / p25 > 10 THEN 'iqr-ratio' WHEN mx / mn > 1000 THEN 'spread' WHEN decades >= 3 THEN 'decades'
          WHEN decade_span >= 2 THEN 'decade-span' WHEN quantity_one >= 0.8 AND p75 / p25 > 3 THEN 'lump-sum' END AS reason
      FROM price_stats s JOIN magnitudes m USING (codigo_producto)""",
    "price_fences": """SELECT codigo_producto, med, mad, mean_ad, CASE WHEN mad > 0 THEN med + 3.5 * mad / 0.6745 WHEN mean_ad > 0 THEN med + 3.5 * 1.253314 * mean_ad END AS fence,
        CASE WHEN mad > 0 THEN 'mad' WHEN mean_ad > 0 THEN 'mean-ad' ELSE 'identical' END AS rule FROM (
          SELECT codigo_producto, any_value(med) AS med, quantile_cont(abs(precio_unitario - med), 0.5) * 1.4826 AS mad, avg(abs(precio_unitario - med)) AS mean_ad
          FROM prices JOIN price_stats USING (codigo_producto) GROUP BY 1)""",
    "price_outliers": """SELECT p.codigo_producto, p.nro_sicop, p.nro_linea, p.cantidad, p.precio_unitario, p.precio_unitario / f.med AS ratio_to_median,
        CASE f.rule WHEN 'mad' THEN 0.6745 * (p.precio_unitario - f.med) / f.mad ELSE (p.precio_unitario - f.med) / (1.253314 * f.mean_ad) END AS modified_z,
        (p.precio_unitario - f.med) * p.cantidad AS excess_value, f.rule
      FROM prices p JOIN price_fences f USING (codigo_producto) JOIN price_verdicts v USING (codigo_producto)
      WHERE v.reason IS NULL AND p.precio_unitario > f.fence AND p.precio_unitario >= f.med * 1.5""",
    "stage_rows": """SELECT nro_sicop, nro_sicop || '|' || cartel_seq || '|' || partida || '|' || linea AS line_id, u.stage, u.s AS start, u.e AS stop FROM stage_dates, LATERAL (VALUES
        ('publication_to_award', publicacion, adjudicacion_firme), ('award_to_contract', adjudicacion_firme, fecha_elaboracion_contrato), ('award_to_payment', adjudicacion_firme, fecha_resul_pago),
        ('award_to_first_payment_request', adjudicacion_firme, fecha_1ra_sol_pago), ('contract_to_payment', fecha_elaboracion_contrato, fecha_resul_pago)) u(stage, s, e)""",
    "stage_procs": """SELECT nro_sicop, stage, min(start) AS start, CASE WHEN count(stop) > 0 AND count(stop) = count(start) THEN max(stop) END AS stop, count(start) AS lines_started, count(stop) AS lines_ended
      FROM stage_rows GROUP BY 1, 2""",
    "stage_disposed": """SELECT *, CASE disposition WHEN 'completed' THEN stop - start WHEN 'censored' THEN DATE '1998-08-01' - start END AS days FROM (
        SELECT *, CASE WHEN start IS NULL THEN 'notStarted' WHEN stop IS NULL THEN CASE WHEN DATE '1998-08-01' >= start THEN 'censored' ELSE 'negative' END
          WHEN stop < start THEN 'negative' ELSE 'completed' END AS disposition FROM stage_procs)""",
    "inst_comp": """SELECT cedula_institucion, count(*) AS tenders_published, count(bidders) AS tenders_with_bids, count(*) FILTER (bidders = 1) AS single_bidder,
        count(*) FILTER (des_excepcion IS NOT NULL) AS exception_tenders, count(*) FILTER (des_excepcion IS NOT NULL AND lower(des_excepcion) NOT LIKE '%escasa cuant%') AS substantive_exceptions,
        count(*) FILTER (cartel_stat = 'Desierto') AS no_award, count(*) FILTER (cartel_stat IN ('Desierto', 'Contrato')) AS resolved
      FROM tender t LEFT JOIN (SELECT nro_sicop, count(DISTINCT cedula_proveedor) AS bidders FROM bid GROUP BY 1) USING (nro_sicop) GROUP BY 1""",
    "inst_dur": """SELECT cedula_institucion, count(DISTINCT d.nro_sicop) AS procedures,
        count(*) FILTER (stage = 'publication_to_award' AND disposition = 'completed') AS award_n, quantile_cont(days, 0.5) FILTER (stage = 'publication_to_award' AND disposition = 'completed') AS award_med,
        count(*) FILTER (stage = 'publication_to_award' AND disposition = 'censored') AS award_censored,
        count(*) FILTER (stage = 'award_to_payment' AND disposition = 'completed') AS payment_n, quantile_cont(days, 0.5) FILTER (stage = 'award_to_payment' AND disposition = 'completed') AS payment_med,
        count(*) FILTER (stage = 'award_to_payment' AND disposition = 'censored') AS payment_censored
      FROM stage_disposed d JOIN tender USING (nro_sicop) GROUP BY 1""",
    "inst_metrics": """SELECT cedula_institucion, nombre, tenders_published, metric, value, n FROM inst_comp c LEFT JOIN inst_dur d USING (cedula_institucion) LEFT JOIN institution i ON i.cedula = cedula_institucion, LATERAL (VALUES
        ('single_bidder_rate', CASE WHEN tenders_with_bids > 0 THEN single_bidder / tenders_with_bids END, tenders_with_bids),
        ('exception_rate', substantive_exceptions / tenders_published, tenders_published),
        ('deserted_rate', CASE WHEN resolved > 0 THEN no_award / resolved END, CASE WHEN no_award > 0 THEN resolved ELSE no_award END),
        ('publication_to_award_days', CASE WHEN award_n >= 10 THEN award_med END, coalesce(award_n, 0)),
        ('award_to_payment_days', CASE WHEN payment_n >= 10 THEN payment_med END, coalesce(payment_n, 0))) m(metric, value, n)""",
    "order_cells": """SELECT o_orderkey, 'orders' AS t, o_orderkey::VARCHAR AS id, [
        {'k': 'o_orderkey', 'v': o_orderkey::VARCHAR}, {'k': 'o_orderpriority', 'v': o_orderpriority}, {'k': 'o_orderstatus', 'v': o_orderstatus}, {'k': 'o_price', 'v': round(o_totalprice)::BIGINT::VARCHAR}, {'k': 'o_seen', 'v': 'a'}] AS pairs FROM orders""",
    "order_cells_2": """SELECT o_orderkey, 'orders' AS t, o_orderkey::VARCHAR AS id, [
        {'k': 'o_orderkey', 'v': o_orderkey::VARCHAR}, {'k': 'o_orderpriority', 'v': CASE WHEN o_orderkey % 89 = 0 THEN 'edited' ELSE o_orderpriority END}, {'k': 'o_orderstatus', 'v': o_orderstatus},
        {'k': 'o_price', 'v': round(o_totalprice)::BIGINT::VARCHAR || CASE WHEN o_orderkey % 83 = 0 THEN '.000' ELSE '' END}, {'k': 'o_seen', 'v': CASE WHEN o_orderkey % 79 = 0 THEN 'b' ELSE 'a' END}] AS pairs
      FROM (SELECT * FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0)""",
}
_ENCODE = "'cartulary-canon-2' || chr(0) || t || chr(0) || id || chr(0) || array_to_string(list_transform({pairs}, lambda p: p.k || chr(31) || {value}), chr(30))"
_VALUES = r"CASE WHEN p.k = 'o_price' THEN regexp_replace(p.v, '\.0*$', '') ELSE p.v END"
for _n, _c in (("1", "order_cells"), ("2", "order_cells_2")):
    LENS[f"snap{_n}"] = (
        f"SELECT t AS table_name, id, sha256({_ENCODE.format(pairs='pairs', value='p.v')}) AS byte_hash, "
        f"sha256({_ENCODE.format(pairs='pairs[1:4]', value=_VALUES)}) AS value_hash, pairs FROM {_c}"
    )
LENS["changes"] = """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'added' WHEN a.value_hash = b.value_hash THEN 'reformatted' ELSE 'silentRevision' END AS kind,
        a.byte_hash AS before_hash, b.byte_hash AS after_hash, a.pairs AS before_pairs, b.pairs AS after_pairs FROM snap1 a FULL OUTER JOIN snap2 b USING (id) WHERE a.byte_hash IS DISTINCT FROM b.byte_hash"""
LENS["field_rows"] = """SELECT id, kind, before_pairs[i].k AS field, before_pairs[i].v AS before_value, after_pairs[i].v AS after_value FROM changes, range(1, 6) r(i)
      WHERE kind IN ('reformatted', 'silentRevision') AND before_pairs[i].v <> after_pairs[i].v"""
LENS["observations"] = """SELECT 'cr' AS source, strftime(ts, '%Y%m') AS period, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS observed_at, sha256('c' || (event_id % 3) || strftime(ts, '%Y%m')) AS sha256,
        CASE WHEN event_type = 'view' THEN 'stored' ELSE 'unchanged' END AS status, event_id AS content_length FROM events"""


def needed(sql: str) -> list[str]:
    """Lens tables that a query reads, each after those that it reads itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in LENS:
            if name not in out and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(LENS[name])
                out.append(name)

    visit(sql)
    return out


def with_lens(sql: str) -> str:
    """A query with the lens tables that it reads in front, as common table expressions."""
    ctes = [f"{name} AS ({LENS[name]})" for name in needed(sql)]
    if not ctes:
        return sql
    head = ",\n".join(ctes)
    stripped = sql.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{stripped[15:]}"
    return f"WITH {head},\n{stripped[5:]}" if stripped.upper().startswith("WITH ") else f"WITH {head}\n{stripped}"
