"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from cartulary.functions import stats
from cartulary.operators import bundle, index
from cartulary.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: All queries have been compared at two sizes; these run with every test.
NAMES = (
    "bidder_counts", "bidder_distribution", "single_bidder_by_year", "exception_rates", "deserted_rate", "competition_by_institution", "latest_award_lines", "orphan_award_lines",
    "concentration_hhi", "rotation_screen", "losing_screen", "spread_screen", "sole_bid_pairs", "price_verdict", "price_outliers", "stage_summary", "km_median", "duration_by_institution",
    "supplier_win_rate", "rival_gap", "institution_peers", "canonical_records", "content_ids", "snapshot_diff", "detail_budget", "record_transitions", "recovery_inventory", "anchor_parse",
    "latest_wins_load", "entity_groups", "alert_matches", "ocds_awards", "schema_changes", "binomial_table", "release_figures", "collusion_report", "supplier_profiles", "exact_deltas", "period_ranges",
    "proofs_chosen", "bucket_diff", "bucketed_state", "record_history", "validity_intervals", "occurrence_numbers", "hot_quantiles", "peers_all", "deep_pages", "price_suppliers", "release_members",
    "amendments", "repeated_keys", "price_exclusions_counted", "window_of_institution",
)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the generated tables are not here")


def plain(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    theirs = sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall())
    assert mine == theirs


def test_fair_tails_at_exact_halves_round_as_in_sql(spark, duck):
    """Up to 100 tosses at 6 and 8 digits, 7 of 7 (0.0078125) among them, then all digits of the queries that show tails."""
    found = duck.execute("""WITH p AS (SELECT n, i AS k, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS c FROM range(1, 101) a(n), LATERAL (SELECT unnest(range(0, n + 1)) AS i)),
    s AS (SELECT n, k, sum(c) OVER (PARTITION BY n ORDER BY k DESC) AS p FROM p) SELECT n, k, round(least(1.0, p), 6), round(least(1.0, p), 8) FROM s""").fetchall()
    tail = stats.binomial_tail(F.col("k"), F.col("n"))
    mine = spark.createDataFrame([(n, k) for n, k, _, _ in found], "n long, k long").select("n", "k", F.round(tail, 6), F.round(tail, 8)).collect()
    assert sorted(map(tuple, mine)) == sorted(found) and (7, 7, 0.007813, 0.0078125) in found
    for name in ("binomial_table", "losing_screen"):
        df = catalog.queries()[name](spark, str(DATA))
        cur = duck.execute(catalog.oracle_sql()[name])
        order = [d[0] for d in cur.description]
        assert sorted(map(tuple, df.select(*order).collect())) == sorted(cur.fetchall()), name


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_bundle_lines_have_all_values(spark):
    lines = catalog.queries()["bundle_lines"](spark, str(DATA.parent / "sf0.01"))
    kept = lines.selectExpr("count(*) as n", "count_if(line like '%\"valuesOmitted\":true%') as omitted").first()
    assert kept["n"] > 500 and kept["omitted"] == 0


def test_bundle_lines_have_all_values_beyond_the_budget(spark, duck, monkeypatch):
    """A bundle's own budget, here 5 values, doesn't cut a query whose SQL has all values."""
    monkeypatch.setattr(bundle.build, "__defaults__", (*bundle.build.__defaults__[:-1], 5))
    for name in ("bundle_lines", "bundle_filtered"):
        cur = duck.execute(catalog.oracle_sql()[name])
        order = [d[0] for d in cur.description]
        theirs = sorted(cur.fetchall())
        assert len(theirs) > 1 and sorted(map(tuple, catalog.queries()[name](spark, str(DATA)).select(*order).collect())) == theirs, name


def test_nearest_rank_windows_run_over_distinct_values(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, 1, 2, 2, 2, 9, None]], "days int")
    out = index.nearest_rank(df, "days", (0.25, 0.5, 0.9))
    ordered = [1, 1, 2, 2, 2, 3, 9]
    assert {float(r["share"]): r["value"] for r in out.collect()} == {s: ordered[math.floor(6 * s)] for s in (0.25, 0.5, 0.9)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Window"):]
