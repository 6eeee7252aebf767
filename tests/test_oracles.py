"""Registered queries against their SQL on the small tables, where those are."""

import os

import duckdb
import pytest

from panelforge.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events pages".split()
CHECKED = [
    "returns_summary", "densified_grid", "simple_returns_padded", "residual_winsorised", "forward_target_h3", "feat_volume_amihud", "feat_calendar",
    "cross_sectional_rank", "folds_schedule", "pit_histogram", "daily_rank_ic", "weights_projected", "turnover_capped", "matched_vol_gate",
    "filings_joined", "event_entry_asof", "liquidity_panel", "double_sort", "design_matrix", "gate_ablation", "event_report", "pit_pvalue",
    "page_date_scrape", "cache_append", "cache_coverage", "event_dates_csv", "predictions_round_trip",
]


def test_every_query_with_sql_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 70


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == want
