"""Registered queries against their SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

from conftest import DATA

NAMES = (
    "p3_period_rows", "p6_rows_of_stocks", "j3_resolved_codes", "q4_classify_reports", "a1_sector_timeseries", "a8_report_counts", "q1_price_snapshot", "u5_partial_run", "f2_dense_series", "a13_term_table",
    "f8_grounding", "f10_assembled_inputs", "w5_newest_sections", "a14_segment_percentiles", "w6_best_segments", "q6_peers_all", "q7_theme_search", "q8_compare_reports", "j13_report_pairs", "w8_pages_text",
    "f23_grounded_metrics", "f31_requeue_criteria", "m5_review_apply", "m6_undo", "w14_retention", "q10_freshness", "q11_collect_increment", "m2_stream_first_deliveries", "m3_stream_weekly_counts", "s1_stock_list",
    "s5_repeated_keys", "m5_repeated_decisions", "m9_repeated_profiles", "p3_month_layout", "q3_counts_of_layout", "q5_build_run", "q5_published_terms", "q11_first_run", "q12_requeue", "f35_tree_fingerprint",
    "m1_stream_increments", "m2_stream_merge", "m4_stream_silent_work", "a25_grounding_ratio", "p7_profiles_with_terms", "w12_term_ranking", "j15_percentiles", "k3_nearest_companies",
)


def text(value):
    if value is None or value != value:
        return ""
    if isinstance(value, (float, np.floating)):
        return f"{value:.5f}".replace("-0.00000", "0.00000")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    from equityjobs import catalog

    df = catalog.QUERIES[name](spark, str(DATA))
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    found = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_training_data_package():
    from pathlib import Path

    import equityjobs

    for f in Path(equityjobs.__file__).parent.rglob("*.py"):
        if "llm" not in f.parts:
            assert "equityjobs.llm" not in f.read_text(), f
