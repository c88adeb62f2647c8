"""Queries against their SQL. All of them with ALL_QUERIES=1, else a cross-section."""

import os

import pytest

import workload
from workload.check import compare

from .conftest import SF

ENTRIES = workload.load()
SAMPLE = ["S1_event_csv", "S4_point_json", "S8_parquet_sink", "P8_clock_to_utc", "C9_duplicates", "J4_assemble_sources",
          "J9_supplement_merge", "A1b_dense_cell_hours", "A1c_hot_cell_statistics", "A8_column_profile",
          "A12_rank_correlation", "A14_null_rate_by_partner", "A20_temporal_by_cell", "W1_zero_runs", "W2b_row_ranks",
          "F10_scaler_apply", "K1_relevance_occurrence", "K4_greedy_two_steps", "V4b_balanced_subsample",
          "V6_prepared_dataset", "M7b_ranking_by_year", "M9_classification", "M16_window_curve", "K10_fit_score_count"]
NAMES = [n for n, e in ENTRIES.items() if e.sql] if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    assert compare(ENTRIES[name], spark, SF) is None


def test_entry_has_rows(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert entry(spark).limit(1).count() == 1
    assert set(oracle_sql()) <= set(queries())
