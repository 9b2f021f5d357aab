"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import catalog
from tools.check import compare, connect

QUICK = [
    "a3_results_csv", "a5_progress_steps", "b6_length_gate", "c6_few_shot_prompt", "e1_without_finished",
    "e2_few_shot_picks", "f2_dispatch", "f5_evaluate_equations", "g4_coerce_numbers", "g5_cells",
    "g8_aggregates", "g9_grouped", "g10_top_three", "h1_shuffle", "h7_padding", "h8_group_by_length",
    "i1_closed_replies", "i1_growing_replies", "i2_closed_replies", "j2_accuracy", "j5_incremental_merge", "j4_compare_variants", "j5_merge_runs",
]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, name):
    text, _, good = compare(spark, connect(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert good, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["sample_id", "value"]
